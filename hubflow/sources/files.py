"""Files in and out: tables published whole or not at all, read back under checked headers, and payloads of nested JSON."""

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hubflow.session import shared_dir
from hubflow.sources import readers

#: The file that names the version that readers see.
CURRENT = "CURRENT"


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the folder that all executors share."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file as a whole: under another name first, then renamed over what is there."""
    fs, part = _path(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(part, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    _, where = _path(spark, path)
    fs.delete(where, False)
    if not fs.rename(part, where):
        raise OSError(f"{path} can't be replaced")


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as a whole."""
    rows = spark.read.text(path, wholetext=True).collect()
    return rows[0].value if rows else ""


def publish(df: DataFrame, path: str, format: str = "csv", partition_by: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> None:
    """Write df as a new version under path and then name it in CURRENT, so readers see the old version or the new one as a whole, whenever a job dies.

    Rows of a partition value are brought together, so each has a few files, sorted by order within them. The version
    before stays until the next one is published: readers that have begun still find it.
    """
    spark = df.sparkSession
    version = f"version-{uuid.uuid4().hex}"
    out = df.repartition(*partition_by) if partition_by else df
    out = out.sortWithinPartitions(*partition_by, *order) if partition_by or order else out
    writer = out.write.partitionBy(*partition_by).format(format)
    (writer.option("header", True) if format == "csv" else writer).save(f"{path}/{version}")
    fs, root = _path(spark, path)
    before = _current(spark, path)
    write_text(spark, f"{path}/{CURRENT}", json.dumps({"version": version, "before": before, "format": format}))
    for f in fs.listStatus(root):
        name = f.getPath().getName()
        if name.startswith("version-") and name not in (version, before):
            fs.delete(f.getPath(), True)


def _current(spark: SparkSession, path: str) -> str | None:
    fs, where = _path(spark, f"{path}/{CURRENT}")
    return json.loads(read_text(spark, f"{path}/{CURRENT}"))["version"] if fs.exists(where) else None


def published(spark: SparkSession, path: str, schema: str | StructType, exactly: bool = True) -> DataFrame:
    """The current version under path, with the columns of schema. A CSV's header must name them, in any order, and (exactly) no others; values that don't fit their type are an error. Without a version it is one too."""
    version = _current(spark, path)
    if version is None:
        raise FileNotFoundError(f"nothing is published under {path}")
    about = json.loads(read_text(spark, f"{path}/{CURRENT}"))
    kinds = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    if about["format"] != "csv":
        return spark.read.schema(kinds).format(about["format"]).option("mode", "FAILFAST").load(f"{path}/{version}")
    raw = spark.read.option("header", True).csv(f"{path}/{version}")
    raw = readers.require(raw, kinds.names, exactly) if raw.columns else spark.createDataFrame([], StructType([StructType.fromDDL(f"`{n}` string").fields[0] for n in kinds.names]))
    return raw.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in kinds))


#: What a payload calls its fields, best first: lane, quantiles, and the recommended quantity.
KEYS = {"lane": ("TM_ID", "rota", "route"), "q10": ("demand_low", "q10"), "q50": ("demand_base", "q50"), "q90": ("demand_high", "q90"), "recommended": ("recommended_qty", "recommended_demand", "demand_base")}
_texts, _numbers = ("TM_ID", "rota", "route", "tarih", "slot", "talep_id", "risk_class"), ("demand_low", "q10", "demand_base", "q50", "demand_high", "q90", "recommended_qty", "recommended_demand")
_demand = ",".join([*(f"{n}:string" for n in _texts), *(f"{n}:double" for n in _numbers)])
PAYLOAD = f"metadata struct<date:string,slot:string,demands:bigint>, risk_summary map<string,bigint>, demands array<struct<{_demand}>>"


def write_payloads(bands: DataFrame, path: str) -> None:
    """A JSON document for each date and slot (partitions of path): metadata, counts of the classes, and its demands. bands: date, slot, demand_id, lane, q10, q50, q90, recommended, risk_class."""
    demand = F.struct(
        F.col("demand_id").alias("talep_id"), F.col("date").cast("string").alias("tarih"), F.col("lane").alias("TM_ID"), "slot",
        F.col("q10").alias("demand_low"), F.col("q50").alias("demand_base"), F.col("q90").alias("demand_high"), F.col("recommended").alias("recommended_qty"), "risk_class",
    )
    one = bands.groupBy("date", "slot").agg(F.array_sort(F.collect_list(demand)).alias("demands"))  # a row a lane
    classes = F.transform(F.array(*map(F.lit, ("LOW", "MEDIUM", "HIGH"))), lambda c: F.struct(c, F.size(F.filter("demands", lambda x: x["risk_class"] == c)).cast("long")))
    about = F.struct(F.col("date").cast("string").alias("date"), "slot", F.size("demands").cast("long").alias("demands"))
    rows = one.select(about.alias("metadata"), F.map_from_entries(classes).alias("risk_summary"), "demands", F.date_format("date", "yyyy-MM").alias("month"))
    publish(rows, path, "json", ("month",))


def payload_rows(documents: DataFrame) -> DataFrame:
    """date, slot, demand_id, source, destination, lane, q10, q50, q90, recommended of the documents' demands (columns of PAYLOAD), by the first of KEYS that a demand has. A demand without a lane is an error, and so are documents that have no demand at all."""
    rows = documents.select(F.explode("demands").alias("d"))
    if rows.isEmpty():
        raise ValueError("the payload has no demands")
    pick = lambda name: F.coalesce(*(F.col(f"d.{k}") for k in KEYS[name]))
    label = F.coalesce(*(F.when(F.trim(F.col(f"d.{k}")) != "", F.col(f"d.{k}")) for k in KEYS["lane"]))
    d = rows.withColumn("label", F.coalesce(label, F.raise_error(F.concat(F.lit("a demand has no lane: "), F.to_json("d")))))
    source, dest = readers.split_lane("label")
    numbers = [F.coalesce(pick(n), F.lit(0.0)).alias(n) for n in ("q10", "q50", "q90", "recommended")]
    return d.select(F.to_date("d.tarih").alias("date"), F.coalesce("d.slot", F.lit("UNKNOWN")).alias("slot"), F.coalesce("d.talep_id", F.lit("")).alias("demand_id"), source.alias("source"), dest.alias("destination"), F.col("label").alias("lane"), *numbers)


def read_payload_file(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a payload that is one JSON document over many lines, or a folder of such."""
    return payload_rows(spark.read.schema(PAYLOAD).option("multiLine", True).option("mode", "FAILFAST").json(path))


#: Tables that the plan is made from, by name.
PLAN_INPUTS = {
    "forecast": "demand_id string, source string, destination string, day date, slot string, volume double",
    "route_matrix": "source string, destination string, distance_km double, target_days double",
    "vehicle_costs": "vehicle_type string, capacity double, spot_hourly double, spot_km double",
    "rental_limits": "source string, destination string, vehicle_type string, vehicle_count int",
    "handling_capacity": "hub string, handling double",
    "truck_capacity": "hub string, trucks int",
}


def write_plan_inputs(tables: dict[str, DataFrame], path: str, source: str) -> None:
    """Each of PLAN_INPUTS as CSV under path, and beside them metadata.json: where the forecast is from, its rows, the lanes and the vehicle types."""
    spark = tables["forecast"].sparkSession
    for name, schema in PLAN_INPUTS.items():
        publish(tables[name].select(*StructType.fromDDL(schema).names), f"{path}/{name}")
    forecast, lanes, types = (tables[n].agg(c).first()[0] for n, c in (("forecast", F.count("*")), ("route_matrix", F.count("*")), ("vehicle_costs", F.count_distinct("vehicle_type"))))
    write_text(spark, f"{path}/metadata.json", json.dumps({"forecast_source": source, "forecast_rows": forecast, "route_matrix_rows": lanes, "vehicle_type_count": types}))


def read_plan_inputs(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of PLAN_INPUTS with their types. A forecast without rows, or with another number of them than its metadata says, is an error."""
    about = json.loads(read_text(spark, f"{path}/metadata.json"))
    out = {name: published(spark, f"{path}/{name}", schema) for name, schema in PLAN_INPUTS.items()}
    n = out["forecast"].count()
    if not n or n != about["forecast_rows"]:
        raise ValueError(f"the forecast under {path} has {n} rows, its metadata {about['forecast_rows']}")
    return out


def solver_dimensions(tables: dict[str, DataFrame]) -> DataFrame:
    """vehicle_type, is_truck (by name), stock: rented vehicles of each type in all lanes."""
    stock = tables["rental_limits"].groupBy("vehicle_type").agg(F.sum("vehicle_count").alias("stock"))
    truck = F.lower(F.trim("vehicle_type")).isin("tır", "tir")
    return tables["vehicle_costs"].join(stock, "vehicle_type", "left").select("vehicle_type", truck.alias("is_truck"), F.coalesce("stock", F.lit(0)).alias("stock"))
