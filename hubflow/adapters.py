"""The freight tables as views of the test tables, as DataFrames and as DuckDB SQL.

Demand is line items: a supplier's nation sends to a customer's nation. Small views are made of the 25 nations and the
5 regions alone, so their size is bounded and they may be broadcast.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Vehicle types with capacity, rates of spot vehicles by hour and kilometre, and speed.
VEHICLES = [("Tır", 22400.0, 487.5, 25.0, 65.0), ("Kamyon", 12000.0, 318.25, 21.0, 70.0), ("Hafif Kamyon", 7200.0, 364.58, 20.0, 75.0), ("Kamyonet", 5600.0, 197.91, 18.0, 80.0)]
#: National holidays by month and day.
HOLIDAYS = [(1, 1), (4, 23), (5, 1), (5, 19), (8, 30), (10, 29)]
SLOTS = ("09:00", "17:00")
#: Demand in planning units.
SCALE = 1000


_schemas: dict[tuple[str, str], StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose columns are read from its files once in an application: each later use of it spares that job."""
    path = f"{sf_dir}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _schemas:
        _schemas[key] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[key]).parquet(path)


def nations(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


def demand_log(spark, sf_dir) -> DataFrame:
    """source, dest, date, slot, volume, with the regions of both ends and the line's key."""
    n = nations(spark, sf_dir)
    supplier = table(spark, sf_dir, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("source"), F.col("r_name").alias("source_region"))
    customer = table(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("dest"), F.col("r_name").alias("dest_region"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_quantity")
    slot = F.when(F.col("l_linenumber") % 2 == 1, SLOTS[0]).otherwise(SLOTS[1])
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .select("source", "dest", F.to_date("l_shipdate").alias("date"), slot.alias("slot"), F.col("l_quantity").alias("volume"), "source_region", "dest_region", "l_orderkey", "l_linenumber")
    )


def region_log(spark, sf_dir) -> DataFrame:
    """demand_log between regions: 25 lanes."""
    d = demand_log(spark, sf_dir)
    return d.select(F.col("source_region").alias("source"), F.col("dest_region").alias("dest"), "date", "slot", "volume")


def lane_day(spark, sf_dir) -> DataFrame:
    """lane, source, dest, date, volume_0900, volume_1700 for every region lane and every day: days without demand have 0."""
    from hubflow.operators.grid import dense_lane_days

    return dense_lane_days(region_log(spark, sf_dir))


def lanes(spark, sf_dir) -> DataFrame:
    """source, destination, distance_km, target_days for every pair of different nations (600 rows)."""
    n = table(spark, sf_dir, "nation")
    a = n.select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("source"))
    b = n.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("destination"))
    pairs = a.join(F.broadcast(b), F.col("a") != F.col("b"))
    return pairs.select("source", "destination", (60 + ((F.col("a") * 31 + F.col("b") * 17) % 97) * 10).cast("double").alias("distance_km"), (1 + (F.col("a") + F.col("b")) % 2).cast("double").alias("target_days"))


def vehicle_types(spark) -> DataFrame:
    return spark.createDataFrame(VEHICLES, "vehicle_type string, capacity double, spot_hourly double, spot_km double, speed double")


def lane_vehicle(spark, sf_dir) -> DataFrame:
    """lanes for each vehicle type, with hours of travel (2400 rows)."""
    return lanes(spark, sf_dir).crossJoin(F.broadcast(vehicle_types(spark))).withColumn("hours", F.round(F.col("distance_km") / F.col("speed"), 2))


def hub_capacity(spark, sf_dir) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    return n.select(F.col("n_name").alias("hub"), (50000 + k * 7919 % 40000).cast("double").alias("handling"), (5 + k % 7).cast("int").alias("trucks"))


def rentals(spark, sf_dir) -> DataFrame:
    """source, destination, vehicle_type, vehicle_count of the contract (about one lane in forty)."""
    n = table(spark, sf_dir, "nation")
    a = n.select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("source"))
    b = n.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("destination"))
    pairs = a.join(F.broadcast(b), (F.col("a") != F.col("b")) & ((F.col("a") * 25 + F.col("b")) % 40 == 0))
    return pairs.select("source", "destination", F.lit("Tır").alias("vehicle_type"), (1 + F.col("a") % 2).cast("int").alias("vehicle_count"))


def demands(spark, sf_dir) -> DataFrame:
    """demand_id, source, destination, day, slot, volume in planning units: one row for each nation lane, day and slot."""
    d = demand_log(spark, sf_dir).where("source != dest").groupBy("source", "dest", "date", "slot").agg((F.sum("volume") * SCALE).alias("volume"))
    return d.select(F.concat_ws("|", "source", "dest", F.col("date").cast("string"), "slot").alias("demand_id"), "source", F.col("dest").alias("destination"), F.col("date").alias("day"), "slot", "volume")


def predictions(spark, sf_dir) -> DataFrame:
    """lane, source, dest, date, y, q10, q50, q90: a naive forecast of the 09:00 volume by the 14 days before."""
    from pyspark.sql import Window

    w = Window.partitionBy("lane").orderBy("date").rowsBetween(-14, -1)
    d = lane_day(spark, sf_dir).withColumns({"q50": F.avg("volume_0900").over(w), "sd": F.stddev_samp("volume_0900").over(w)})
    sd = F.coalesce("sd", F.lit(0.0))
    return d.where("q50 is not null").select("lane", "source", "dest", "date", F.col("volume_0900").alias("y"), F.greatest(F.lit(0.0), F.col("q50") - sd).alias("q10"), "q50", (F.col("q50") + sd).alias("q90"))


_types = ", ".join(f"('{v}', CAST({c} AS DOUBLE), CAST({h} AS DOUBLE), CAST({k} AS DOUBLE), CAST({s} AS DOUBLE))" for v, c, h, k, s in VEHICLES)

VIEWS = {
    "demand_log": """
        SELECT sn.n_name AS source, cn.n_name AS dest, CAST(l.l_shipdate AS DATE) AS date,
               CASE WHEN l.l_linenumber % 2 = 1 THEN '09:00' ELSE '17:00' END AS slot, l.l_quantity AS volume,
               sr.r_name AS source_region, cr.r_name AS dest_region, l.l_orderkey, l.l_linenumber
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
        JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN customer c ON o.o_custkey = c.c_custkey
        JOIN nation sn ON s.s_nationkey = sn.n_nationkey JOIN nation cn ON c.c_nationkey = cn.n_nationkey
        JOIN region sr ON sn.n_regionkey = sr.r_regionkey JOIN region cr ON cn.n_regionkey = cr.r_regionkey""",
    "region_log": "SELECT source_region AS source, dest_region AS dest, date, slot, volume FROM demand_log",
    "lane_day": """
        SELECT g.source || ' → ' || g.dest AS lane, g.source, g.dest, CAST(d.date AS DATE) AS date,
               CAST(coalesce(sum(CASE WHEN r.slot = '09:00' THEN r.volume END), 0) AS DOUBLE) AS volume_0900,
               CAST(coalesce(sum(CASE WHEN r.slot = '17:00' THEN r.volume END), 0) AS DOUBLE) AS volume_1700
        FROM (SELECT DISTINCT source, dest FROM region_log) g
        CROSS JOIN (SELECT unnest(generate_series((SELECT min(date) FROM region_log)::TIMESTAMP, (SELECT max(date) FROM region_log)::TIMESTAMP, INTERVAL 1 DAY)) AS date) d
        LEFT JOIN region_log r ON r.source = g.source AND r.dest = g.dest AND r.date = CAST(d.date AS DATE)
        GROUP BY g.source, g.dest, d.date""",
    "lanes": """
        SELECT a.n_name AS source, b.n_name AS destination, CAST(60 + ((a.n_nationkey * 31 + b.n_nationkey * 17) % 97) * 10 AS DOUBLE) AS distance_km,
               CAST(1 + (a.n_nationkey + b.n_nationkey) % 2 AS DOUBLE) AS target_days
        FROM nation a JOIN nation b ON a.n_nationkey <> b.n_nationkey""",
    "vehicle_types": f"SELECT * FROM (VALUES {_types}) t(vehicle_type, capacity, spot_hourly, spot_km, speed)",
    "lane_vehicle": "SELECT l.*, v.*, round(l.distance_km / v.speed, 2) AS hours FROM lanes l CROSS JOIN vehicle_types v",
    "hub_capacity": "SELECT n_name AS hub, CAST(50000 + n_nationkey * 7919 % 40000 AS DOUBLE) AS handling, CAST(5 + n_nationkey % 7 AS INTEGER) AS trucks FROM nation",
    "rentals": """
        SELECT a.n_name AS source, b.n_name AS destination, 'Tır' AS vehicle_type, CAST(1 + a.n_nationkey % 2 AS INTEGER) AS vehicle_count
        FROM nation a JOIN nation b ON a.n_nationkey <> b.n_nationkey AND (a.n_nationkey * 25 + b.n_nationkey) % 40 = 0""",
    "demands": f"""
        SELECT source || '|' || dest || '|' || CAST(date AS VARCHAR) || '|' || slot AS demand_id, source, dest AS destination, date AS day, slot, sum(volume) * {SCALE} AS volume
        FROM demand_log WHERE source <> dest GROUP BY source, dest, date, slot""",
    "predictions": """
        SELECT lane, source, dest, date, y, greatest(0, q50 - sd) AS q10, q50, q50 + sd AS q90 FROM (
          SELECT lane, source, dest, date, volume_0900 AS y, avg(volume_0900) OVER w AS q50, coalesce(stddev_samp(volume_0900) OVER w, 0) AS sd
          FROM lane_day WINDOW w AS (PARTITION BY lane ORDER BY date ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING))
        WHERE q50 IS NOT NULL""",
}
