"""Queries: reading, renaming, checking and filling."""

from pyspark.sql import functions as F

from hubflow import adapters as V
from hubflow.catalog import query
from hubflow.operators import grid, impute
from hubflow.sources import files
from hubflow.sources import readers as S

R = lambda c, n=6: F.round(c, n).alias(c)


@query("rename_standard", "SELECT s_suppkey AS vehicle, s_acctbal AS capacity, s_name FROM supplier")
def rename_standard(spark, sf):
    raw = V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias(" ARAÇ  Türü"), F.col("s_acctbal").alias("Kapasite"), "s_name")
    return S.rename_standard(raw, {"arac turu": "vehicle", "kapasite": "capacity"})


@query("clean_dims", "SELECT trim(c_name) AS c_name, CAST(c_acctbal AS DOUBLE) AS c_acctbal, CASE WHEN c_nationkey % 5 = 0 THEN 0 ELSE c_nationkey END AS n FROM customer")
def clean_dims(spark, sf):
    n = F.when(F.col("c_nationkey") % 5 == 0, "none").otherwise(F.col("c_nationkey").cast("string"))
    raw = V.table(spark, sf, "customer").select(F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("c_name"), F.col("c_acctbal").cast("string").alias("c_acctbal"), n.alias("n"))
    return S.clean(raw, ["c_name"], ["c_acctbal"], ["n"])


@query("load_demand_history", "SELECT source, dest, date, volume, slot FROM demand_log")
def load_demand_history(spark, sf):
    """The whole log as a CSV file under other names, found by them and by place."""
    d = V.demand_log(spark, sf)
    spark = d.sparkSession
    path = files.folder(spark, "demand-log") + ".csv"
    d.select(F.col("source").alias("Çıkış TM"), F.col("dest").alias("Varış TM"), F.col("date").alias("Tarih"), F.col("volume").alias("Toplam Desi"), F.col("slot").alias("x5")).write.option("header", True).csv(path)
    return S.read_demand_history(spark, path)


@query("split_lane_label", "SELECT DISTINCT source, dest FROM demand_log")
def split_lane_label(spark, sf):
    labels = V.demand_log(spark, sf).select(grid.lane_key().alias("label")).distinct()
    source, dest = S.split_lane("label")
    return labels.select(source.alias("source"), dest.alias("dest"))


@query("input_validation", "SELECT count(*) AS n, count(*) FILTER (o_orderdate IS NULL) AS bad_dates, count(*) FILTER (o_totalprice IS NULL) AS bad_values, min(CAST(o_orderdate AS DATE)) AS first, max(CAST(o_orderdate AS DATE)) AS last FROM orders")
def input_validation(spark, sf):
    """One row of counts for dates that can't be read and values that aren't numbers."""
    raw = V.table(spark, sf, "orders").select(F.col("o_orderdate").cast("string").alias("date"), F.col("o_totalprice").cast("string").alias("value"))
    day = F.to_date(F.try_to_timestamp("date"))
    return S.require(raw, ["date", "value"]).agg(F.count("*").alias("n"), F.count_if(day.isNull()).alias("bad_dates"), F.count_if(F.col("value").try_cast("double").isNull()).alias("bad_values"), F.min(day).alias("first"), F.max(day).alias("last"))


@query("load_plan_for_view", "SELECT demand_id, day, slot, source || ' → ' || destination AS lane, source < 'C' AS is_first_leg FROM demands")
def load_plan_for_view(spark, sf):
    d = V.demands(spark, sf).withColumns({"day": F.col("day").cast("string"), "slot": F.concat("slot", F.lit(":00"))})
    day = F.to_date(F.try_to_timestamp("day"))
    return d.select("demand_id", day.alias("day"), F.substring("slot", 1, 5).alias("slot"), grid.lane_key("source", "destination").alias("lane"), (F.col("source") < "C").alias("is_first_leg"))


def plan_inputs(spark, sf):
    """The folder of the plan's inputs, written from the tables."""
    hubs = V.hub_capacity(spark, sf)
    path = files.folder(spark, "plan-inputs")
    tables = {"forecast": V.demands(spark, sf), "route_matrix": V.lanes(spark, sf), "vehicle_costs": V.vehicle_types(spark), "rental_limits": V.rentals(spark, sf), "handling_capacity": hubs, "truck_capacity": hubs}
    files.write_plan_inputs(tables, path, "demands")
    return path


@query("read_solver_input", "SELECT vehicle_type, lower(trim(vehicle_type)) IN ('tır', 'tir') AS is_truck, coalesce(sum(vehicle_count), 0) AS stock FROM vehicle_types LEFT JOIN rentals USING (vehicle_type) GROUP BY vehicle_type")
def read_solver_input(spark, sf):
    """From the files of the plan's inputs."""
    return files.solver_dimensions(files.read_plan_inputs(spark, plan_inputs(spark, sf)))


@query("read_contract", "SELECT source, destination, vehicle_count, vehicle_type FROM rentals")
def read_contract(spark, sf):
    """A contract's file, which must have these four columns and no others."""
    path, columns = files.folder(spark, "contract"), "source string, destination string, vehicle_count int, vehicle_type string"
    files.publish(V.rentals(spark, sf).select("source", "destination", "vehicle_count", "vehicle_type"), path)
    return files.published(spark, path, columns)


@query("write_plan_inputs", "SELECT (SELECT count(*) FROM demands) AS demands, (SELECT count(*) FROM lanes) AS lanes, (SELECT count(DISTINCT vehicle_type) FROM lane_vehicle) AS vehicle_types")
def write_plan_inputs(spark, sf):
    """The metadata written beside the tables, held against what is in their files."""
    path = plan_inputs(spark, sf)
    read = files.read_plan_inputs(spark, path)
    about = spark.read.schema("forecast_rows long, route_matrix_rows long, vehicle_type_count long").option("multiLine", True).json(f"{path}/metadata.json")
    found = read["forecast"].agg(F.count("*").alias("demands")).crossJoin(read["route_matrix"].agg(F.count("*").alias("lanes"))).crossJoin(read["vehicle_costs"].agg(F.count_distinct("vehicle_type").alias("vehicle_types")))
    same = (F.col("demands") == F.col("forecast_rows")) & (F.col("lanes") == F.col("route_matrix_rows")) & (F.col("vehicle_types") == F.col("vehicle_type_count"))
    return found.crossJoin(about).where(same).select("demands", "lanes", "vehicle_types")


@query("prepare_group", "SELECT lane, date, volume_0900 FROM lane_day WHERE lane = 'ASIA → EUROPE'")
def prepare_group(spark, sf):
    return V.lane_day(spark, sf).where(F.col("lane") == "ASIA → EUROPE").select("lane", "date", "volume_0900")


@query("categorical_columns", "SELECT unnest(['o_orderpriority', 'o_orderstatus']) AS column_name, unnest([(SELECT count(DISTINCT o_orderpriority) FROM orders), (SELECT count(DISTINCT o_orderstatus) FROM orders)]) AS n")
def categorical_columns(spark, sf):
    """Text columns and how many values each has."""
    o = V.table(spark, sf, "orders")
    names = sorted(f.name for f in o.schema if f.dataType.simpleString() == "string")
    return o.agg(*(F.count_distinct(c).alias(c) for c in names)).select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n")) for c in names))))


@query("model_columns", "SELECT lane, volume_0900, weekday FROM (SELECT lane, date, volume_0900, volume_1700, 1 AS scale_factor_x, volume_0900 / 2 AS volume_scaled, 0 AS is_demand_censored_x, CAST(isodow(date) - 1 AS INTEGER) AS weekday FROM lane_day)")
def model_columns(spark, sf):
    """Without date, the other slot's target, and what is derived from the target."""
    d = V.lane_day(spark, sf).select("lane", "date", "volume_0900", "volume_1700", F.lit(1).alias("scale_factor_x"), (F.col("volume_0900") / 2).alias("volume_scaled"), F.lit(0).alias("is_demand_censored_x"), F.weekday("date").alias("weekday"))
    return d.select([c for c in d.columns if c not in ("date", "volume_1700") and not c.startswith(("scale_factor", "is_demand_censored")) and not c.endswith("_scaled")])


#: Prices with gaps: every third part of size under 10 has none.
GAPS = "(SELECT p_partkey, p_brand, p_size, CASE WHEN p_partkey % 3 = 0 OR p_brand = 'Brand#11' THEN NULL ELSE round(p_retailprice, 0) END AS price FROM part)"


def gaps(spark, sf):
    price = F.when((F.col("p_partkey") % 3 == 0) | (F.col("p_brand") == "Brand#11"), F.lit(None).cast("double")).otherwise(F.round("p_retailprice", 0))
    return V.table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", price.alias("price"))


def imputed(how: str, sql: str):
    @query(f"impute_{how}", f"WITH g AS (SELECT * FROM {GAPS}), b AS (SELECT p_brand, {sql} AS own FROM g GROUP BY p_brand) SELECT p_partkey, round(coalesce(price, own, (SELECT {sql} FROM g)), 6) AS price FROM g JOIN b USING (p_brand)")
    def run(spark, sf):
        return impute.impute(gaps(spark, sf), "price", how, "p_brand").select("p_partkey", R("price"))

    return run


impute_mean = imputed("mean", "avg(price)")
impute_median = imputed("median", "median(price)")


@query("impute_mode", f"""
    WITH g AS (SELECT * FROM {GAPS}), c AS (SELECT p_brand, price, count(*) AS n FROM g WHERE price IS NOT NULL GROUP BY ALL), m AS (SELECT p_brand, price AS own FROM c QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, price) = 1),
    a AS (SELECT price FROM (SELECT price, count(*) AS n FROM g WHERE price IS NOT NULL GROUP BY price) ORDER BY n DESC, price LIMIT 1)
    SELECT p_partkey, coalesce(g.price, own, (SELECT price FROM a)) AS price FROM g LEFT JOIN m USING (p_brand)""")
def impute_mode(spark, sf):
    return impute.impute(gaps(spark, sf), "price", "mode", "p_brand").select("p_partkey", "price")


@query("impute_constant", f"SELECT p_partkey, coalesce(price, -1) AS price FROM {GAPS}")
def impute_constant(spark, sf):
    return gaps(spark, sf).na.fill(-1.0, ["price"]).select("p_partkey", "price")


@query("impute_ffill", f"SELECT p_partkey, last_value(price IGNORE NULLS) OVER (PARTITION BY p_size ORDER BY p_partkey) AS price FROM {GAPS}")
def impute_ffill(spark, sf):
    return impute.fill_along(gaps(spark, sf), "price", "p_size", ["p_partkey"]).select("p_partkey", "price")


@query("impute_bfill", f"SELECT p_partkey, first_value(price IGNORE NULLS) OVER (PARTITION BY p_size ORDER BY p_partkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS price FROM {GAPS}")
def impute_bfill(spark, sf):
    return impute.fill_along(gaps(spark, sf), "price", "p_size", ["p_partkey"], False).select("p_partkey", "price")


@query("plan_tables", "SELECT day, source, destination, count(*) AS n, sum(volume) AS volume FROM demands GROUP BY ALL")
def plan_tables(spark, sf):
    """The plan as CSV by month, each file in order of day and lane, read back and counted by day and lane."""
    d = V.demands(spark, sf).withColumn("month", F.date_format("day", "yyyy-MM"))
    path, columns = files.folder(spark, "plan"), "demand_id string, source string, destination string, day date, slot string, volume double, month string"
    files.publish(d.select("demand_id", "source", "destination", "day", "slot", "volume", "month"), path, partition_by=("month",), order=("day", "slot", "source", "destination", "demand_id"))
    return files.published(spark, path, columns).groupBy("day", "source", "destination").agg(F.count("*").alias("n"), F.sum("volume").alias("volume"))