"""Queries: aggregations, joins and unions of demand."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from hubflow import adapters as V
from hubflow.catalog import query
from hubflow.operators import grid, rollups

R = lambda c, n=6: F.round(c, n)


@query("demand_rollup", "SELECT source || ' → ' || dest AS lane, source, dest, date, slot, sum(volume) AS volume FROM demand_log GROUP BY ALL")
def demand_rollup(spark, sf):
    return grid.demand_rollup(V.demand_log(spark, sf))


@query("slot_pivot", """
    SELECT source || ' → ' || dest AS lane, source, dest, date, coalesce(sum(volume) FILTER (slot = '09:00'), 0) AS volume_0900, coalesce(sum(volume) FILTER (slot = '17:00'), 0) AS volume_1700
    FROM demand_log GROUP BY source, dest, date""")
def slot_pivot(spark, sf):
    return grid.slot_pivot(grid.demand_rollup(V.demand_log(spark, sf)))


@query("dense_date_grid", "SELECT lane, source, dest, date FROM lane_day")
def dense_date_grid(spark, sf):
    return grid.date_grid(V.region_log(spark, sf))


@query("grid_fill", "SELECT * FROM lane_day")
def grid_fill(spark, sf):
    return V.lane_day(spark, sf)


@query("lane_key", "SELECT DISTINCT source || ' → ' || dest AS lane FROM demand_log")
def lane_key(spark, sf):
    return V.demand_log(spark, sf).select(grid.lane_key().alias("lane")).distinct()


@query("total_daily_volume", "SELECT lane, date, volume_0900 + volume_1700 AS total FROM lane_day")
def total_daily_volume(spark, sf):
    return V.lane_day(spark, sf).select("lane", "date", (F.coalesce("volume_0900", F.lit(0.0)) + F.coalesce("volume_1700", F.lit(0.0))).alias("total"))


@query("lane_total", "SELECT source, dest, sum(volume) AS volume, count(*) AS n FROM demand_log GROUP BY ALL")
def lane_total(spark, sf):
    return rollups.lane_total(V.demand_log(spark, sf))


@query("planning_demand", """
    SELECT source, dest, date, slot, sum(greatest(0, volume - 5)) AS volume, arg_max(l_orderkey * 10 + l_linenumber, l_orderkey * 10 + l_linenumber) AS demand_id
    FROM demand_log GROUP BY ALL HAVING sum(greatest(0, volume - 5)) > 1e-9""")
def planning_demand(spark, sf):
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return rollups.planning_demand(V.demand_log(spark, sf).withColumn("volume", F.col("volume") - 5).withColumn("order_key", key).withColumn("demand_id", key))


@query("positive_demand", "SELECT demand_id, greatest(0, volume - 20000) AS volume FROM demands WHERE greatest(0, volume - 20000) > 1e-9")
def positive_demand(spark, sf):
    return V.demands(spark, sf).select("demand_id", F.greatest(F.lit(0.0), F.col("volume") - 20000).alias("volume")).where("volume > 1e-9")


@query("hub_day_raw_load", """
    SELECT hub, day, load, handling, load - handling AS excess FROM (
      SELECT hub, day, sum(volume) AS load FROM (SELECT source AS hub, day, volume FROM demands UNION ALL SELECT destination, day, volume FROM demands) GROUP BY ALL)
    JOIN hub_capacity USING (hub) WHERE load > handling""".replace("SELECT hub, day, load, handling,", "SELECT hub, day, load, handling,"))
def hub_day_raw_load(spark, sf):
    return rollups.hub_day_raw_load(V.demands(spark, sf), V.hub_capacity(spark, sf))


@query("daily_totals", """
    SELECT date, predicted, actual, CASE WHEN actual > 0 THEN round(round((predicted - actual) / actual * 100, 9), 4) END AS difference_pct
    FROM (SELECT date, round(sum(q50), 6) AS predicted, sum(y) AS actual FROM predictions GROUP BY date)""")
def daily_totals(spark, sf):
    return rollups.daily_totals(V.predictions(spark, sf)).select("date", "predicted", "actual", R(R("difference_pct", 9), 4).alias("difference_pct"))


@query("reference_level", """
    SELECT lane, round(avg(volume_0900), 6) AS reference FROM (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY date DESC) AS back FROM lane_day) WHERE back <= 7 GROUP BY lane""")
def reference_level(spark, sf):
    return rollups.reference_level(V.lane_day(spark, sf), "volume_0900").withColumn("reference", R("reference"))


@query("iqr_upper", """
    SELECT lane, round(quantile_cont(volume_0900, 0.75) + 3 * (quantile_cont(volume_0900, 0.75) - quantile_cont(volume_0900, 0.25)), 6) AS upper FROM lane_day GROUP BY lane""")
def iqr_upper(spark, sf):
    return rollups.iqr_upper(V.lane_day(spark, sf), "volume_0900").withColumn("upper", R("upper"))


@query("clip_outliers", """
    WITH u AS (SELECT lane, quantile_cont(volume_0900, 0.75) + 3 * (quantile_cont(volume_0900, 0.75) - quantile_cont(volume_0900, 0.25)) AS upper FROM lane_day GROUP BY lane)
    SELECT lane, date, round(greatest(0, least(volume_0900, upper)), 6) AS volume_0900 FROM lane_day JOIN u USING (lane)""")
def clip_outliers(spark, sf):
    days = V.lane_day(spark, sf)
    upper = F.broadcast(rollups.iqr_upper(days, "volume_0900"))  # one row a lane
    clipped = F.greatest(F.lit(0.0), F.least("volume_0900", F.coalesce("upper", "volume_0900")))
    return days.join(upper, "lane", "left").select("lane", "date", R(clipped).alias("volume_0900"))


@query("abnormal_weeks", """
    WITH w AS (SELECT year(date) AS year, weekofyear(date) AS week, avg(volume_0900) AS mean FROM lane_day WHERE volume_0900 > 0 GROUP BY ALL)
    SELECT CAST(year AS INTEGER) AS year, CAST(week AS INTEGER) AS week, round(mean, 6) AS mean FROM w WHERE mean > 1.1 * (SELECT avg(mean) FROM w)""")
def abnormal_weeks(spark, sf):
    return rollups.abnormal_weeks(V.lane_day(spark, sf), "volume_0900", 1.1).withColumn("mean", R("mean"))


@query("lane_bias", """
    WITH w AS (SELECT lane, pow(0.5, date_diff('day', date, (SELECT max(date) FROM predictions)) / 21.0) AS w, q50, y FROM predictions),
    m AS (SELECT sum(w * q50) / sum(w) AS mean FROM w)
    SELECT lane, round(sum(w), 5) AS n, round(least(1.8, greatest(0.7, (sum(w * y) + 10 * any_value(mean)) / (sum(w * q50) + 10 * any_value(mean)))), 5) AS ratio
    FROM w CROSS JOIN m GROUP BY lane HAVING sum(w) >= 8""")
def lane_bias(spark, sf):
    return rollups.weighted_bias(V.predictions(spark, sf), ["lane"]).select("lane", R("n", 5).alias("n"), R("ratio", 5).alias("ratio"))


#: Prior rows, bounds and least weight of the three kinds of days.
BUCKETS = [("sunday", 0.4, 0.3, 1.2, 1.8), ("event", 6.0, 0.5, 2.5, 4.0), ("normal", 6.0, 0.7, 1.8, 4.0)]
BUCKET_SQL = "CASE WHEN isodow(date) = 7 THEN 'sunday' WHEN day(date) <= 3 THEN 'event' ELSE 'normal' END"


def bucketed(spark, sf):
    bucket = F.when(F.weekday("date") == 6, "sunday").when(F.dayofmonth("date") <= 3, "event").otherwise("normal")
    return V.predictions(spark, sf).withColumn("bucket", bucket)


def bias_sql(columns: str) -> str:
    limits = ", ".join(f"('{b}', CAST({p} AS DOUBLE), CAST({lo} AS DOUBLE), CAST({hi} AS DOUBLE), CAST({n} AS DOUBLE))" for b, p, lo, hi, n in BUCKETS)
    return f"""
    WITH limits AS (SELECT * FROM (VALUES {limits}) t(bucket, prior, low, high, least_n)),
    w AS (SELECT lane, {BUCKET_SQL} AS bucket, pow(0.5, date_diff('day', date, (SELECT max(date) FROM predictions)) / 21.0) AS w, q50, y FROM predictions),
    m AS (SELECT sum(w * q50) / sum(w) AS mean FROM w),
    s AS (SELECT lane, bucket, sum(w) AS n, sum(w * q50) AS p, sum(w * y) AS a FROM w GROUP BY ALL)
    SELECT {columns} FROM (SELECT *, least(high, greatest(low, (a + prior * mean) / (p + prior * mean))) AS ratio FROM s JOIN limits USING (bucket) CROSS JOIN m WHERE n >= least_n)"""


@query("lane_bucket_bias", bias_sql("lane, bucket, round(n, 5) AS n, round(ratio, 5) AS ratio"))
def lane_bucket_bias(spark, sf):
    limits = spark.createDataFrame(BUCKETS, "bucket string, prior double, low double, high double, least_n double")
    return rollups.bucket_bias(bucketed(spark, sf), limits).select("lane", "bucket", R("n", 5).alias("n"), R("ratio", 5).alias("ratio"))


@query("bias_diagnosis", bias_sql("lane, bucket, round(a / nullif(p, 0), 5) AS raw, round(ratio, 5) AS ratio, ratio = low OR ratio = high AS at_cap"))
def bias_diagnosis(spark, sf):
    limits = spark.createDataFrame(BUCKETS, "bucket string, prior double, low double, high double, least_n double")
    return rollups.bucket_bias(bucketed(spark, sf), limits).select("lane", "bucket", R("raw", 5).alias("raw"), R("ratio", 5).alias("ratio"), "at_cap")


@query("threshold_report", """
    WITH v AS (SELECT q50 / (q90 + 1) AS x FROM predictions),
    s AS (SELECT count(x) AS n, min(x) AS least, max(x) AS most, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.75) AS p75, quantile_cont(x, 0.9) AS p90, quantile_cont(x, 0.95) AS p95 FROM v)
    SELECT n, round(least, 6) AS least, round(most, 6) AS most, round(p50, 6) AS p50, round(p75, 6) AS p75, round(p90, 6) AS p90, round(p95, 6) AS p95, threshold, (SELECT count(*) FROM v WHERE x > threshold) AS n_over
    FROM s, (SELECT CAST(unnest([0.2, 0.35, 0.5]) AS DOUBLE) AS threshold)""")
def threshold_report(spark, sf):
    out = rollups.threshold_report(V.predictions(spark, sf).withColumn("x", F.col("q50") / (F.col("q90") + 1)), "x", (0.2, 0.35, 0.5))
    return out.select("n", *(R(c).alias(c) for c in ("least", "most", "p50", "p75", "p90", "p95")), "threshold", "n_over")


@query("skewness_report", """
    WITH p AS (SELECT lane, volume_0900 AS x, ln(1 + volume_0900) AS z FROM lane_day WHERE volume_0900 > 0),
    m AS (SELECT lane, avg(x) AS a, avg(z) AS b FROM p GROUP BY lane)
    SELECT lane, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, median(x) AS median,
           round(avg(pow(x - a, 3)) / pow(avg(pow(x - a, 2)), 1.5), 5) AS skew, round(avg(pow(x - a, 4)) / pow(avg(pow(x - a, 2)), 2) - 3, 5) AS kurtosis,
           round(avg(pow(z - b, 3)) / pow(avg(pow(z - b, 2)), 1.5), 5) AS log_skew
    FROM p JOIN m USING (lane) GROUP BY lane""")
def skewness_report(spark, sf):
    m = rollups.moments(V.lane_day(spark, sf), ["lane"], "volume_0900")
    return m.select("lane", "n", R("mean").alias("mean"), R("sd").alias("sd"), "median", *(R(c, 5).alias(c) for c in ("skew", "kurtosis", "log_skew")))


@query("campaign_multiplier", """
    WITH d AS (SELECT lane, volume_0900 AS x, CASE WHEN (month(date) = 2 AND day(date) BETWEEN 11 AND 13) OR (month(date) = 11 AND day(date) BETWEEN 8 AND 10) THEN 1 ELSE 0 END AS eve FROM lane_day),
    o AS (SELECT avg(x) AS overall FROM d),
    g AS (SELECT lane, avg(x) FILTER (eve = 1) AS e, avg(x) FILTER (eve = 0) AS n FROM d GROUP BY lane)
    SELECT lane, round(least(1.5, greatest(1, (e + 0.5 * overall) / (n + 0.5 * overall))), 6) AS multiplier FROM g, o WHERE e IS NOT NULL AND n IS NOT NULL""")
def campaign_multiplier(spark, sf):
    m, d = F.month("date"), F.dayofmonth("date")
    eve = ((m == 2) & d.between(11, 13)) | ((m == 11) & d.between(8, 10))
    return rollups.campaign_multiplier(V.lane_day(spark, sf).withColumn("eve", eve.cast("int")), "eve", "volume_0900").withColumn("multiplier", R("multiplier"))


@query("regret_capacity", """
    WITH p AS (SELECT lane, volume_0900 AS x FROM lane_day WHERE volume_0900 > 0)
    SELECT l.lane, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) >= 5 THEN own ELSE (SELECT quantile_cont(x, 0.9) FROM p) END AS capacity
    FROM (SELECT DISTINCT lane FROM lane_day) l LEFT JOIN (SELECT lane, count(*) AS n, quantile_cont(x, 0.9) AS own FROM p GROUP BY lane) USING (lane)""".replace("SELECT l.lane", "SELECT lane"))
def regret_capacity(spark, sf):
    return rollups.regret_capacity(V.lane_day(spark, sf), "volume_0900")


@query("missing_report", """
    SELECT unnest(['doc_id', 'quality', 'toxic', 'text']) AS column_name, unnest([count(*) - count(doc_id), count(*) - count(quality), count(*) - count(toxic), count(*) - count(text)]) AS nulls
    FROM (SELECT d.doc_id, l.quality, l.toxic, d.text FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""")
def missing_report(spark, sf):
    return rollups.missing_report(V.table(spark, sf, "documents").select("doc_id", "text").join(V.table(spark, sf, "labels"), "doc_id", "left").select("doc_id", "quality", "toxic", "text"))


@query("drop_incomplete", "SELECT d.doc_id, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL AND d.doc_id IS NOT NULL")
def drop_incomplete(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id").join(V.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left").na.drop()


@query("gamma_from_costs", """
    WITH r AS (SELECT s_nationkey % 4 AS k, avg(s_acctbal) AS idle FROM supplier GROUP BY ALL), v AS (SELECT n_nationkey % 4 AS k, count(*) * 1000.0 AS capacity, 9000.0 AS spot FROM nation GROUP BY ALL)
    SELECT round(sum((spot / idle - 1) * capacity) / sum(capacity), 6) AS gamma FROM r JOIN v USING (k)""")
def gamma_from_costs(spark, sf):
    idle = V.table(spark, sf, "supplier").groupBy((F.col("s_nationkey") % 4).alias("k")).agg(F.avg("s_acctbal").alias("idle_hourly"))
    size = V.table(spark, sf, "nation").groupBy((F.col("n_nationkey") % 4).alias("k")).agg((F.count("*") * 1000.0).alias("capacity"), F.lit(9000.0).alias("spot_hourly"))
    return rollups.gamma_from_costs(idle.join(size, "k")).select(R("gamma").alias("gamma"))


@query("lane_attributes", "SELECT d.date, d.slot, d.volume, d.source, d.dest, l.distance_km, l.target_days FROM demand_log d LEFT JOIN lanes l ON d.source = l.source AND d.dest = l.destination")
def lane_attributes(spark, sf):
    lanes = F.broadcast(V.lanes(spark, sf).withColumnRenamed("destination", "dest"))  # 600 rows
    return V.demand_log(spark, sf).join(lanes, ["source", "dest"], "left").select("date", "slot", "volume", "source", "dest", "distance_km", "target_days")


@query("capacity_enrich", "SELECT d.source, d.dest, d.date, d.volume, h.handling, h.handling IS NOT NULL AS has_capacity FROM demand_log d LEFT JOIN (SELECT * FROM hub_capacity WHERE trucks > 6) h ON d.source = h.hub")
def capacity_enrich(spark, sf):
    hubs = F.broadcast(V.hub_capacity(spark, sf).where("trucks > 6").dropDuplicates(["hub"]).select(F.col("hub").alias("source"), "handling"))
    return V.demand_log(spark, sf).select("source", "dest", "date", "volume").join(hubs, "source", "left").withColumn("has_capacity", F.col("handling").isNotNull())


@query("lane_target_days", "SELECT d.demand_id, coalesce(CAST(l.target_days AS VARCHAR), 'LANE_NOT_IN_MATRIX') AS status FROM demands d LEFT JOIN (SELECT * FROM lanes WHERE distance_km < 900) l ON d.source = l.source AND d.destination = l.destination")
def lane_target_days(spark, sf):
    lanes = F.broadcast(V.lanes(spark, sf).where("distance_km < 900").select("source", "destination", "target_days"))
    return V.demands(spark, sf).join(lanes, ["source", "destination"], "left").select("demand_id", F.coalesce(F.col("target_days").cast("string"), F.lit("LANE_NOT_IN_MATRIX")).alias("status"))


@query("vehicle_type_expand", "SELECT source, destination, vehicle_type, capacity FROM lane_vehicle")
def vehicle_type_expand(spark, sf):
    return V.lane_vehicle(spark, sf).select("source", "destination", "vehicle_type", "capacity")


@query("travel_lookup", "SELECT d.demand_id, v.vehicle_type, v.hours FROM demands d JOIN lane_vehicle v ON d.source = v.source AND d.destination = v.destination WHERE v.vehicle_type = 'Kamyonet'")
def travel_lookup(spark, sf):
    hours = F.broadcast(V.lane_vehicle(spark, sf).where("vehicle_type = 'Kamyonet'").select("source", "destination", "vehicle_type", "hours"))
    return V.demands(spark, sf).join(hours, ["source", "destination"]).select("demand_id", "vehicle_type", "hours")


@query("bias_lookup", f"""
    WITH b AS ({bias_sql("lane, bucket, ratio").strip()}), l AS (SELECT lane, 1.25 AS ratio FROM lane_day GROUP BY lane HAVING sum(volume_0900) > 5000)
    SELECT p.lane, p.date, round(coalesce(b.ratio, l.ratio, 1), 5) AS ratio
    FROM (SELECT *, {BUCKET_SQL} AS bucket FROM predictions) p LEFT JOIN b ON b.lane = p.lane AND b.bucket = p.bucket AND b.ratio > 1 LEFT JOIN l ON l.lane = p.lane""")
def bias_lookup(spark, sf):
    """The ratio of lane and bucket, else of the lane, else 1."""
    rows = bucketed(spark, sf)
    limits = spark.createDataFrame(BUCKETS, "bucket string, prior double, low double, high double, least_n double")
    both = rollups.bucket_bias(rows, limits).where("ratio > 1").select("lane", "bucket", F.col("ratio").alias("own"))
    lane = V.lane_day(spark, sf).groupBy("lane").agg(F.sum("volume_0900").alias("v")).where("v > 5000").select("lane", F.lit(1.25).alias("of_lane"))
    out = rows.join(F.broadcast(both), ["lane", "bucket"], "left").join(F.broadcast(lane), "lane", "left")
    return out.select("lane", "date", R(F.coalesce("own", "of_lane", F.lit(1.0)), 5).alias("ratio"))


@query("slot_union", "SELECT lane, date, '09:00' AS slot, volume_0900 AS volume FROM lane_day UNION ALL SELECT lane, date, '17:00', volume_1700 FROM lane_day")
def slot_union(spark, sf):
    d = V.lane_day(spark, sf)
    return d.select("lane", "date", F.lit("09:00").alias("slot"), F.col("volume_0900").alias("volume")).unionByName(d.select("lane", "date", F.lit("17:00").alias("slot"), F.col("volume_1700").alias("volume")))


@query("hub_set_union", "SELECT hub FROM hub_capacity UNION SELECT source FROM rentals UNION SELECT destination FROM rentals")
def hub_set_union(spark, sf):
    r = V.rentals(spark, sf)
    return V.hub_capacity(spark, sf).select("hub").union(r.select("source")).union(r.select("destination")).distinct()


@query("horizon_extension", "SELECT DISTINCT CAST(day AS DATE) AS day FROM (SELECT day FROM demands UNION ALL SELECT max(day) + CAST(1 AS INTEGER) FROM demands UNION ALL SELECT max(day) + CAST(2 AS INTEGER) FROM demands)")
def horizon_extension(spark, sf):
    days = V.demands(spark, sf).select("day").distinct()
    last = days.agg(F.max("day").alias("day"))
    return days.union(last.select(F.explode(F.array(F.date_add("day", 1), F.date_add("day", 2))))).distinct()


@query("context_union", """
    SELECT lane, date, volume_0900, CAST(NULL AS BOOLEAN) AS ahead FROM (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY date DESC) AS back FROM lane_day) WHERE back <= 44
    UNION ALL SELECT DISTINCT lane, CAST(m + CAST(k AS INTEGER) AS DATE), 0.0, TRUE FROM lane_day, (SELECT max(date) AS m FROM lane_day), (SELECT unnest([1, 2, 3, 4, 5, 6, 7]) AS k)""")
def context_union(spark, sf):
    """The last 44 days of each lane and seven days ahead of them."""
    d = V.lane_day(spark, sf)
    back = F.row_number().over(Window.partitionBy("lane").orderBy(F.col("date").desc()))
    tail = d.withColumn("back", back).where("back <= 44").select("lane", "date", "volume_0900")
    last = d.agg(F.max("date").alias("m"))
    ahead = d.select("lane").distinct().crossJoin(F.broadcast(last)).select("lane", F.explode(F.sequence(F.date_add("m", 1), F.date_add("m", 7))).alias("date"), F.lit(0.0).alias("volume_0900"), F.lit(True).alias("ahead"))
    return tail.unionByName(ahead, allowMissingColumns=True)


@query("contract_calendar", """
    WITH days AS (SELECT DISTINCT day FROM demands), used AS (SELECT source, destination, day, sum(volume) AS volume FROM demands GROUP BY ALL)
    SELECT r.source, r.destination, d.day, r.vehicle_count, coalesce(u.volume, 0) AS volume
    FROM rentals r CROSS JOIN days d LEFT JOIN used u ON u.source = r.source AND u.destination = r.destination AND u.day = d.day""")
def contract_calendar(spark, sf):
    demands = V.demands(spark, sf)
    used = demands.groupBy("source", "destination", "day").agg(F.sum("volume").alias("volume"))
    every = F.broadcast(V.rentals(spark, sf)).crossJoin(demands.select("day").distinct())
    return every.join(used, ["source", "destination", "day"], "left").select("source", "destination", "day", "vehicle_count", F.coalesce("volume", F.lit(0.0)).alias("volume"))


@query("off_contract", "SELECT DISTINCT source, destination FROM demands d WHERE NOT EXISTS (SELECT 1 FROM rentals r WHERE r.source = d.source AND r.destination = d.destination)")
def off_contract(spark, sf):
    return V.demands(spark, sf).select("source", "destination").distinct().join(F.broadcast(V.rentals(spark, sf)), ["source", "destination"], "left_anti")


@query("forecast_vs_actual", "SELECT p.lane, p.date, round(p.q50, 6) AS q50, a.volume_1700 AS other FROM predictions p JOIN lane_day a ON a.lane = p.lane AND a.date = p.date WHERE a.volume_1700 > 0")
def forecast_vs_actual(spark, sf):
    actual = V.lane_day(spark, sf).select("lane", "date", F.col("volume_1700").alias("other")).where("other > 0")
    return V.predictions(spark, sf).select("lane", "date", R("q50").alias("q50")).join(actual, ["lane", "date"])


@query("inject_same_day_0900", """
    SELECT d.lane, d.date, round(CASE WHEN d.date >= '2001-01-01' THEN coalesce(p.q50, d.volume_0900) ELSE d.volume_0900 END, 6) AS cross_lag
    FROM lane_day d LEFT JOIN predictions p ON p.lane = d.lane AND p.date = d.date""")
def inject_same_day_0900(spark, sf):
    p = V.predictions(spark, sf).select("lane", "date", "q50").where("date >= '2001-01-01'")
    return V.lane_day(spark, sf).join(p, ["lane", "date"], "left").select("lane", "date", R(F.coalesce("q50", "volume_0900")).alias("cross_lag"))
