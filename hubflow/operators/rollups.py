"""Aggregations of demand, forecasts and costs. Each takes and returns a DataFrame."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hubflow.operators.selection import percentiles, summarised
from hubflow.session import cut_lineage, release


def lane_total(log: DataFrame) -> DataFrame:
    return log.groupBy("source", "dest").agg(F.sum("volume").alias("volume"), F.count("*").alias("n"))


def planning_demand(bands: DataFrame) -> DataFrame:
    """Volume of each lane, day and slot, negative volumes as 0, and the last demand id in order of order_key; without volume no row."""
    d = bands.withColumn("volume", F.greatest(F.lit(0.0), "volume"))
    return d.groupBy("source", "dest", "date", "slot").agg(F.sum("volume").alias("volume"), F.max_by("demand_id", "order_key").alias("demand_id")).where("volume > 1e-9")


def hub_day_raw_load(demands: DataFrame, capacity: DataFrame) -> DataFrame:
    """Hub-days whose demand, counted at both ends, is over the handling capacity. Each row is doubled before a partial sum."""
    ends = demands.select(F.explode(F.array("source", "destination")).alias("hub"), "day", "volume")
    load = ends.groupBy("hub", "day").agg(F.sum("volume").alias("load"))
    return load.join(F.broadcast(capacity.select("hub", "handling")), "hub").where("load > handling").select("hub", "day", "load", "handling", (F.col("load") - F.col("handling")).alias("excess"))


def daily_totals(rows: DataFrame) -> DataFrame:
    """Predicted (to 6 digits) and actual volume of each day and the signed difference in percent (null where nothing came), in one pass."""
    out = rows.groupBy("date").agg(F.round(F.coalesce(F.sum("q50"), F.lit(0.0)), 6).alias("predicted"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("actual"))
    return out.withColumn("difference_pct", F.when(F.col("actual") > 0, (F.col("predicted") - F.col("actual")) / F.col("actual") * 100))


def campaign_multiplier(days: DataFrame, flag: str, value: str, smooth: float = 0.5, most: float = 1.5) -> DataFrame:
    """By lane: how much higher flagged days are than others, both drawn to the overall mean; only lanes with both kinds of days."""
    overall = days.agg(F.avg(value).alias("overall"))
    by = days.groupBy("lane").agg(F.avg(F.when(F.col(flag) == 1, F.col(value))).alias("eve"), F.avg(F.when(F.col(flag) == 0, F.col(value))).alias("normal"))
    pull = F.lit(smooth) * F.col("overall")
    ratio = (F.col("eve") + pull) / (F.col("normal") + pull)
    return by.where("eve is not null and normal is not null").crossJoin(F.broadcast(overall)).select("lane", F.least(F.lit(most), F.greatest(F.lit(1.0), ratio)).alias("multiplier"))


def iqr_upper(days: DataFrame, value: str, k: float = 3.0) -> DataFrame:
    """Third quartile plus k times the distance between quartiles, by lane."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.75)))
    return days.groupBy("lane").agg(q.alias("q")).select("lane", (F.col("q")[1] + k * (F.col("q")[1] - F.col("q")[0])).alias("upper"))


def weighted_bias(residuals: DataFrame, keys: list[str], half_life: float = 21.0, prior: float = 10.0, low: float = 0.7, high: float = 1.8, least_n: float = 8.0) -> DataFrame:
    """keys, n, ratio: actual over predicted with weights that halve every half_life days, drawn to 1 by prior rows of the overall mean prediction, within [low, high]; groups of a weight under least_n are left out."""
    last = residuals.agg(F.max("date").alias("last"))
    w = residuals.crossJoin(F.broadcast(last)).withColumn("w", F.pow(F.lit(0.5), F.datediff("last", "date") / half_life))
    mean = w.agg((F.sum(F.col("w") * F.col("q50")) / F.sum("w")).alias("mean"))
    by = w.groupBy(*keys).agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("q50")).alias("p"), F.sum(F.col("w") * F.col("y")).alias("a"))
    pull = F.lit(prior) * F.col("mean")
    ratio = F.try_divide(F.col("a") + pull, F.col("p") + pull)
    return by.where(F.col("n") >= least_n).crossJoin(F.broadcast(mean)).select(*keys, "n", F.least(F.lit(high), F.greatest(F.lit(low), ratio)).alias("ratio"))


def bucket_bias(residuals: DataFrame, limits: DataFrame, half_life: float = 21.0) -> DataFrame:
    """weighted_bias by lane and bucket, with each bucket's own prior, bounds and least weight from limits (bucket, prior, low, high, least_n)."""
    last = residuals.agg(F.max("date").alias("last"))
    w = residuals.crossJoin(F.broadcast(last)).withColumn("w", F.pow(F.lit(0.5), F.datediff("last", "date") / half_life))
    mean = w.agg((F.sum(F.col("w") * F.col("q50")) / F.sum("w")).alias("mean"))
    by = w.groupBy("lane", "bucket").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("q50")).alias("p"), F.sum(F.col("w") * F.col("y")).alias("a"))
    pull = F.col("prior") * F.col("mean")
    raw = F.try_divide("a", "p")
    shrunk = F.try_divide(F.col("a") + pull, F.col("p") + pull)
    out = by.join(F.broadcast(limits), "bucket").where("n >= least_n").crossJoin(F.broadcast(mean))
    ratio = F.least("high", F.greatest("low", shrunk))
    return out.select("lane", "bucket", "n", raw.alias("raw"), ratio.alias("ratio"), ((ratio == F.col("low")) | (ratio == F.col("high"))).alias("at_cap"))


def abnormal_weeks(days: DataFrame, value: str, over: float = 1.4) -> DataFrame:
    """Calendar year and ISO week whose mean positive volume is over so many times the mean of all weeks' means."""
    weeks = days.where(F.col(value) > 0).groupBy(F.year("date").alias("year"), F.weekofyear("date").alias("week")).agg(F.avg(value).alias("mean"))
    return weeks.crossJoin(F.broadcast(weeks.agg(F.avg("mean").alias("overall")))).where(F.col("mean") > over * F.col("overall")).select("year", "week", "mean")


def threshold_report(rows: DataFrame, value: str, thresholds: tuple[float, ...]) -> DataFrame:
    """For each threshold how many rows reach it, and percentiles of the value."""
    hits = F.array(*(F.struct(F.lit(t).alias("threshold"), F.count_if(F.col(value) > t).alias("n_over")) for t in thresholds))
    counts = [F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), hits.alias("hits")]
    one = summarised(rows.select(value), [], counts, value, [0.5, 0.75, 0.9, 0.95], "thresholds")
    return one.select("n", "least", "most", *(F.col("p")[i].alias(f"p{x}") for i, x in enumerate((50, 75, 90, 95))), F.inline("hits"))


def moments(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, deviation, median, skewness and excess kurtosis (both of the population) of positive values, and the skewness of their logarithms."""
    return rows.where(F.col(value) > 0).groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.median(value).alias("median"),
        F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurtosis"), F.skewness(F.log1p(value)).alias("log_skew"),
    )


def risk_params(bands: DataFrame, keys: list[str]) -> DataFrame:
    """floor, scale, tau for the risk score, from the distribution of forecasts; 5000 where there are none over 1."""
    ratio = (F.col("q90") - F.col("q10")) / F.greatest("q50", F.lit(1.0))
    b = cut_lineage(bands.select(*keys, "q50", ratio.alias("ratio")), "risk-bands")
    first = percentiles(b, keys, F.when(F.col("q50") > 1, F.col("q50")), [0.1, 0.25, 0.5])
    floor = F.when(F.col("p").isNotNull(), F.greatest(F.col("p")[1], F.greatest(F.lit(50.0), 0.1 * F.col("p")[2])))
    first = first.select(*keys, F.col("p")[0].alias("p10"), floor.alias("floor"))
    second = percentiles(b.join(F.broadcast(first), keys).where(F.col("q50") > F.col("p10")), keys, "ratio", [0.5]).select(*keys, F.col("p")[0].alias("scale"))
    bounded = F.lit(2 / 3.141592653589793) * F.atan(F.greatest("ratio", F.lit(0.0)) / F.col("scale"))
    third = percentiles(b.join(F.broadcast(second), keys), keys, F.when(F.col("scale") > 0, bounded).otherwise(1.0), [0.5]).select(*keys, F.col("p")[0].alias("tau"))
    release(b)
    return first.join(second, keys, "left").join(third, keys, "left").select(*keys, F.coalesce("floor", F.lit(5000.0)).alias("floor"), "scale", "tau")


def reference_level(days: DataFrame, value: str, n: int = 7) -> DataFrame:
    """Mean of each lane's last n days."""
    last = F.row_number().over(Window.partitionBy("lane").orderBy(F.col("date").desc()))
    return days.withColumn("back", last).where(F.col("back") <= n).groupBy("lane").agg(F.avg(value).alias("reference"))


def regret_capacity(days: DataFrame, value: str, least_n: int = 5) -> DataFrame:
    """90th percentile by lane; over all lanes where a lane has fewer than least_n positive days."""
    positive = cut_lineage(days.where(F.col(value) > 0).select(value), "positive-days")
    overall = percentiles(positive, [], value, [0.9]).select(F.col("p")[0].alias("overall"))
    release(positive)
    by = days.groupBy("lane").agg(F.count_if(F.col(value) > 0).alias("n"), F.percentile(F.when(F.col(value) > 0, F.col(value)), 0.9).alias("own"))
    return by.crossJoin(F.broadcast(overall)).select("lane", "n", F.when(F.col("n") >= least_n, F.col("own")).otherwise(F.col("overall")).alias("capacity"))


def missing_report(rows: DataFrame) -> DataFrame:
    """A row for each column with its nulls, in one pass."""
    counts = rows.agg(*(F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in rows.columns))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("nulls")) for c in rows.columns))))


def gamma_from_costs(vehicles: DataFrame, idle: str = "idle_hourly", spot: str = "spot_hourly", fallback: float = 0.5988) -> DataFrame:
    """Capacity-weighted mean of spot over idle rate less 1; unweighted without capacity, and a fallback without rates."""
    g = F.try_divide(F.col(spot), F.col(idle)) - 1
    weighted = F.try_divide(F.sum(g * F.col("capacity")), F.sum(F.when(g.isNotNull(), F.col("capacity"))))
    return vehicles.agg(F.coalesce(weighted, F.avg(g), F.lit(fallback)).alias("gamma"))


def deferred_ids(legs: DataFrame, keys: list[str]) -> DataFrame:
    """Volume, and the distinct ids and kinds as text, of each group of legs."""
    ids = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ", ")
    return legs.groupBy(*keys).agg(F.sum("volume").alias("volume"), ids("slot").alias("slots"), F.count("*").alias("n"))
