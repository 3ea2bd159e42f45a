"""Scores of forecasts: actual y against q50, with the band q10 to q90."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hubflow.operators.selection import percentiles, summarised
from hubflow.session import cut_lineage, release

E = lambda: F.col("y") - F.col("q50")


def wape():
    return F.coalesce(F.try_divide(F.sum(F.abs(E())), F.sum("y")), F.lit(0.0))


def pinball(tau: float, column: str):
    d = F.col("y") - F.col(column)
    return F.avg(F.greatest(tau * d, (tau - 1) * d))


def decision_regret(under: float = 9.0, over: float = 1.0):
    return F.avg(F.when(E() > 0, under * E()).otherwise(-over * E()))


def spot_cost(column: str, under: float = 1.0, over: float = 0.2):
    d = F.col("y") - F.col(column)
    return F.sum(F.greatest(d, F.lit(0.0)) * under + F.greatest(-d, F.lit(0.0)) * over)


def metrics() -> dict:
    return {
        "n": F.count("*"), "wape": wape(), "mae": F.avg(F.abs(E())), "rmse": F.sqrt(F.avg(E() * E())), "pinball_10": pinball(0.1, "q10"), "pinball_50": pinball(0.5, "q50"), "pinball_90": pinball(0.9, "q90"),
        "regret": decision_regret(), "coverage": F.avg((F.col("y").between(F.col("q10"), F.col("q90"))).cast("double")), "spot_q50": spot_cost("q50"), "spot_q90": spot_cost("q90"),
    }


def evaluate(rows: DataFrame, *keys: str) -> DataFrame:
    """All metrics in one pass, over all rows or by keys."""
    found = [v.alias(k) for k, v in metrics().items()]
    out = (rows.groupBy(*keys) if keys else rows).agg(*found)
    return out.withColumn("spot_saving", F.col("spot_q50") - F.col("spot_q90"))


def hybrid_score(rows: DataFrame, gamma: float = 0.5988, *keys: str) -> DataFrame:
    """WAPE, share of under-prediction, relative width and share of crossed bands, and their weighted sum."""
    total = F.sum("y")
    under = F.coalesce(F.try_divide(F.sum(F.greatest(E(), F.lit(0.0))), total), F.lit(0.0))
    width = F.coalesce(F.try_divide(F.sum(F.col("q90") - F.col("q10")), F.sum("q50")), F.lit(0.0))
    crossing = F.avg(((F.col("q10") > F.col("q50")) | (F.col("q50") > F.col("q90"))).cast("double"))
    g = rows.groupBy(*keys) if keys else rows
    out = g.agg(wape().alias("wape"), under.alias("under_rate"), width.alias("width"), crossing.alias("crossing"))
    return out.withColumn("hybrid", F.col("wape") + gamma * F.col("under_rate") + 0.03 * F.col("width") + 0.10 * F.col("crossing"))


def lane_errors(rows: DataFrame, bias: float = 15.0) -> DataFrame:
    pct = F.coalesce(F.try_divide(F.sum(-E()), F.sum("y")), F.lit(0.0)) * 100
    out = rows.groupBy("lane").agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.sum("y").alias("total"), wape().alias("wape"), decision_regret().alias("regret"), pct.alias("bias_pct"))
    kind = F.when(F.col("bias_pct") > bias, "over").when(F.col("bias_pct") < -bias, "under").otherwise("balanced")
    return out.withColumn("direction", kind).withColumn("shrink", F.col("n") / (F.col("n") + 30))


def binned(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """bin of each row by quantiles of value: right-closed, the lowest edge in the first bin, equal edges as one."""
    values = cut_lineage(rows.select(F.col(value)), "binned-values")
    found = percentiles(values, [], value, [i / bins for i in range(1, bins)])
    release(values)
    one = F.broadcast(found.select(F.array_distinct("p").alias("_edges")))
    return rows.crossJoin(one).withColumn("bin", F.size(F.filter("_edges", lambda e: e < F.col(value)))).drop("_edges")


def _percent_errors(rows: DataFrame, key: str, aggregates: list) -> DataFrame:
    """aggregates over y, q50 and pct, the error in percent where y > 0, by key, with pct's median."""
    d = rows.withColumn("pct", F.when(F.col("y") > 0, (F.col("q50") - F.col("y")) / F.col("y") * 100)).select(key, "y", "q50", "pct")
    return summarised(d, [key], aggregates, "pct", [0.5], f"errors-by-{key}").withColumn("median_pct", F.col("p")[0]).drop("p")


def bin_errors(rows: DataFrame) -> DataFrame:
    return _percent_errors(rows, "bin", [F.count("*").alias("n"), F.avg("pct").alias("mean_pct"), F.sum(F.greatest(-E(), F.lit(0.0))).alias("over")])


def weekday_errors(rows: DataFrame, low: float = 60.0, high: float = 1200.0) -> DataFrame:
    d = rows.where((F.col("q50") >= low) & (F.col("q50") < high)).withColumn("weekday", F.weekday("date"))
    sums = [F.sum(F.greatest(E(), F.lit(0.0))).alias("under"), F.sum(F.greatest(-E(), F.lit(0.0))).alias("over"), decision_regret().alias("regret")]
    return _percent_errors(d, "weekday", [F.count("*").alias("n"), F.count_if(E() > 0).alias("n_under"), F.count_if(E() < 0).alias("n_over"), *sums])


def ids_in_order(bands: DataFrame) -> DataFrame:
    """demand_id D00001, D00002, ... in order of date, slot and lane: a number in each date plus the rows of all dates before, so no window holds all rows."""
    counts = bands.groupBy("date").agg(F.count("*").alias("_n"))
    before = counts.select("date", F.coalesce(F.sum("_n").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    here = F.row_number().over(Window.partitionBy("date").orderBy("slot", "lane"))
    d = bands.withColumn("_here", here).join(F.broadcast(before), "date")  # one row a date
    return d.withColumn("demand_id", F.format_string("D%05d", F.col("_before") + F.col("_here"))).drop("_here", "_before")
