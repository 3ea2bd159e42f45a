"""Queries: splits, models, corrections and forecasts. Models have no SQL twin."""

from datetime import timedelta

from pyspark.sql import functions as F

from hubflow import adapters as V
from hubflow.catalog import query
from hubflow.operators import calendar, forecast, forecaster, grid, quantiles, scores
from hubflow.plans.windows import FIRST, LAST
from hubflow.session import cut_lineage, release

X = "volume_0900"
R = lambda c, n=6: F.round(c, n).alias(c)


def tables(spark):
    return calendar.holiday_days(spark, FIRST, LAST + 1), calendar.campaign_days(spark, FIRST, LAST + 1)


def lane_days(spark, sf):
    """V.lane_day written as a table (a row a lane and day): what learns from it or looks back on it reads it several times, the log once."""
    volumes = cut_lineage(grid.demand_rollup(V.region_log(spark, sf)), "lane-volumes")
    days = cut_lineage(grid.dense_lane_days(volumes), "lane-days")
    release(volumes)
    return days


@query("chrono_split", "WITH d AS (SELECT date, row_number() OVER (ORDER BY date) AS n, count(*) OVER () AS c FROM (SELECT DISTINCT date FROM lane_day)) SELECT lane, date, n <= floor(c * 0.8) AS is_train FROM lane_day JOIN d USING (date)")
def chrono_split(spark, sf):
    return forecast.chrono_split(V.lane_day(spark, sf)).select("lane", "date", "is_train")


FOLDS = "(SELECT k AS fold, m - CAST(7 * (5 - k) - 1 AS INTEGER) AS first, m - CAST(7 * (4 - k) AS INTEGER) AS last FROM (SELECT max(date) AS m FROM lane_day), (SELECT unnest([1, 2, 3, 4]) AS k))"


@query("walk_forward_folds", f"SELECT CAST(fold AS INTEGER) AS fold, count(*) FILTER (date < first) AS n_train, count(*) FILTER (date BETWEEN first AND last) AS n_valid FROM lane_day, {FOLDS} GROUP BY fold")
def walk_forward_folds(spark, sf):
    d = V.lane_day(spark, sf)
    return d.crossJoin(F.broadcast(forecast.walk_forward_folds(d))).groupBy("fold").agg(F.count_if(F.col("date") < F.col("first")).alias("n_train"), F.count_if(F.col("date").between(F.col("first"), F.col("last"))).alias("n_valid"))


@query("leakage_guard", "SELECT lane, date FROM lane_day WHERE date >= (SELECT max(date) FROM lane_day) - CAST(6 AS INTEGER)")
def leakage_guard(spark, sf):
    """Rows of the longest window that a backtest may look at."""
    d = V.lane_day(spark, sf)
    end = d.agg(F.max("date")).first()[0]
    return forecast.leakage_guard(d, end - timedelta(6), end).select("lane", "date")


@query("correction_chain", """
    WITH r AS (SELECT *, isodow(date) = 7 AS sun, day(date) <= 4 AS eve, day(date) = 2 AS surge, CASE WHEN source < 'B' THEN 0.7 END AS sr, CASE WHEN dest > 'B' THEN 1.1 END AS lr FROM predictions),
    a AS (SELECT *, CASE WHEN sun AND sr IS NULL THEN 0.55 ELSE 1 END AS f1, CASE WHEN eve AND NOT surge THEN 1.15 ELSE 1 END AS f2, CASE WHEN eve AND NOT surge THEN 1.25 ELSE 1 END AS f3, coalesce(CASE WHEN sun THEN sr END, lr, 1) AS f4 FROM r),
    c AS (SELECT *, CASE WHEN sun AND q50 * f1 * f2 * f4 > 0.55 * q50 AND q50 * f1 * f2 * f4 > 0 THEN 0.55 / (f1 * f2 * f4) ELSE 1 END AS f5 FROM a)
    SELECT lane, date, round(q10 * f1 * f2 * f4 * f5, 5) AS q10, round(q50 * f1 * f2 * f4 * f5, 5) AS q50, round(q90 * f1 * f3 * f4 * f5, 5) AS q90 FROM c""")
def correction_chain(spark, sf):
    d = F.dayofmonth("date")
    rows = V.predictions(spark, sf).withColumns({"is_eve": d <= 4, "is_surge": d == 2, "multiplier": F.lit(1.15), "sunday_ratio": F.when(F.col("source") < "B", 0.7), "lane_ratio": F.when(F.col("dest") > "B", 1.1)})
    return forecast.correction_chain(rows).select("lane", "date", R("q10", 5), R("q50", 5), R("q90", 5))


@query("surge_correction", """
    WITH s AS (SELECT lane, date, q50, q90, CASE WHEN day(date) <= 3 THEN least(greatest(0, y - q50), 0.2 * q50) * greatest(0, 2 / (1 + exp(-3.0 * q50 / 150.0)) - 1) ELSE 0 END AS r FROM predictions)
    SELECT lane, date, round(q50 + r, 6) AS q50, round(greatest(q90, q50 + r + 0.15 * r), 6) AS q90 FROM s""")
def surge_correction(spark, sf):
    """The correction itself, with the true residual in the residual model's place."""
    rows = V.predictions(spark, sf).withColumns({"is_surge": F.dayofmonth("date") <= 3, "residual": F.col("y") - F.col("q50")})
    return forecast.surge_correction(rows, "residual").select("lane", "date", R("q50"), R("q90"))


@query("feature_matrix")
def feature_matrix(spark, sf):
    return forecast.feature_matrix(lane_days(spark, sf), X, *tables(spark))


#: Values of the slots, and the factor of Sundays without a ratio of their own.
SLOTS = {"09:00": (X, None), "17:00": ("volume_1700", 0.55)}
_fitted: dict[tuple, forecaster.Forecaster] = {}


def fitted(spark, sf, slot: str = "09:00", history=None) -> forecaster.Forecaster:
    """The forecaster of a slot, fitted once in an application: queries of its parts share it. 17:00 sees the same day's 09:00. history: what lane_days gave, which the caller keeps."""
    key = (spark.sparkContext.applicationId, sf, slot)
    if key not in _fitted:
        value, sunday = SLOTS[slot]
        every = lane_days(spark, sf) if history is None else history
        days = every.select("lane", "source", "dest", "date", value, *([F.col(X).alias(forecaster.SAME_DAY)] if value != X else []))
        _fitted[key] = forecaster.fit(days, value, *tables(spark), sunday=sunday)
        if history is None:
            release(every)
    return _fitted[key]


@query("quantile_model")
def quantile_model(spark, sf):
    """Out-of-fold predictions, with bands from the residuals of the other folds, scored by fold."""
    residuals = fitted(spark, sf).residuals
    parts = [forecast.with_bands(residuals.where(F.col("fold") == k).drop("bucket"), forecast.residual_bands(residuals.where(F.col("fold") != k))) for k in range(1, 5)]
    return scores.evaluate(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]), "fold")


@query("residual_bands")
def residual_bands(spark, sf):
    """What is added to a prediction, in units of its scale, for its lower and upper quantile, from out-of-fold residuals."""
    return fitted(spark, sf).bands


@query("surge_model")
def surge_model(spark, sf):
    """Surges of the last fold, corrected by a model that learned from the folds before."""
    f = fitted(spark, sf)
    seen, last = f.residuals.where("fold < 4"), f.residuals.where("fold = 4").drop("bucket")
    rows = forecaster.add_surge(forecast.with_bands(last, forecast.residual_bands(seen)), forecaster.fit_surge(seen, f.inputs))
    return rows.select("lane", "date", "is_surge", R("y"), R("surge_added"), R("q50"), R("q90"))


@query("predict_batch")
def predict_batch(spark, sf):
    """Seven days ahead for every lane, all at once."""
    history = lane_days(spark, sf)
    days = history.select("lane", "source", "dest", "date", X)
    return forecaster.predict_batch(fitted(spark, sf, history=history), days, forecaster.next_days(days, 1, 7)).drop("rolling_mean_7")


@query("predict_sequential")
def predict_sequential(spark, sf):
    """Seven days ahead for every lane, one after the other."""
    history = lane_days(spark, sf)
    days = history.select("lane", "source", "dest", "date", X)
    return forecaster.predict_sequential(fitted(spark, sf, history=history), days).drop("rolling_mean_7")


@query("cascade_slots")
def cascade_slots(spark, sf):
    """Seven days of both slots: 17:00 of a day sees what was predicted for its 09:00."""
    history = lane_days(spark, sf)
    both = forecaster.in_threads([lambda slot=slot: fitted(spark, sf, slot, history) for slot in SLOTS], spark)
    return forecaster.cascade(dict(zip(SLOTS, both, strict=True)), history).drop("rolling_mean_7")


@query("feature_importance")
def feature_importance(spark, sf):
    """Mean importance of each input over the folds' models, highest first."""
    f = fitted(spark, sf)
    rows = [(name, float(sum(m.stages[-1].featureImportances[i] for m in f.models) / len(f.models))) for i, name in enumerate(f.inputs)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


#: Quantiles that the sweep tries.
ALPHAS = [0.5, 0.58, 0.66, 0.74]


@query("alpha_sweep_fits")
def alpha_sweep_fits(spark, sf):
    """For each alpha, by models of its own, over the validation windows of all folds: the share of unseen days below, the scores, and whether it has the best hybrid score or the least regret."""
    days = lane_days(spark, sf)
    x = cut_lineage(forecaster.matrix(days, X, *tables(spark)).na.fill(0.0, forecast.INPUTS).withColumn("y", F.col(X)).select("lane", "date", "y", "scaled", "scale_factor", *forecast.INPUTS), "sweep-matrix").cache()
    folds = [tuple(r) for r in forecast.walk_forward_folds(days).orderBy("fold").collect()]
    rows = cut_lineage(quantiles.sweep(x, tuple(forecast.INPUTS), folds, ALPHAS), "swept")
    x.unpersist()
    rows = forecast.with_bands(rows, forecast.residual_bands(rows.where(F.col("alpha") == ALPHAS[0])))
    below = rows.groupBy("alpha").agg(F.avg((F.col("y") <= F.col("q50")).cast("double")).alias("below"))
    out = below.join(scores.evaluate(rows, "alpha").select("alpha", "n", R("wape"), R("regret")), "alpha").join(scores.hybrid_score(rows, 0.5988, "alpha").select("alpha", R("hybrid")), "alpha")
    best = out.agg(F.min_by("alpha", "hybrid").alias("best_hybrid"), F.min_by("alpha", "regret").alias("best_regret"))
    return out.crossJoin(F.broadcast(best)).withColumns({c: F.col(c) == F.col("alpha") for c in ("best_hybrid", "best_regret")})  # a row an alpha
