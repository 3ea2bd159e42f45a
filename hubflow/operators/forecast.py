"""Forecasting with Spark ML: folds, quantile bands, corrections and day-by-day prediction for all lanes at once."""

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hubflow.functions import risk
from hubflow.operators import calendar, features, rollups
from hubflow.operators.selection import percentiles
from hubflow.session import cut_lineage, release

#: Columns that a model is trained on.
INPUTS = ["lag_1", "lag_7", "lag_14", "rolling_mean_7", "rolling_std_7", "rolling_mean_14", "rolling_std_14", "momentum", "weekday", "month", "is_weekend", "is_payday", "backlog_release_index", "campaign_release_index"]
#: Rows of a lane that the features of a day look back on.
CONTEXT = 60


def feature_matrix(days: DataFrame, value: str, holidays: DataFrame, campaigns: DataFrame) -> DataFrame:
    """All lane features of a dense table. Builders of one window specification follow each other, so lane is shuffled once."""
    d = features.target_scale(days, value)
    d = features.holiday_backlog(d, holidays, value)
    d = features.campaign_backlog(d, campaigns, value)
    d = features.campaign_lags(d)
    d = features.post_event_flags(d)
    d = features.organic_backlog(d, value)
    d = features.lags(d, value)
    d = features.rolling(d, value)
    d = features.ema_momentum(d, value)
    d = features.regime_shift(d, value, F.col("backlog_release"))
    d = calendar.payday_features(calendar.time_features(d))
    return features.same_weekday(d, value)


def chrono_split(days: DataFrame, share: float = 0.8) -> DataFrame:
    """is_train: whether a row's date is among the first share of distinct dates."""
    dates = days.select("date").distinct()
    ranked = dates.withColumn("_n", F.row_number().over(Window.orderBy("date")))  # one row a date
    cut = ranked.crossJoin(F.broadcast(dates.agg(F.count("*").alias("_all")))).where(F.col("_n") <= F.floor(F.col("_all") * share)).agg(F.max("date").alias("_cut"))
    return days.crossJoin(F.broadcast(cut)).withColumn("is_train", F.col("date") <= F.col("_cut")).drop("_cut")


def walk_forward_folds(days: DataFrame, folds: int = 4, width: int = 7) -> DataFrame:
    """fold, first, last of each validation window; all before it is its training data."""
    last = days.agg(F.max("date").alias("end"))
    k = last.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    return k.select("fold", F.expr(f"date_sub(end, {width} * ({folds} - fold + 1) - 1)").alias("first"), F.expr(f"date_sub(end, {width} * ({folds} - fold))").alias("last"))


def leakage_guard(days: DataFrame, start, end, folds: int = 4, width: int = 7) -> DataFrame:
    """The rows of a backtest's window. It must not start before the last fold's validation window, which models have learned from, nor end after the last date of days: else a ValueError."""
    fold = walk_forward_folds(days, folds, width).where(F.col("fold") == folds).first()
    if fold is None or fold.last is None:
        raise ValueError("no days to test on")
    if start < fold.first or end > fold.last:
        raise ValueError(f"a backtest from {start} to {end} is not within {fold.first} to {fold.last}")
    return days.where(F.col("date").between(F.lit(start), F.lit(end)))


#: Boosting rounds. On the scaled target, near 1, each moves a prediction by up to 0.1, so the absolute loss takes effect.
ROUNDS = 30


def regressor(label: str, iterations: int = ROUNDS, depth: int = 4, inputs: list[str] | None = None) -> Pipeline:
    """Absolute-loss boosted trees of weighted rows: an estimate of the median."""
    return Pipeline(stages=[VectorAssembler(inputCols=inputs or INPUTS, outputCol="inputs", handleInvalid="keep"), GBTRegressor(featuresCol="inputs", labelCol=label, weightCol="weight", predictionCol="q50", lossType="absolute", maxIter=iterations, maxDepth=depth, seed=42)])


def weighted(train: DataFrame, value: str) -> DataFrame:
    """Training rows with the weight of their regret against the lane's capacity, both from these rows alone; a lane without volume has capacity 0."""
    capacity = train.select("lane").distinct().join(rollups.regret_capacity(train, value).select("lane", "capacity"), "lane", "left").na.fill(0.0, ["capacity"])
    return features.regret_weights(train, value, capacity)


def fit_folds(matrix: DataFrame, value: str, folds: list, iterations: int = ROUNDS) -> tuple[list, DataFrame]:
    """A model of the scaled target for each fold (fold, first, last), and their predictions of the validation windows, scaled back, with dates and features kept."""
    ready = matrix.na.fill(0.0, INPUTS).withColumn("y", F.col(value))
    models, out = [], None
    for fold, first, last in folds:
        train = cut_lineage(weighted(ready.where(F.col("date") < F.lit(first)), value).select(*INPUTS, "scaled", "weight"), f"fold-{fold}")
        model = regressor("scaled", iterations).fit(train)
        part = model.transform(ready.where(F.col("date").between(F.lit(first), F.lit(last)))).withColumn("fold", F.lit(fold)).drop("inputs")
        models.append(model)
        out = part if out is None else out.unionByName(part)
    return models, out.withColumn("q50", F.greatest(F.lit(0.0), F.col("q50") * F.col("scale_factor")))


def residual_bands(residuals: DataFrame, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """bucket, low, high: quantiles of out-of-fold residuals by scale_factor, by weekend or not; times scale_factor and added to q50 they give q10 and q90."""
    ratio = (F.col("y") - F.col("q50")) / F.col("scale_factor")
    d = cut_lineage(residuals.select(F.col("is_weekend").alias("bucket"), ratio.alias("ratio")), "residual-ratios")
    found = percentiles(d, ["bucket"], "ratio", [low, high])
    release(d)
    return found.select("bucket", F.col("p")[0].alias("low"), F.col("p")[1].alias("high"))


def with_bands(rows: DataFrame, bands: DataFrame) -> DataFrame:
    d = rows.join(F.broadcast(bands), F.col("is_weekend") == F.col("bucket"), "left")
    low, high = (F.col("q50") + F.coalesce(c, F.lit(0.0)) * F.col("scale_factor") for c in ("low", "high"))
    return d.withColumn("q10", F.greatest(F.lit(0.0), low)).withColumn("q90", F.greatest("q50", high)).drop("bucket", "low", "high")


def surge_correction(rows: DataFrame, correction: str, cap: float = 0.20) -> DataFrame:
    """What a residual model adds on triggered rows: its positive part, at most cap of q50, damped where volumes are small; q90 keeps its distance."""
    r = F.when(F.col("is_surge"), F.least(F.greatest(F.lit(0.0), correction), cap * F.col("q50")) * risk.volume_damping(F.col("q50"))).otherwise(0.0)
    d = rows.withColumn("surge_added", r).withColumn("q50", F.col("q50") + F.col("surge_added"))
    return d.withColumn("q90", F.greatest("q90", F.col("q50") + 0.15 * F.col("surge_added")))


def correction_chain(rows: DataFrame, sunday: float | None = 0.55, eve: float = 0.10) -> DataFrame:
    """The order matters: Sundays without an own ratio, then campaign eves that aren't surges, then the bias ratio, then the Sunday ceiling on what came before all. Without a factor of Sundays they have neither it nor the ceiling."""
    bands = ("q10", "q50", "q90")
    is_sunday = F.weekday("date") == 6 if sunday is not None else F.lit(False)
    d = rows.withColumn("_raw", F.col("q50"))
    factor = F.when(is_sunday & F.col("sunday_ratio").isNull(), sunday).otherwise(1.0)
    d = d.withColumns({c: F.col(c) * factor for c in bands})
    on_eve = F.col("is_eve") & ~F.col("is_surge")
    multiplier = F.when(on_eve, F.col("multiplier")).otherwise(1.0)
    d = d.withColumns({"q10": F.col("q10") * multiplier, "q50": F.col("q50") * multiplier, "q90": F.col("q90") * F.when(on_eve, F.col("multiplier") + eve).otherwise(1.0)})
    ratio = F.coalesce(F.when(F.weekday("date") == 6, F.col("sunday_ratio")), F.col("lane_ratio"), F.lit(1.0))
    d = d.withColumns({c: F.col(c) * ratio for c in bands})
    ceiling = F.when(is_sunday & (F.col("q50") > sunday * F.col("_raw")) & (F.col("q50") > 0), sunday * F.col("_raw") / F.col("q50")).otherwise(1.0) if sunday is not None else F.lit(1.0)
    return d.withColumns({c: F.col(c) * ceiling for c in bands}).drop("_raw")
