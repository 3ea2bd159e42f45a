"""A fitted forecaster: fold models, bands, a model of what surges add, and corrections, applied to a batch of days, day by day, or to two slots in turn."""

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubflow.functions import risk
from hubflow.operators import features, forecast, rollups
from hubflow.session import cut_lineage, release

#: The other slot's volume of the same day, as an input.
SAME_DAY = "same_day"
#: What marks a surge, and the rows that a model of surges needs at least.
FLAGS = ("is_campaign_eve", "is_campaign_day", "is_post_campaign", "is_post_holiday")
INDICES = ("backlog_release_index", "campaign_release_index")
LEAST_SURGES = 40
EVENT_OVER = 0.35
#: Prior rows, bounds and least weight of the kinds of days.
BUCKETS = [("sunday", 0.4, 0.3, 1.2, 1.8), ("event", 6.0, 0.5, 2.5, 4.0), ("normal", 6.0, 0.7, 1.8, 4.0)]
BANDS = "bucket int, low double, high double"


@dataclass(frozen=True)
class Forecaster:
    """value: the column that it forecasts. residuals: out-of-fold rows with their features, y and q50. bands, ratios (lane, bucket, ratio), lane_ratios (lane, ratio) and multipliers (lane, multiplier) come from them or from the history; none has more rows than lanes times kinds of days. sunday: factor of Sundays without a ratio of their own, None for none."""

    value: str
    inputs: tuple[str, ...]
    models: list[PipelineModel]
    residuals: DataFrame
    bands: DataFrame
    surge: PipelineModel | None
    ratios: DataFrame
    lane_ratios: DataFrame
    multipliers: DataFrame
    sunday: float | None
    holidays: DataFrame
    campaigns: DataFrame


def in_threads(jobs: list, spark) -> list:
    """Results of jobs that run at the same time: small jobs of one fit leave executors idle that another can use."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return list(pool.map(lambda f: inheritable_thread_target(spark)(f)(), jobs))


def matrix(days: DataFrame, value: str, holidays: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Features, with lags that aren't known yet as the mean of the last seven days, is_surge and bucket."""
    x = forecast.feature_matrix(days, value, holidays, campaigns)
    x = x.withColumns({c: F.coalesce(c, "rolling_mean_7") for c in x.columns if c.startswith("lag_")})
    event = risk.surge_trigger(x.columns, FLAGS, INDICES, EVENT_OVER)
    bucket = F.when(F.weekday("date") == 6, "sunday").when(event, "event").otherwise("normal")
    return x.withColumns({"is_surge": risk.surge_trigger(x.columns, FLAGS, INDICES), "bucket": bucket})


def fit_surge(residuals: DataFrame, inputs: tuple[str, ...], least: int = LEAST_SURGES, rounds: int = 20) -> PipelineModel | None:
    """A model of y - q50, in units of scale_factor, of out-of-fold rows that are surges: of how volume has piled up, not of the calendar's flags, which the first model has seen. None for fewer rows than least."""
    rows = residuals.where("is_surge").withColumn("residual", (F.col("y") - F.col("q50")) / F.col("scale_factor"))
    if rows.limit(least).count() < least:
        return None
    columns = [c for c in (*inputs, *INDICES) if c not in FLAGS]
    stages = [VectorAssembler(inputCols=list(dict.fromkeys(columns)), outputCol="surge_inputs", handleInvalid="keep"), GBTRegressor(featuresCol="surge_inputs", labelCol="residual", predictionCol="residual", maxIter=rounds, maxDepth=3, stepSize=0.2, seed=42)]
    stages[1].setPredictionCol("surge_residual")
    return Pipeline(stages=stages).fit(rows.na.fill(0.0, list(INDICES)))


def add_surge(rows: DataFrame, surge: PipelineModel | None) -> DataFrame:
    """What the model of surges adds to q50 on surge rows, as surge_added; without a model no row is a surge."""
    if surge is None:
        return rows.withColumns({"is_surge": F.lit(False), "surge_added": F.lit(0.0)})
    d = surge.transform(rows.na.fill(0.0, list(INDICES))).drop("surge_inputs")
    return forecast.surge_correction(d, F.col("surge_residual") * F.col("scale_factor")).drop("surge_residual")


def fit(days: DataFrame, value: str, holidays: DataFrame, campaigns: DataFrame, rounds: int = forecast.ROUNDS, depth: int = 4, folds: int = 4, sunday: float | None = None) -> Forecaster:
    """Learn from a dense table (lane, date, value and, if it has the column, SAME_DAY). All folds are fitted at once; whatever corrects them comes from rows that they haven't seen."""
    spark = days.sparkSession
    inputs = (*forecast.INPUTS, *([SAME_DAY] if SAME_DAY in days.columns else []))
    seen = matrix(days, value, holidays, campaigns).where("rolling_mean_14 is not null")  # a lane's first row is scaled by the mean of all rows, later ones too
    x = cut_lineage(seen.na.fill(0.0, list(inputs)).withColumn("y", F.col(value)), "feature-matrix")
    windows = [tuple(r) for r in forecast.walk_forward_folds(days, folds).orderBy("fold").collect()]

    def fold(number, first, last):
        train = cut_lineage(forecast.weighted(x.where(F.col("date") < F.lit(first)), value).select(*inputs, "scaled", "weight"), f"fold-{number}")
        model = forecast.regressor("scaled", rounds, depth, list(inputs)).fit(train)
        release(train)
        part = model.transform(x.where(F.col("date").between(F.lit(first), F.lit(last)))).drop("inputs")
        return model, part.withColumns({"fold": F.lit(number), "q50": F.greatest(F.lit(0.0), F.col("q50") * F.col("scale_factor"))})

    made = in_threads([lambda w=w: fold(*w) for w in windows], spark)
    parts = made[0][1]
    for _, part in made[1:]:
        parts = parts.unionByName(part)
    residuals = cut_lineage(parts, "residuals")
    bands = spark.createDataFrame([tuple(r) for r in forecast.residual_bands(residuals).collect()], BANDS)  # weekend or not
    limits = spark.createDataFrame(BUCKETS, "bucket string, prior double, low double, high double, least_n double")
    jobs = [
        lambda: cut_lineage(rollups.bucket_bias(residuals, limits).select("lane", "bucket", "ratio"), "bucket-ratios"),
        lambda: cut_lineage(rollups.weighted_bias(residuals, ["lane"]).select("lane", "ratio"), "lane-ratios"),
        lambda: cut_lineage(rollups.campaign_multiplier(x, "is_campaign_eve", value), "eve-multipliers"),
        lambda: fit_surge(residuals, inputs),
    ]
    ratios, lane_ratios, multipliers, surge = in_threads(jobs, spark)
    release(x)
    return Forecaster(value, inputs, [m for m, _ in made], residuals, bands, surge, ratios, lane_ratios, multipliers, sunday, holidays, campaigns)


def base(f: Forecaster, context: DataFrame, frame: DataFrame) -> DataFrame:
    """The rows of frame with their features, bands and the median of the fold models, as q10, q50, q90 in the value's own units."""
    both = context.withColumn("_ahead", F.lit(False)).unionByName(frame.withColumns({"_ahead": F.lit(True), f.value: F.lit(None).cast("double")}), allowMissingColumns=True)
    x = matrix(both, f.value, f.holidays, f.campaigns).where("_ahead").drop("_ahead").na.fill(0.0, list(f.inputs))
    for i, model in enumerate(f.models):
        x = model.transform(x).withColumnRenamed("q50", f"_m{i}").drop("inputs")
    n, made = len(f.models), F.array_sort(F.array(*(f"_m{i}" for i in range(len(f.models)))))
    median = made[n // 2] if n % 2 else (made[n // 2 - 1] + made[n // 2]) / 2
    x = x.withColumn("q50", F.greatest(F.lit(0.0), median * F.col("scale_factor"))).drop(*(f"_m{i}" for i in range(n)))
    return forecast.with_bands(x.withColumnRenamed("bucket", "kind"), f.bands).withColumnRenamed("kind", "bucket")


def corrected(f: Forecaster, rows: DataFrame) -> DataFrame:
    """base, corrected: what surges add, Sundays, campaign eves that are no surges, the lane's ratio for such days or in all. Tables of lanes are broadcast."""
    d = add_surge(rows, f.surge)
    d = d.join(F.broadcast(f.ratios.withColumnRenamed("ratio", "_kind")), ["lane", "bucket"], "left").join(F.broadcast(f.lane_ratios.withColumnRenamed("ratio", "_lane")), "lane", "left").join(F.broadcast(f.multipliers), "lane", "left")
    sunday = F.col("bucket") == "sunday"
    d = d.withColumns({
        "sunday_ratio": F.when(sunday, F.col("_kind")), "lane_ratio": F.coalesce(F.when(~sunday, F.col("_kind")), F.col("_lane")),
        "multiplier": F.coalesce("multiplier", F.lit(1.0)), "is_eve": F.coalesce(F.col("is_campaign_eve") == 1, F.lit(False)),
    })
    return forecast.correction_chain(d, f.sunday).drop("_kind", "_lane")


def predict_batch(f: Forecaster, history: DataFrame, frame: DataFrame) -> DataFrame:
    """frame (lane, date, other columns of history but the value) with q10, q50, q90, q50_base (before corrections), surge_added, is_surge and rolling_mean_7. All its days are predicted at once: what a later day would need to know of an earlier one is taken as the mean of the last known week."""
    context = features.context_tail(history, forecast.CONTEXT)
    d = base(f, context, frame).withColumn("q50_base", F.bround("q50", 4))
    out = corrected(f, d)
    rounded = [F.bround(c, 4).alias(c) for c in ("q10", "q50", "q90")]
    return out.select(*frame.columns, *rounded, "q50_base", "surge_added", "is_surge", "rolling_mean_7")


def next_days(history: DataFrame, first: int, last: int) -> DataFrame:
    """lane and ids of every lane for the days first to last after history's end."""
    ids = [c for c in ("lane", "source", "dest") if c in history.columns]
    end = history.agg(F.max("date").alias("_end"))
    days = F.sequence(F.date_add("_end", first), F.date_add("_end", last))
    return history.select(*ids).distinct().crossJoin(F.broadcast(end)).select(*ids, F.explode(days).alias("date"))


def trust(h: int):
    """How much of a day's prediction stands for its actual value in later features: less each day, more where it is a surge."""
    a = max(0.35, 1 - 0.11 * (h - 1))
    return F.when(F.col("is_surge"), max(a, 0.9)).otherwise(a)


def cascade(forecasters: dict[str, Forecaster], history: DataFrame, horizon: int = 7) -> DataFrame:
    """Days one after the other, and in a day its slots in order: forecasters by slot name, one or two. The second slot sees the first one's prediction of the same day as SAME_DAY, in whose place the history has the first value itself.

    A day's prediction, mixed with the mean of the last seven, stands for its value in the features of the next. Each is
    written once (one row a lane) and added to the contexts, so plans don't grow with the features of the days before.
    """
    (first, *second) = forecasters.items()
    ids = [c for c in ("lane", "source", "dest") if c in history.columns]
    values = [f.value for f in forecasters.values()]
    tail = cut_lineage(features.context_tail(history, forecast.CONTEXT).select(*ids, "date", *values), "forecast-context")
    contexts = {slot: tail.select(*ids, "date", f.value, *([F.col(first[1].value).alias(SAME_DAY)] if second and slot == second[0][0] else [])) for slot, f in forecasters.items()}
    ahead, end = cut_lineage(next_days(tail, 1, horizon), "forecast-frame"), tail.agg(F.max("date")).first()[0]
    out = None
    for h in range(1, horizon + 1):
        before = None
        for slot, f in forecasters.items():
            frame = ahead.where(F.col("date") == F.date_add(F.lit(end), h))
            if before is not None:
                frame = frame.join(before.select("lane", "date", F.col("q50").alias(SAME_DAY)), ["lane", "date"], "left").na.fill(0.0, [SAME_DAY])
            made = cut_lineage(predict_batch(f, contexts[slot], frame).withColumn("slot", F.lit(slot)), "forecast-day")
            stands = trust(h) * F.col("q50") + (1 - trust(h)) * F.coalesce("rolling_mean_7", F.lit(0.0))
            contexts[slot] = contexts[slot].unionByName(made.withColumn(f.value, stands).select(*contexts[slot].columns))
            out = made.drop(SAME_DAY) if out is None else out.unionByName(made.drop(SAME_DAY))
            before = made
    return out


def predict_sequential(f: Forecaster, history: DataFrame, horizon: int = 7) -> DataFrame:
    """cascade of one slot."""
    return cascade({"": f}, history, horizon).drop("slot")


def save(f: Forecaster, path: str) -> None:
    """Models and tables under path, in any file system that Spark writes to."""
    for i, model in enumerate(f.models):
        model.write().overwrite().save(f"{path}/fold-{i}")
    if f.surge is not None:
        f.surge.write().overwrite().save(f"{path}/surge")
    for name in ("residuals", "bands", "ratios", "lane_ratios", "multipliers", "holidays", "campaigns"):
        getattr(f, name).write.mode("overwrite").parquet(f"{path}/{name}")
    about = [(f.value, list(f.inputs), len(f.models), f.surge is not None, f.sunday)]
    f.residuals.sparkSession.createDataFrame(about, "value string, inputs array<string>, models int, surge boolean, sunday double").coalesce(1).write.mode("overwrite").json(f"{path}/about")


def load(spark, path: str) -> Forecaster:
    about = spark.read.schema("value string, inputs array<string>, models int, surge boolean, sunday double").json(f"{path}/about").first()
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in ("residuals", "bands", "ratios", "lane_ratios", "multipliers", "holidays", "campaigns")}
    models = [PipelineModel.load(f"{path}/fold-{i}") for i in range(about.models)]
    return Forecaster(value=about.value, inputs=tuple(about.inputs), models=models, surge=PipelineModel.load(f"{path}/surge") if about.surge else None, sunday=about.sunday, **tables)
