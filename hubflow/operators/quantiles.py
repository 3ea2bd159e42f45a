"""Boosted trees of any quantile, from weights of Spark's absolute loss, and the sweep over quantiles that finds the one to plan by."""

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubflow.operators.forecaster import in_threads


def boosted(inputs: tuple[str, ...], label: str, rounds: int, depth: int, step: float) -> Pipeline:
    stages = [VectorAssembler(inputCols=list(inputs), outputCol="_inputs", handleInvalid="keep"), GBTRegressor(featuresCol="_inputs", labelCol=label, weightCol="_weight", predictionCol="_q", lossType="absolute", maxIter=rounds, maxDepth=depth, stepSize=step, seed=42)]
    return Pipeline(stages=stages)


def fit_quantiles(train: DataFrame, inputs: tuple[str, ...], label: str, alphas: list[float], passes: int = 2, rounds: int = 10, depth: int = 4, step: float = 0.2) -> dict[float, tuple[PipelineModel, float]]:
    """For each alpha a model and what is added to it, so that a share alpha of train lies below.

    Rows above the fit so far weigh alpha and rows below 1 - alpha; the absolute loss of such weights is least where these
    balance, which at a fixed point is the alpha quantile. A first fit serves all alphas; each pass then weighs and
    fits anew, all alphas at once. What rounds and passes leave is taken up by the alpha quantile of the rows' distances.
    train (cached by the caller, as it is read for each tree) may hold other columns.
    """
    spark = train.sparkSession
    first = boosted(inputs, label, rounds, depth, step).fit(train.withColumn("_weight", F.lit(1.0)))

    def fitted(alpha):
        model = first
        for _ in range(passes):
            weight = F.when(F.col(label) > F.col("_q"), alpha).otherwise(1 - alpha)
            model = boosted(inputs, label, rounds, depth, step).fit(model.transform(train).withColumn("_weight", weight).select(*inputs, label, "_weight"))
        rest = model.transform(train).agg(F.percentile_approx(F.col(label) - F.col("_q"), alpha, 100_000).alias("rest")).first().rest
        return model, float(rest or 0.0)

    return dict(zip(alphas, in_threads([lambda a=a: fitted(a) for a in alphas], spark), strict=True))


def sweep(matrix: DataFrame, inputs: tuple[str, ...], folds: list[tuple], alphas: list[float], **how) -> DataFrame:
    """Rows of the folds' (number, first, last) validation windows with q50, the quantile of each alpha by a model that has only seen the days before; matrix has date, y, scaled, scale_factor and inputs. A window without a day before it has no model, and no rows: if that holds for all, a ValueError."""
    begins = matrix.agg(F.min("date")).first()[0]
    learned = [f for f in folds if begins is not None and begins < f[1]]
    if not learned:
        raise ValueError("no window has a day before it to learn from")

    out = None
    for number, first, last in learned:
        models = fit_quantiles(matrix.where(F.col("date") < F.lit(first)), inputs, "scaled", alphas, **how)
        ahead = matrix.where(F.col("date").between(F.lit(first), F.lit(last)))
        for alpha, (model, rest) in models.items():
            q = F.greatest(F.lit(0.0), (F.col("_q") + rest) * F.col("scale_factor"))
            part = model.transform(ahead).select("lane", "date", "y", "scale_factor", "is_weekend", F.lit(number).alias("fold"), F.lit(alpha).alias("alpha"), q.alias("q50"))
            out = part if out is None else out.unionByName(part)
    return out
