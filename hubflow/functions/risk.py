"""Risk of a forecast band as columns. Values are rounded to 4 digits, halves to even, before they are used further."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits of the classes, and of the dynamic threshold its slope and power.
LOW, MEDIUM, SLOPE, POWER = 0.35, 0.82, 0.35, -0.30


def r4(c: Column, digits: int = 4) -> Column:
    """Halves to even; what is beyond ten digits is noise of the binary number and doesn't decide."""
    return F.bround(F.round(c, 10), digits)


def maape_scale(ratio: Column, scale: Column) -> Column:
    return F.when(scale <= 0, 1.0).otherwise(2 / math.pi * F.atan(F.greatest(ratio, F.lit(0.0)) / scale))


def demand_band(bands: DataFrame) -> DataFrame:
    """q10 <= q50 <= q90, none negative; range, safety buffer and recommended quantity."""
    q50 = F.greatest(F.lit(0.0), "q50")
    d = bands.withColumn("q50", q50).withColumn("q10", F.least(F.greatest(F.lit(0.0), "q10"), "q50")).withColumn("q90", F.greatest("q90", "q50"))
    d = d.withColumns({c: r4(F.col(c)) for c in ("q10", "q50", "q90")})
    buffer = r4((F.col("q90") - F.col("q50")) * 0.5)
    return d.withColumn("uncertainty_range", r4(F.col("q90") - F.col("q10"))).withColumn("safety_buffer", buffer).withColumn("recommended", r4(F.col("q50") + F.col("safety_buffer")))


def risk_score(bands: DataFrame, floor: str = "floor", scale: str = "scale", tau: str = "tau") -> DataFrame:
    """relative, threshold, steepness, raw and weighted score, class, from a demand_band with the parameters of its slot."""
    v = F.greatest("q50", F.lit(1.0))
    d = bands.withColumns({"relative": r4(maape_scale(F.col("uncertainty_range") / v, F.col(scale))), "threshold": r4(F.col(tau) + SLOPE * F.pow(v, F.lit(POWER))), "steepness": r4(2 + F.log1p(v))})
    power = F.greatest(F.lit(-100.0), F.least(F.lit(100.0), F.col("steepness") * (F.col("relative") - F.col("threshold"))))
    d = d.withColumn("raw_score", r4(1 / (1 + F.exp(-power))))
    d = d.withColumn("risk_score", r4(F.col("raw_score") * F.sqrt(F.least(F.lit(1.0), F.col("q50") / F.col(floor)))))
    return d.withColumn("risk_class", risk_class(F.col("risk_score")))


def risk_class(score: Column) -> Column:
    return F.when(score < LOW, "LOW").when(score <= MEDIUM, "MEDIUM").otherwise("HIGH")


def dynamic_tau(prediction: Column, low: float = 0.50, high: float = 0.95, begin: float = 50.0, end: float = 1500.0) -> Column:
    """Falls from high to low as a logistic curve of log(1 + prediction) between begin and end."""
    middle, width = (math.log1p(begin) + math.log1p(end)) / 2, (math.log1p(end) - math.log1p(begin)) / 8
    return low + (high - low) / (1 + F.exp((F.log1p(F.greatest(prediction, F.lit(0.0))) - middle) / width))


def volume_damping(volume: Column, critical: float = 150.0, k: float = 3.0) -> Column:
    return F.greatest(F.lit(0.0), 2 / (1 + F.exp(-k * volume / critical)) - 1)


def asym_logcosh(error: Column, tau: float) -> Column:
    """Loss of actual less predicted: log cosh, weighted by tau where too little was predicted and 1 - tau where too much."""
    return F.log(F.cosh(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), error)))) * F.when(error > 0, tau).otherwise(1 - tau)


def surge_trigger(columns: list[str], flags: tuple[str, ...], indices: tuple[str, ...], threshold: float = 0.05) -> Column:
    """Whether a flag is up or an index over the threshold; columns that the table lacks don't count."""
    out = F.lit(False)
    for names, least in ((flags, 0.0), (indices, threshold)):
        for c in names:
            if c in columns:
                out = out | (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) > least)
    return out
