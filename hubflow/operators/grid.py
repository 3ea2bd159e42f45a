"""Dense lane-by-day tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubflow.adapters import SLOTS

ARROW = " → "


def lane_key(source: str = "source", dest: str = "dest"):
    return F.concat_ws(ARROW, source, dest)


def demand_rollup(log: DataFrame) -> DataFrame:
    """Volume of each lane, day and slot."""
    return log.groupBy(lane_key().alias("lane"), "source", "dest", "date", "slot").agg(F.sum("volume").alias("volume"))


def slot_pivot(rolled: DataFrame) -> DataFrame:
    """A column of volume for each slot; a slot without demand has 0."""
    pivot = rolled.groupBy("lane", "source", "dest", "date").pivot("slot", list(SLOTS)).sum("volume")
    return pivot.select("lane", "source", "dest", "date", *(F.coalesce(F.col(f"`{s}`"), F.lit(0.0)).alias(f"volume_{s.replace(':', '')}") for s in SLOTS))


def date_grid(log: DataFrame) -> DataFrame:
    """lane, source, dest, date: every lane of log on every day from its first to its last."""
    days = log.agg(F.min("date").alias("a"), F.max("date").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("date"))
    return log.select(lane_key().alias("lane"), "source", "dest").distinct().crossJoin(F.broadcast(days))


def dense_lane_days(log: DataFrame) -> DataFrame:
    """date_grid with the volume of each slot, 0 where there is none."""
    volumes = slot_pivot(demand_rollup(log)).drop("source", "dest")
    return date_grid(log).join(volumes, ["lane", "date"], "left").na.fill(0.0, ["volume_0900", "volume_1700"]).select("lane", "source", "dest", "date", "volume_0900", "volume_1700")
