"""Features of hubs. All windows run over hub-days, never over lane rows: a hub with a third of all lanes is no hot task."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hubflow.operators.features import EPS, by_lane


def by_hub():
    return Window.partitionBy("hub").orderBy("date")


def hub_days(days: DataFrame, end: str, value: str) -> DataFrame:
    return days.groupBy(F.col(end).alias("hub"), "date").agg(F.sum(value).alias("total"))


def hub_lag(days: DataFrame, value: str) -> DataFrame:
    """The source hub's total of the day before."""
    lag = hub_days(days, "source", value).select(F.col("hub").alias("source"), "date", F.lag("total").over(by_hub()).alias("hub_lag_1"))
    return days.join(lag, ["source", "date"])


def hub_pressure(days: DataFrame, value: str, widths: tuple[int, ...] = (1, 7)) -> DataFrame:
    """For each width the means of the source hub's outgoing and the destination's incoming volume over so many days before, their ratio, and the source's share of the network's mean; and yesterday's volume of the neighbours: of order 1 what left the source on its other lanes, of order 2 all that came into the destination.

    Neighbours are sums of hubs less the lane's own row, so no lane meets another; each end is joined once, for all widths.
    """
    back = {w: by_hub().rowsBetween(-w, -1) for w in widths}
    yesterday = F.lag("total").over(by_hub())
    out = hub_days(days, "source", value).withColumns({f"hub_out_{w}": F.avg("total").over(f) for w, f in back.items()} | {"_left": yesterday})
    into = hub_days(days, "dest", value).withColumns({f"hub_in_{w}": F.avg("total").over(f) for w, f in back.items()} | {"neighbours_2": yesterday})
    network = out.groupBy("date").agg(*(F.avg(f"hub_out_{w}").alias(f"_network_{w}") for w in widths))
    d = days.join(out.drop("total").withColumnRenamed("hub", "source"), ["source", "date"]).join(into.drop("total").withColumnRenamed("hub", "dest"), ["dest", "date"]).join(network, "date")
    made = {f"pressure_{w}": F.col(f"hub_in_{w}") / (F.col(f"hub_out_{w}") + EPS) for w in widths} | {f"centrality_{w}": F.col(f"hub_out_{w}") / (F.col(f"_network_{w}") + EPS) for w in widths}
    made["neighbours_1"] = F.greatest(F.lit(0.0), F.col("_left") - F.lag(value).over(by_lane()))
    return d.withColumns(made).drop("_left", *(f"_network_{w}" for w in widths))


def hub_share(days: DataFrame, value: str, steps: tuple[int, ...] = (7, 14, 21)) -> DataFrame:
    """The lane's share of its source hub's day, some days ago."""
    total = hub_days(days, "source", value).withColumnRenamed("hub", "source")
    d = days.join(total, ["source", "date"]).withColumn("share", F.coalesce(F.try_divide(value, "total"), F.lit(0.0)))
    return d.withColumns({f"share_lag_{k}": F.lag("share", k).over(by_lane()) for k in steps}).drop("total")
