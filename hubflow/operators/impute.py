"""Missing values: filled by statistics of their group, of all rows, or by neighbours in time."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def impute(df: DataFrame, column: str, how: str, group: str | None = None) -> DataFrame:
    """Nulls of column as the mean, median or mode (the lowest of equals) of their group; of all rows where the group has none."""
    stat = {"mean": F.avg(column), "median": F.median(column), "mode": F.mode(column, True)}[how]
    overall = F.broadcast(df.agg(stat.alias("_all")))
    d = df.crossJoin(overall)
    if group:
        by = df.groupBy(group).agg(stat.alias("_own")).withColumnRenamed(group, "_g")
        d = d.join(by, F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g")
    else:
        d = d.withColumn("_own", F.lit(None))
    return d.withColumn(column, F.coalesce(column, F.col("_own").cast(df.schema[column].dataType) if how == "mode" else "_own", "_all")).drop("_own", "_all")


def fill_along(df: DataFrame, column: str, group: str, order: list[str], forward: bool = True) -> DataFrame:
    """Nulls of column as the last value before, or the next one after: the last one before in reverse order, as Spark computes a frame to the end of its group anew for each row."""
    w = Window.partitionBy(group)
    filled = F.last(column, True).over(w.orderBy(*order) if forward else w.orderBy(*map(F.desc, order)).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(column, filled)
