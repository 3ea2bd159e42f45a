"""Exact percentiles of a few large groups: brackets around the wanted ranks are narrowed by sketches and counts, so no task sees a group's values."""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from hubflow.session import cut_lineage, release

#: Groups that may be asked for; what is said about them passes the driver. Many small groups are for F.percentile.
MOST_GROUPS = 10_000
_CHANGED = "values changed between passes: write rows as a table first"
_TARGET = "group int, rank long, low double, high double, new_low double, new_high double"


@dataclass
class _Target:
    """A rank looked for strictly between low and high (None: no bound); before counts the values up to low, n those between."""

    group: int
    rank: int
    before: int
    n: int
    low: float | None = None
    high: float | None = None
    grid: list[float] = field(default_factory=list)
    value: float | None = None

    def narrowed(self) -> tuple[float | None, float | None]:
        """Points of the sketch on both sides of the rank; without a sketch the bounds as they are."""
        if not self.grid:
            return self.low, self.high
        last = len(self.grid) - 1
        i = (self.rank - self.before) * last // self.n
        return self.grid[i - 1] if i > 1 else self.low, self.grid[i + 2] if i + 2 < last else self.high

    def enter(self, low, high, less: int, at_low: int, between: int, at_high: int, grid) -> None:
        """Go on in whichever part counts say holds the rank, right or not as the sketch was; an end point that holds it is the value."""
        left = self.rank - self.before
        if left < less:
            self.high, self.n, self.grid = low, less, []
        elif left < less + at_low:
            self.value = low
        elif left < less + at_low + between:
            self.before, self.low, self.high, self.n, self.grid = self.before + less + at_low, low, high, between, list(grid)
        elif left < less + at_low + between + at_high:
            self.value = high
        else:
            gone = less + at_low + between + at_high
            self.before, self.low, self.n, self.grid = self.before + gone, high, self.n - gone, []


def percentiles(rows: DataFrame, keys: list[str], value: str | Column, points: list[float], most: int = 100_000, steps: int = 1000, accuracy: int = 10_000) -> DataFrame:
    """keys, n, p: for each group the count of its values and their percentiles at points, interpolated as F.percentile does.

    A first pass counts and sketches each group. Each rank then has a bracket; a pass over what lies inside counts exactly
    where the rank is and sketches the part that holds it, some 3 / steps of the bracket, until at most `most` values are
    left, which one task sorts. A trillion values take four passes. Sketches only choose where to cut (after a pass that
    didn't halve a bracket the next ones are ten times finer): counts decide, so results are exact, and a value that half of all rows hold becomes an end point and is counted, not sorted. Passes
    shuffle one row a group and rank. rows is read once a pass and must give the same values each time (a written table).

    Nulls and NaN don't count; a group without other values has n = 0 and a null p, and so has an empty table without keys.
    Null keys are a group. More than MOST_GROUPS groups are an error.
    """
    spark = rows.sparkSession
    v = F.col(value).cast("double") if isinstance(value, str) else value.cast("double")
    names = [f"k{i}" for i in range(len(keys))]
    narrow = rows.select(*(F.col(k).alias(a) for k, a in zip(keys, names)), F.when(~F.isnan(v), v).alias("v"))
    sketch = lambda c, finer=1: F.percentile_approx(c, [i / steps for i in range(steps + 1)], accuracy * finer)

    groups = narrow.groupBy(*names).agg(F.count("v").alias("n"), sketch(F.col("v")).alias("grid")).limit(MOST_GROUPS + 1).collect()
    if len(groups) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups: use F.percentile")
    places = [[p * (g.n - 1) for p in points] if g.n else [] for g in groups]
    targets = {(i, r): _Target(i, r, 0, groups[i].n, grid=list(groups[i].grid)) for i, found in enumerate(places) for x in found for r in (int(x), min(int(x) + 1, groups[i].n - 1))}

    numbers = spark.createDataFrame([(*(g[a] for a in names), i) for i, g in enumerate(groups)], StructType([*(narrow.schema[a] for a in names), StructField("group", LongType())]))
    for a in names:
        numbers = numbers.withColumnRenamed(a, f"_{a}")
    same = F.lit(True)
    for a in names:
        same = same & F.col(a).eqNullSafe(F.col(f"_{a}"))
    numbered = narrow.join(F.broadcast(numbers), same) if names else narrow.withColumn("group", F.lit(0))
    numbered = numbered.select(F.col("group").cast("int").alias("group"), "v").where("v is not null")

    def inside(some: list[tuple]) -> DataFrame:
        wanted = F.broadcast(spark.createDataFrame(some, _TARGET))
        within = (F.col("low").isNull() | (F.col("v") > F.col("low"))) & (F.col("high").isNull() | (F.col("v") < F.col("high")))
        return numbered.join(wanted, "group").where(within)

    finer = 1
    while large := [t for t in targets.values() if t.value is None and t.n > most]:
        cuts = {(t.group, t.rank): t.narrowed() for t in large}
        below = F.coalesce(F.col("v") < F.col("new_low"), F.lit(False))
        at_low, at_high = F.coalesce(F.col("v") == F.col("new_low"), F.lit(False)), F.coalesce(F.col("v") == F.col("new_high"), F.lit(False)) & ~F.coalesce(F.col("new_low") == F.col("new_high"), F.lit(False))
        between = ~below & ~at_low & F.coalesce(F.col("v") < F.col("new_high"), F.lit(True))
        counts = inside([(t.group, t.rank, t.low, t.high, *cuts[t.group, t.rank]) for t in large]).groupBy("group", "rank").agg(
            F.count("*").alias("n"), F.count_if(below).alias("less"), F.count_if(at_low).alias("at_low"), F.count_if(between).alias("between"), F.count_if(at_high).alias("at_high"), sketch(F.when(between, F.col("v")), finer).alias("grid"),
        )
        seen = {(c.group, c["rank"]): c for c in counts.collect()}
        for t in large:
            c, cut = seen.get((t.group, t.rank)), bool(t.grid)
            if c is None or c.n != t.n:
                raise RuntimeError(_CHANGED)
            t.enter(*cuts[t.group, t.rank], c.less, c.at_low, c.between, c.at_high, c.grid or [])
            if cut and t.value is None and t.n == c.n:  # cuts are values of the bracket: at least one has to go
                raise RuntimeError(_CHANGED)
        if any(t.value is None and t.n > c.n / 2 for t in large for c in [seen[t.group, t.rank]]):
            finer = min(finer * 10, 1000)

    small = [t for t in targets.values() if t.value is None]
    if small:
        found = inside([(t.group, t.rank, t.low, t.high, float(t.rank - t.before), None) for t in small])
        picked = found.groupBy("group", "rank").agg(F.get(F.sort_array(F.collect_list("v")), F.first("new_low").cast("int")).alias("value"), F.count("*").alias("n"))
        for r in picked.collect():
            if r.n != targets[r.group, r["rank"]].n:
                raise RuntimeError(_CHANGED)
            targets[r.group, r["rank"]].value = r["value"]

    if any(t.value is None for t in targets.values()):
        raise RuntimeError(_CHANGED)

    def at(i: int, x: float) -> float:
        low, high = targets[i, int(x)].value, targets[i, min(int(x) + 1, groups[i].n - 1)].value
        return low if low == high or x == int(x) else (int(x) + 1 - x) * low + (x - int(x)) * high

    out = [(*(g[a] for a in names), g.n, [at(i, x) for x in places[i]] or None) for i, g in enumerate(groups)]
    fields = [StructField(k, narrow.schema[a].dataType) for k, a in zip(keys, names)]
    return spark.createDataFrame(out, StructType([*fields, StructField("n", LongType()), StructField("p", ArrayType(DoubleType()))]))


def summarised(rows: DataFrame, keys: list[str], aggregates: list[Column], value: str, points: list[float], name: str) -> DataFrame:
    """keys, aggregates and p, the percentiles of value: a row a group. rows (only the columns needed) are written once for all passes and removed again."""
    d = cut_lineage(rows, name)
    found = percentiles(d, keys, value, points)
    found = found.select(*(F.col(k).alias(f"_{k}") for k in keys), "p")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    out = d.groupBy(*keys).agg(*aggregates).join(F.broadcast(found), same).drop(*(f"_{k}" for k in keys))
    small = rows.sparkSession.createDataFrame(out.collect(), out.schema)  # as many rows as groups
    release(d)
    return small
