"""Volume that waits: deferral from slot to slot by prefix scans, who waits how long, and what a plan of it must keep to."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hubflow.functions import timecost as T
from hubflow.operators import calendar

LANE = ["source", "destination"]


def slot_grid(demands: DataFrame, slots: tuple[str, ...]) -> DataFrame:
    """source, destination, day, slot, began (seconds), demand: all slots of all days that occur, for every lane that occurs; 0 where nothing is asked for.

    The calendar is one row a slot. Lanes and calendar are put under the demands before they are dealt by lane, so what follows by lane needs no other shuffle.
    """
    lanes = demands.select(*LANE).distinct()
    days = demands.select("day").distinct().withColumn("slot", F.explode(F.array(*map(F.lit, slots))))
    empty = lanes.crossJoin(F.broadcast(days)).withColumn("volume", F.lit(0.0))
    every = demands.select(*LANE, "day", "slot", "volume").unionByName(empty.select(*LANE, "day", "slot", "volume"))
    out = every.repartition(*LANE).groupBy(*LANE, "day", "slot").agg(F.sum(F.greatest("volume", F.lit(0.0))).alias("demand"))
    return out.withColumn("began", F.unix_timestamp(calendar.slot_timestamp("day", "slot")))


def deferral(rows: DataFrame, capacity: Column, keys: list[str], order: str = "began") -> DataFrame:
    """rows with inbound, accumulated, moved, deferred and next: what waits is max(0, inbound + demand - capacity), and the next slot's inbound; in the last slot of the keys all goes, whatever the capacity.

    The recursion is a running sum less its running minimum (or 0): one window, no row waits for another. next: order of the slot that follows.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    d = rows.withColumns({"next": F.lead(order).over(w), "_sum": F.sum(F.col("demand") - capacity).over(upto)})
    d = d.withColumn("_low", F.least(F.lit(0.0), F.min("_sum").over(upto)))
    d = d.withColumn("deferred", F.when(F.col("next").isNull(), 0.0).otherwise(F.col("_sum") - F.col("_low")))
    d = d.withColumn("inbound", F.coalesce(F.lag(F.col("_sum") - F.col("_low")).over(w), F.lit(0.0)))
    return d.withColumns({"accumulated": F.col("inbound") + F.col("demand"), "moved": F.col("inbound") + F.col("demand") - F.col("deferred")}).drop("_sum", "_low")


def weekly_plan(demands: DataFrame, rentals: DataFrame, capacity: float, slots: tuple[str, ...], most_spot: int = 1) -> DataFrame:
    """The plan of a lane's slots by deferral: its rented vehicles go in a day's first slot, at most most_spot spot vehicles of the same capacity in each, and in the last slot as many as it takes.

    rentals (source, destination, vehicle_count) has a row a lane, and is broadcast. Adds rental_load, rental_vehicles, spot_load, spot_vehicles, stock.
    """
    d = slot_grid(demands, slots).join(F.broadcast(rentals.select(*LANE, F.col("vehicle_count").alias("stock"))), LANE, "left")
    d = d.withColumn("stock", F.coalesce("stock", F.lit(0))).withColumn("_rental", F.when(F.col("slot") == slots[0], F.col("stock") * capacity).otherwise(0.0))
    d = deferral(d, F.col("_rental") + most_spot * capacity, LANE)
    d = d.withColumn("rental_load", F.least("moved", "_rental")).withColumn("spot_load", F.col("moved") - F.col("rental_load"))
    return d.withColumns({f"{k}_vehicles": T.vehicle_count(f"{k}_load", F.lit(capacity)) for k in ("rental", "spot")}).drop("_rental")


def broken_rules(plan: DataFrame, capacity: float, least_load: float = 0.1) -> DataFrame:
    """source, destination, day, slot, rule, amount: a row for each rule that a lane's slot breaks.

    balance: what was deferred before and is asked for now isn't what is moved and deferred. left_at_end: volume deferred
    in the last slot. rental_stock: more rented vehicles in a day than the lane has. load: more than the vehicles hold.
    low_load: spot vehicles under least_load full, but for the last slot.
    """
    w = Window.partitionBy(*LANE).orderBy("began")
    before = F.coalesce(F.lag("deferred").over(w), F.lit(0.0))
    last = F.lead("began").over(w).isNull()
    day = F.sum("rental_vehicles").over(w.partitionBy(*LANE, "day").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    moved = F.col("rental_load") + F.col("spot_load")
    full = (F.col("rental_vehicles") + F.col("spot_vehicles")) * capacity
    checks = {
        "balance": (F.abs(before + F.col("demand") - moved - F.col("deferred")) > 1e-6, before + F.col("demand") - moved - F.col("deferred")),
        "left_at_end": (last & (F.col("deferred") > 1e-6), F.col("deferred")),
        "rental_stock": (day > F.col("stock"), (day - F.col("stock")).cast("double")),
        "load": (moved > full + 1e-6, moved - full),
        "low_load": (~last & (F.col("spot_load") + 1e-6 < least_load * F.col("spot_vehicles") * capacity), F.col("spot_load")),
    }
    found = F.array_compact(F.array(*(F.when(broken, F.struct(F.lit(rule).alias("rule"), F.round(amount, 4).alias("amount"))) for rule, (broken, amount) in checks.items())))
    return plan.withColumn("_found", found).where(F.size("_found") > 0).select(*LANE, "day", "slot", F.inline("_found"))


def waiting(plan: DataFrame) -> DataFrame:
    """Of each lane's slot: demand, on_time, deferred, inbound (of earlier slots' demand, moved now), first_target and last_target (began of the slots in which the deferred part goes), cancelled (all deferred), partial.

    First come, first served: on one axis of volume stand the demands as they came and the movements as they went; a
    demand's deferred part ends up in the movements that lie across it. Marks and movements are put in order together, so
    the movement that follows a mark is a running value, not a join.
    """
    w = Window.partitionBy(*LANE).orderBy("began").rowsBetween(Window.unboundedPreceding, 0)
    d = plan.withColumns({"on_time": F.greatest(F.lit(0.0), F.col("moved") - F.col("inbound")), "_asked": F.round(F.sum("demand").over(w), 4), "_gone": F.round(F.sum("moved").over(w), 4)})
    d = d.withColumn("late", F.col("demand") - F.col("on_time"))
    end, gone, start = 0, 1, 2
    marks = F.array(
        F.struct(F.col("_asked").alias("at"), F.lit(end).alias("kind")),
        F.struct(F.round(F.col("_asked") - F.col("late"), 4).alias("at"), F.lit(start).alias("kind")),
        F.struct(F.col("_gone").alias("at"), F.lit(gone).alias("kind")),
    )
    needed = F.filter(marks, lambda m: F.when(m["kind"] == gone, F.col("moved") > 0).otherwise(F.col("late") > 1e-6))
    numbers = ["demand", "on_time", "late", "moved"]
    events = d.where("demand > 0 or moved > 0").select(*LANE, "day", "slot", "began", *numbers, F.inline(F.array_append(needed, F.struct(F.lit(0.0).alias("at"), F.lit(-1).alias("kind")))))
    # from the far end of the axis: the last movement met at or beyond a mark; of several at one place the earliest is met last
    back = Window.partitionBy(*LANE).orderBy(F.desc("at"), F.desc("kind"), F.desc("began")).rowsBetween(Window.unboundedPreceding, 0)
    events = events.withColumn("_to", F.last(F.when(F.col("kind") == gone, F.col("began")), ignorenulls=True).over(back))
    target = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("_to")))
    out = events.groupBy(*LANE, "day", "slot").agg(*(F.max(c).alias(c) for c in numbers), target(start).alias("first_target"), target(end).alias("last_target"))
    late, asked = F.col("late") > 1e-6, F.col("demand") > 0
    return out.select(*LANE, "day", "slot", "demand", "on_time", F.col("late").alias("deferred"), (F.col("moved") - F.col("on_time")).alias("inbound"), F.timestamp_seconds("first_target").alias("first_target"), F.timestamp_seconds("last_target").alias("last_target"), (asked & late & (F.col("on_time") <= 0)).alias("cancelled"), (late & (F.col("on_time") > 0)).alias("partial"))
