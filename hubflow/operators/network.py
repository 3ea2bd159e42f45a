"""Paths and vehicles of the line-haul network. Lanes and vehicle types are small tables (hundreds of rows), joined to demand by broadcast."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hubflow.functions import timecost as T


def relay_candidates(lanes: DataFrame, detour: float = 1.35, k: int = 4, k2: int = 3) -> DataFrame:
    """source, destination, path (array of hubs), km, rank, relays: the k shortest ways by one relay within detour, and the k2 shortest by two, of which the first are those relays. Equal lengths go by name."""
    a = lanes.select("source", F.col("destination").alias("r"), F.col("distance_km").alias("d1"))
    b = lanes.select(F.col("source").alias("r"), "destination", F.col("distance_km").alias("d2"))
    direct = lanes.select("source", "destination", F.col("distance_km").alias("d"))
    one = a.join(b, "r").join(direct, ["source", "destination"]).where("r != source AND r != destination AND d1 + d2 <= d * " + str(detour))
    one = one.withColumn("km", F.col("d1") + F.col("d2")).withColumn("rank", F.row_number().over(Window.partitionBy("source", "destination").orderBy("km", "r"))).where(F.col("rank") <= k)
    c = lanes.select(F.col("source").alias("r"), F.col("destination").alias("s"), F.col("distance_km").alias("d12"))
    e = lanes.select(F.col("source").alias("s"), "destination", F.col("distance_km").alias("d3"))
    two = one.select("source", "destination", "r", "d1").join(c, "r").join(e, ["s", "destination"]).where("s != source AND s != destination AND s != r")
    two = two.withColumn("km", F.col("d1") + F.col("d12") + F.col("d3")).withColumn("rank", F.row_number().over(Window.partitionBy("source", "destination").orderBy("km", "r", "s"))).where(F.col("rank") <= k2)
    paths = one.select("source", "destination", F.array("source", "r", "destination").alias("path"), "km", "rank", F.lit(1).alias("relays"))
    return paths.unionByName(two.select("source", "destination", F.array("source", "r", "s", "destination").alias("path"), "km", "rank", F.lit(2).alias("relays")))


def rank_vehicle_types(rows: DataFrame, keys: list[str], volume: str = "volume", touches: int = 2) -> DataFrame:
    """rank of each vehicle type by count x leg cost + handling cost; equal costs go by larger capacity."""
    n = T.vehicle_count(volume, "capacity")
    cost = n * T.vehicle_leg_cost("spot_hourly", "hours", "spot_km", "distance_km") + T.handling_cost(volume, "spot_hourly", touches)
    order = Window.partitionBy(*keys).orderBy("cost", F.desc("capacity"))
    return rows.withColumns({"vehicles": n, "cost": cost}).withColumn("rank", F.row_number().over(order))


def types_of_lanes(lane_vehicle: DataFrame) -> DataFrame:
    """source, destination, types: the vehicle types of each lane with their attributes, as one array."""
    attributes = [c for c in lane_vehicle.columns if c not in ("source", "destination")]
    return lane_vehicle.groupBy("source", "destination").agg(F.collect_list(F.struct(*attributes)).alias("types"))


def cheapest_type(types: str, volume: str, touches: int = 2):
    """Of an array of vehicle types what rank_vehicle_types puts first, without a row for each type and without a shuffle."""

    def priced(t):
        n = T.vehicle_count(volume, t["capacity"])
        cost = n * T.vehicle_leg_cost(t["spot_hourly"], t["hours"], t["spot_km"], t["distance_km"]) + T.handling_cost(volume, t["spot_hourly"], touches)
        return F.struct(cost.alias("cost"), (-t["capacity"]).alias("smaller"), t.alias("type"))

    return F.array_min(F.transform(types, priced))["type"]


def path_options(lanes: DataFrame, relays: DataFrame) -> DataFrame:
    """source, destination, path, milk_run: direct, each relay, and each relay as a milk run."""
    direct = lanes.select("source", "destination", F.array("source", "destination").alias("path"), F.lit(False).alias("milk_run"))
    by = relays.select("source", "destination", "path", F.explode(F.array(F.lit(False), F.lit(True))).alias("milk_run"))
    return direct.unionByName(by)


def options_of_lanes(options: DataFrame, lane_vehicle: DataFrame) -> DataFrame:
    """source, destination, options: of each lane an array of option, milk_run, hours and parts, one row a lane.

    Each part takes one vehicle type: a leg, or a milk run as a whole, which keeps one type over all legs and is handled at
    its ends only; other legs are handled at both ends. A part is an array of types and a type an array of its legs.
    hours: of the fastest vehicles.
    """
    leg = F.posexplode(F.expr("transform(sequence(0, size(path) - 2), i -> struct(path[i] AS leg_source, path[i + 1] AS leg_destination))")).alias("place", "leg")
    steps = options.withColumn("option", F.concat_ws(">", "path")).select("source", "destination", "option", "milk_run", F.size("path").alias("stops"), leg)
    steps = steps.select("source", "destination", "option", "milk_run", "stops", "place", "leg.*")
    ends = (F.col("place") == 0).cast("int") + (F.col("place") == F.col("stops") - 2).cast("int")
    lv = lane_vehicle.select(F.col("source").alias("leg_source"), F.col("destination").alias("leg_destination"), "vehicle_type", "capacity", "spot_hourly", "hours", T.vehicle_leg_cost("spot_hourly", "hours", "spot_km", "distance_km").alias("leg_cost"))
    per = steps.join(F.broadcast(lv), ["leg_source", "leg_destination"]).withColumn("touches", F.when(F.col("milk_run"), ends).otherwise(2))
    keys = ["source", "destination", "option", "milk_run"]
    types = per.groupBy(*keys, F.when(F.col("milk_run"), F.lit(0)).otherwise(F.col("place")).alias("part"), "vehicle_type").agg(F.collect_list(F.struct("capacity", "leg_cost", "spot_hourly", "touches")).alias("legs"), F.sum("hours").alias("h"))
    parts = types.groupBy(*keys, "part").agg(F.collect_list("legs").alias("types"), F.min("h").alias("h"))
    whole = parts.groupBy(*keys).agg(F.collect_list("types").alias("parts"), F.sum("h").alias("hours"))
    return whole.groupBy("source", "destination").agg(F.collect_list(F.struct("option", "milk_run", "hours", "parts")).alias("options"))


def cost_of_parts(parts, volume: str = "volume"):
    """Cost of an option by the cheapest type of each of its parts, within the row."""
    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda s, x: s + f(x))
    of_leg = lambda g: T.vehicle_count(volume, g["capacity"]) * g["leg_cost"] + T.handling_cost(volume, g["spot_hourly"], g["touches"])
    return total(parts, lambda types: F.array_min(F.transform(types, lambda legs: total(legs, of_leg))))


def option_costs(demands: DataFrame, options: DataFrame, lane_vehicle: DataFrame) -> DataFrame:
    """Cost and hours of each option of each demand by its best vehicles, without regard to capacity. Priced within the row: no row for each leg and type, no shuffle of demands."""
    d = demands.join(F.broadcast(options_of_lanes(options, lane_vehicle)), ["source", "destination"])
    d = d.select("demand_id", "volume", F.explode("options").alias("o"))
    return d.select("demand_id", "o.option", "o.milk_run", cost_of_parts(F.col("o.parts")).alias("cost"), "o.hours", "volume")


def best_options(demands: DataFrame, options: DataFrame, lane_vehicle: DataFrame) -> DataFrame:
    """Of option_costs the row of each demand with the lowest unit cost; equal ones go by hours, option and milk_run."""
    d = demands.join(F.broadcast(options_of_lanes(options, lane_vehicle)), ["source", "destination"])

    def priced(o):
        return F.struct(cost_of_parts(o["parts"]).alias("cost"), F.round(o["hours"], 4).alias("hours"), o["option"].alias("option"), o["milk_run"].alias("milk_run"))

    best = F.array_min(F.transform(F.transform("options", priced), lambda o: F.struct((o["cost"] / F.col("volume")).alias("unit"), o["hours"].alias("hours"), o["option"].alias("option"), o["milk_run"].alias("milk_run"), o["cost"].alias("cost"))))
    return d.withColumn("best", best).select("demand_id", "best.option", "best.milk_run", "best.cost")


def waterfall(demands: DataFrame, keys: list[str], stock: str) -> DataFrame:
    """rental_volume, spot_volume: rental capacity goes to the largest demands of each group first, the rest to spot."""
    before = F.coalesce(F.sum("volume").over(Window.partitionBy(*keys).orderBy(F.desc("volume"), "demand_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rental = F.greatest(F.lit(0.0), F.least(F.col("volume"), F.col(stock) - before))
    return demands.withColumn("rental_volume", rental).withColumn("spot_volume", F.col("volume") - F.col("rental_volume"))


def stretches_of_vehicles(pieces: DataFrame, keys: list[str], order: list[str], capacity: str = "capacity") -> DataFrame:
    """vehicle (from 0), vehicles and share: pieces fill a group's vehicles one after the other; a piece may span several.

    A row for each stretch of vehicles that a piece loads alike: its first, all that it fills alone (vehicle is the first
    of so many vehicles, share what each takes), and its last. So a piece has three rows at most, whatever its volume.
    By running totals and overlaps, so no row waits for another. Shares of 0.001 or less are dropped.
    """
    high = F.sum("volume").over(Window.partitionBy(*keys).orderBy(*order))
    d = pieces.withColumn("_hi", high).withColumn("_lo", F.col("_hi") - F.col("volume"))
    c = F.col(capacity)
    first, last = F.floor(F.col("_lo") / c).cast("int"), F.greatest(F.floor(F.col("_lo") / c), F.ceil(F.col("_hi") / c - T.SLACK) - 1).cast("int")
    stretch = lambda vehicle, n: F.struct(vehicle.alias("vehicle"), n.cast("int").alias("vehicles"))
    parts = F.array(stretch(F.col("_first"), F.lit(1)), stretch(F.col("_first") + 1, F.col("_last") - F.col("_first") - 1), stretch(F.col("_last"), (F.col("_last") > F.col("_first")).cast("int")))
    d = d.withColumns({"_first": first, "_last": last}).select("*", F.inline(F.filter(parts, lambda p: p["vehicles"] > 0))).drop("_first", "_last")
    share = F.least("_hi", (F.col("vehicle") + 1) * c) - F.greatest("_lo", F.col("vehicle") * c)
    return d.withColumn("share", share).where("share > 0.001").drop("_hi", "_lo")


def each_vehicle(stretches: DataFrame, *numbers: str) -> DataFrame:
    """A row for each vehicle of stretches. numbers: columns that, as vehicle does, count on from the stretch's first vehicle."""
    d = stretches.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("vehicles") - 1)))
    return d.withColumns({c: F.col(c) + F.col("_i") for c in ("vehicle", *numbers)}).drop("vehicles", "_i")


def split_over_vehicles(pieces: DataFrame, keys: list[str], order: list[str], capacity: str = "capacity") -> DataFrame:
    """stretches_of_vehicles with a row for each vehicle. What is grouped, joined or numbered goes by stretches; this is for its end."""
    return each_vehicle(stretches_of_vehicles(pieces, keys, order, capacity))


def evictions(rows: DataFrame, keys: list[str], excess: str) -> DataFrame:
    """Smallest assignments first until the excess is covered."""
    before = F.coalesce(F.sum("volume").over(Window.partitionBy(*keys).orderBy("volume", "demand_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return rows.withColumn("_before", before).where(F.col("_before") < F.col(excess)).drop("_before")
