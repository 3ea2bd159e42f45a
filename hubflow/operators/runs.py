"""Plans of several legs: how loads are dealt over runs of vehicles, when vehicles leave and arrive, what they cost and what is late.

A run is a vehicle's trip along two hubs or more without its load being touched in between: a direct trip, a leg between
relays, or a whole milk run. A demand's load takes up to RUNS runs one after the other.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hubflow.functions import timecost as T
from hubflow.operators import calendar
from hubflow.operators.network import each_vehicle, stretches_of_vehicles
from hubflow.session import cut_lineage, release

#: Runs that a load takes at most: direct, or by one or two relays.
RUNS = 3
#: What tells one vehicle from another.
VEHICLE = ["trip", "day", "slot", "vehicle_type", "is_rental", "run", "vehicle"]
#: What tells one load from another: a demand's part on rented or on spot vehicles.
LOAD = ["demand_id", "is_rental"]
RENTAL_SLOT = "09:00"
UNDELIVERED_HOURS, HANDLING_EXCESS, TRUCK_EXCESS = 720, 1000.0, 50000.0


def lane_runs(routes: DataFrame, lane_vehicle: DataFrame) -> DataFrame:
    """source, destination, target_days, milk_run, runs: of each lane's route (path, milk_run) its runs, each with its path and the vehicle types for it, as arrays. One row a lane.

    A type: vehicle_type, capacity, spot_hourly, drive (of the whole run), hours, and drives and minutes by leg.
    """
    n = F.when(F.col("milk_run"), 1).otherwise(F.size("path") - 1)
    r = routes.withColumn("run", F.explode(F.sequence(F.lit(0), n - 1)))
    r = r.withColumn("trip", F.when(F.col("milk_run"), F.col("path")).otherwise(F.slice("path", F.col("run") + 1, 2)))
    legs = r.select("source", "destination", "run", "trip", F.posexplode(F.expr("transform(sequence(0, size(trip) - 2), i -> struct(trip[i] AS a, trip[i + 1] AS b))")).alias("leg", "ends"))
    lv = lane_vehicle.select(F.col("source").alias("a"), F.col("destination").alias("b"), "vehicle_type", "capacity", "spot_hourly", "hours", T.travel_minutes("hours").alias("m"), T.vehicle_leg_cost("spot_hourly", "hours", "spot_km", "distance_km").alias("d"))
    per = legs.select("source", "destination", "run", "trip", "leg", "ends.*").join(F.broadcast(lv), ["a", "b"])
    by_leg = F.array_sort(F.collect_list(F.struct("leg", "d", "m", "hours")))
    types = per.groupBy("source", "destination", "run", "trip", "vehicle_type").agg(F.first("capacity").alias("capacity"), F.first("spot_hourly").alias("spot_hourly"), by_leg.alias("legs"))
    types = types.withColumns({"drives": F.col("legs.d"), "minutes": F.col("legs.m"), "hours": total(F.col("legs.hours"))}).withColumn("drive", total(F.col("drives")))
    made = types.groupBy("source", "destination", "run", "trip").agg(F.collect_list(F.struct("vehicle_type", "capacity", "spot_hourly", "drive", "hours", "drives", "minutes")).alias("types"))
    runs = made.groupBy("source", "destination").agg(F.array_sort(F.collect_list(F.struct("run", "trip", "types"))).alias("runs"))
    return routes.select("source", "destination", "target_days", "milk_run").join(runs, ["source", "destination"])


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def cheapest(types: Column, volume: str) -> Column:
    """Of a run's vehicle types that with the lowest cost for a volume, of equal ones the larger; null for no run."""

    def priced(t):
        cost = T.vehicle_count(volume, t["capacity"]) * t["drive"] + T.handling_cost(volume, t["spot_hourly"])
        return F.struct(cost.alias("cost"), (-t["capacity"]).alias("smaller"), t["vehicle_type"].alias("name"), t.alias("type"))

    return F.array_min(F.transform(types, priced))["type"]


def dispatched(demands: DataFrame, runs: DataFrame, stock: DataFrame, rented_type: str) -> DataFrame:
    """A row for each load and run, with its vehicle type, day and slot: rented vehicles first (stock: source, destination, vehicle_count), for loads of RENTAL_SLOT, the largest first; the rest by spot.

    A later run goes by the first slot after the run before has arrived. All within the row: demands are joined with one
    row a lane, and shuffled for the rented lanes' running totals alone.
    """
    d = demands.withColumnRenamed("day", "asked_day").withColumnRenamed("slot", "asked_slot").join(F.broadcast(runs), ["source", "destination"])
    d = d.join(F.broadcast(stock.select("source", "destination", "vehicle_count")), ["source", "destination"], "left")
    truck = F.filter(F.col("runs")[0]["types"], lambda t: t["vehicle_type"] == rented_type)[0]
    may = F.col("vehicle_count").isNotNull() & (F.col("asked_slot") == RENTAL_SLOT)
    before = F.coalesce(F.sum("volume").over(Window.partitionBy("source", "destination", "asked_day").orderBy(F.desc("volume"), "demand_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rented = d.where(may).withColumn("_r", F.greatest(F.lit(0.0), F.least(F.col("volume"), F.col("vehicle_count") * truck["capacity"] - before)))
    d = rented.unionByName(d.where(~may).withColumn("_r", F.lit(0.0)))
    parts = F.array(F.struct(F.lit(True).alias("is_rental"), F.col("_r").alias("load")), F.struct(F.lit(False).alias("is_rental"), (F.col("volume") - F.col("_r")).alias("load")))
    d = d.withColumn("_p", F.explode(F.filter(parts, lambda p: p["load"] > 1e-9))).withColumns({"is_rental": F.col("_p.is_rental"), "volume": F.col("_p.load")}).drop("_p", "_r")
    day, slot, steps = F.col("asked_day"), F.col("asked_slot"), []
    for i in range(RUNS):
        here = F.get("runs", F.lit(i))
        d = d.withColumn(f"_t{i}", F.when(F.col("is_rental"), F.filter(here["types"], lambda t: t["vehicle_type"] == rented_type)[0]).otherwise(cheapest(here["types"], "volume")))
        steps.append(F.struct(F.lit(i).alias("run"), F.array_join(here["trip"], ">").alias("trip"), day.alias("day"), slot.alias("slot"), F.col(f"_t{i}").alias("type")))
        day, slot = T.next_dispatch(day, calendar.slot_hour(slot), F.col(f"_t{i}.hours"))
    d = d.select(*LOAD, "source", "destination", "asked_day", "asked_slot", "target_days", "milk_run", F.size("runs").alias("runs"), "volume", F.inline(F.filter(F.array(*steps), lambda s: s["type"].isNotNull())))
    return d.select("*", "type.*").drop("type", "drive", "hours")


def stretches(rows: DataFrame) -> DataFrame:
    """Pieces: the loads of a trip, slot, type and run fill its vehicles in order of demand_id; adds vehicle (from 0), vehicles, share and load (of the vehicle).

    Vehicles that one load fills alone are alike in all that follows, so they are one row: vehicle is the first of so many
    vehicles. A load and run has three rows at most, and a plan grows with its loads, not with their volume.
    """
    d = stretches_of_vehicles(rows, VEHICLE[:-1], ["demand_id"])
    return d.withColumn("load", F.sum("share").over(Window.partitionBy(*VEHICLE)))


def loaded(rows: DataFrame) -> DataFrame:
    """stretches with a row for each vehicle."""
    return each_vehicle(stretches(rows))


def timed(pieces: DataFrame, name: str = "pieces") -> DataFrame:
    """pieces with departs and arrives of their vehicles: a vehicle leaves when its whole load is in, not before its slot, and not before all that feeds it has come and been unloaded and loaded again.

    Run by run, as a run only waits for those before it: what has come by the run before is a maximum by load, what a
    vehicle waits for a maximum by vehicle. Pieces are written before, and with their times behind (a table that the caller may release).
    """
    pieces = cut_lineage(pieces, name)
    fed, out = None, None
    for i in range(RUNS):
        d = pieces.where(F.col("run") == i)
        ready = F.unix_timestamp(calendar.slot_timestamp("day", "slot")) + 60 * T.handling_minutes("load")
        if fed is not None:
            d = d.join(fed, LOAD, "left")
            ready = F.greatest(ready, F.col("_fed") + 60 * T.handling_minutes("share", consolidated=True))
        d = d.withColumn("departs", F.max(ready).over(Window.partitionBy(*VEHICLE))).withColumn("arrives", F.col("departs") + 60 * F.aggregate("minutes", F.lit(0), lambda s, m: s + m))
        d = d.select(*pieces.columns, "departs", "arrives")
        fed = d.where(F.col("runs") > i + 1).groupBy(*LOAD).agg(F.max("arrives").alias("_fed"))
        out = d if out is None else out.unionByName(d)
    out = cut_lineage(out, f"{name}-timed")
    release(pieces)
    return out


def by_leg(pieces: DataFrame) -> DataFrame:
    """A row for each piece and leg: from, to, leg (from 1) of legs, leg_departs, leg_arrives, is_last, touches and leg_cost, the vehicle's cost of the leg: driving, which the contract of rented vehicles pays, and handling where the load is touched."""
    hubs, n = F.split("trip", ">"), F.size("minutes")
    d = pieces.withColumns({"_hubs": hubs, "_n": n}).select("*", F.posexplode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_i", "_"))
    sofar = F.aggregate(F.slice("minutes", 1, F.col("_i")), F.lit(0), lambda s, m: s + m)
    touches = (F.col("_i") == 0).cast("int") + (F.col("_i") == F.col("_n") - 1).cast("int")
    d = d.withColumns({
        "from": F.col("_hubs")[F.col("_i")], "to": F.col("_hubs")[F.col("_i") + 1], "leg": F.when(F.col("milk_run"), F.col("_i")).otherwise(F.col("run")) + 1, "legs": F.when(F.col("milk_run"), F.col("_n")).otherwise(F.col("runs")),
        "leg_departs": F.col("departs") + 60 * sofar, "leg_arrives": F.col("departs") + 60 * (sofar + F.col("minutes")[F.col("_i")]), "touches": touches,
        "leg_cost": F.when(F.col("is_rental"), 0.0).otherwise(F.col("drives")[F.col("_i")]) + T.handling_cost("load", "spot_hourly", touches),
    })
    return d.withColumn("is_last", F.col("leg") == F.col("legs")).drop("_hubs", "_n", "_i", "_")


def late_penalty(arrives: Column, share: str) -> Column:
    """Of a piece that arrives then (seconds): what it costs that it is unloaded after its demand's slot and target days."""
    done = arrives + 60 * T.handling_minutes(share)
    deadline = F.unix_timestamp(calendar.slot_timestamp("asked_day", "asked_slot")) + (F.col("target_days") * 86400).cast("long")
    hours = F.greatest(F.lit(0), F.ceil((done - deadline) / 3600)).cast("int")
    return F.round(T.sla_penalty(share, hours), 2)


def vehicle_numbers(vehicles: DataFrame, order: list[str]) -> DataFrame:
    """vehicles (distinct stretches with day and vehicles) with number, that of a stretch's first vehicle: from 1 over all days and within a day in order. Numbers of a day start after the vehicles of the days before: one row a day goes through the window over all."""
    days = vehicles.groupBy("day").agg(F.sum("vehicles").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.select("day", before.alias("_before"))
    number = F.coalesce(F.sum("vehicles").over(Window.partitionBy("day").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_before") + 1
    return vehicles.join(days, "day").withColumn("number", number).drop("_before")


def code(number: str = "number") -> Column:
    return F.format_string("V%04d", number)


def vehicle_codes(vehicles: DataFrame, order: list[str]) -> DataFrame:
    """vehicles (distinct rows with day) with code: V0001 and on by vehicle_numbers."""
    d = vehicle_numbers(vehicles.withColumn("vehicles", F.lit(1)), order)
    return d.withColumn("code", code()).drop("vehicles", "number")


def hub_uses(legs: DataFrame, *vehicle: str) -> DataFrame:
    """hub, day, uses: departures and arrivals of vehicles (what tells them apart, from, to, leg_departs, leg_arrives; rows of one leg may repeat; with vehicles, a row stands for so many). A leg that starts where the vehicle's leg before ended is no second use of that hub."""
    n = F.col("vehicles") if "vehicles" in legs.columns else F.lit(1).alias("vehicles")
    trips = legs.select(*vehicle, n, "from", "to", "leg_departs", "leg_arrives").distinct()
    order = Window.partitionBy(*vehicle).orderBy("leg_departs", "leg_arrives", "from", "to")
    d = trips.withColumn("_before", F.lag("to").over(order))
    at = lambda hub, second: F.struct(F.col(hub).alias("hub"), F.to_date(F.timestamp_seconds(second)).alias("day"))
    goes = F.when(F.col("_before").isNull() | (F.col("_before") != F.col("from")), at("from", "leg_departs"))
    return d.select("vehicles", F.inline(F.array_compact(F.array(goes, at("to", "leg_arrives"))))).groupBy("hub", "day").agg(F.sum("vehicles").alias("uses"))
