"""What each way of carrying a demand costs in all: its vehicles, the rented ones first, and the delay that it ends with."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hubflow.functions import timecost as T
from hubflow.operators import calendar

RENTAL_SLOT = "09:00"
HOUR, DAY = 3600, 86400
KEYS = ["source", "destination", "option", "milk_run"]


def priced_lanes(options: DataFrame, lane_vehicle: DataFrame) -> DataFrame:
    """source, destination, options: of each lane an array of option, milk_run, direct and parts, one row a lane; the parts, in order, as arrays of vehicle types with minutes, hours and legs (leg_cost, touches). A milk run is one part, other options have one a leg."""
    leg = F.posexplode(F.expr("transform(sequence(0, size(path) - 2), i -> struct(path[i] AS a, path[i + 1] AS b))")).alias("place", "leg")
    steps = options.withColumn("option", F.concat_ws(">", "path")).select(*KEYS, F.size("path").alias("stops"), leg).select(*KEYS, "stops", "place", "leg.*")
    ends = (F.col("place") == 0).cast("int") + (F.col("place") == F.col("stops") - 2).cast("int")
    lv = lane_vehicle.select(F.col("source").alias("a"), F.col("destination").alias("b"), "vehicle_type", "capacity", "spot_hourly", "hours", T.travel_minutes("hours").alias("minutes"), T.vehicle_leg_cost("spot_hourly", "hours", "spot_km", "distance_km").alias("leg_cost"))
    per = steps.join(F.broadcast(lv), ["a", "b"]).withColumn("touches", F.when(F.col("milk_run"), ends).otherwise(2))
    part = F.when(F.col("milk_run"), F.lit(0)).otherwise(F.col("place")).alias("part")
    types = per.groupBy(*KEYS, "stops", part, "vehicle_type").agg(F.first("capacity").alias("capacity"), F.first("spot_hourly").alias("spot_hourly"), F.sum("minutes").cast("int").alias("minutes"), F.sum("hours").alias("hours"), F.collect_list(F.struct("leg_cost", "touches")).alias("legs"))
    parts = types.groupBy(*KEYS, "stops", "part").agg(F.collect_list(F.struct("vehicle_type", "capacity", "spot_hourly", "minutes", "hours", "legs")).alias("types"))
    whole = parts.groupBy(*KEYS, "stops").agg(F.array_sort(F.collect_list(F.struct("part", "types"))).alias("parts"))
    return whole.groupBy("source", "destination").agg(F.collect_list(F.struct("option", "milk_run", (F.col("stops") == 2).alias("direct"), "parts")).alias("options"))


def after(slot_at: Column, hours: Column) -> Column:
    """The first slot (seconds) later than so many hours after a slot: 09:00, 17:00, or 09:00 of the next day."""
    arrival = slot_at + hours * HOUR
    day = F.floor(arrival / DAY) * DAY
    return (day + F.when(arrival - day < 9 * HOUR, 9 * HOUR).when(arrival - day < 17 * HOUR, 17 * HOUR).otherwise(33 * HOUR)).cast("long")


def let(value: Column, use) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def carried(option: Column, spot: Column, rented: Column, truck: Column) -> Column:
    """cost and done (seconds) of an option for the row's demand: a fold over its parts. Each part takes the cheapest type (of equal ones the faster, then by name) for the spot volume; the first leaves when the load is in, later ones by the slot after the part before, and not before that has come and been handled twice. Rented trucks (struct of spot_hourly and minutes) cost their handling alone, and take their own time."""
    volume = F.col("volume")

    def best(types):
        def priced(t):
            n = T.vehicle_count(spot, t["capacity"])
            cost = F.aggregate(t["legs"], F.lit(0.0), lambda s, g: s + n * g["leg_cost"] + T.handling_cost(spot, t["spot_hourly"], g["touches"]))
            return F.struct(cost.alias("cost"), t["hours"].alias("hours"), t["vehicle_type"].alias("name"), t["minutes"].alias("minutes"))

        return F.array_min(F.transform(types, priced))

    def step(s, p):
        return let(best(p["types"]), lambda t: gone(s, t))

    def gone(s, t):
        minutes = F.when(rented > 1e-9, F.when(spot > 1e-9, F.greatest(t["minutes"], truck["minutes"])).otherwise(truck["minutes"])).otherwise(t["minutes"])
        ready = F.when(s["done"] < 0, s["slot_at"] + 60 * T.handling_minutes(volume)).otherwise(F.greatest(s["slot_at"], s["done"] + 60 * T.handling_minutes(volume, consolidated=True)))
        return F.struct((s["cost"] + t["cost"]).alias("cost"), after(s["slot_at"], t["hours"]).alias("slot_at"), (ready + 60 * minutes).cast("long").alias("done"))

    start = F.struct(F.lit(0.0).alias("cost"), F.col("slot_at").alias("slot_at"), F.lit(-1).cast("long").alias("done"))
    handling = F.when(rented > 1e-9, T.handling_cost(rented, truck["spot_hourly"])).otherwise(0.0)
    return F.aggregate(option["parts"], start, step, lambda end: F.struct((end["cost"] + handling).alias("cost"), (end["done"] + 60 * T.handling_minutes(volume)).alias("done")))


def valued(demands: DataFrame, options: DataFrame, lane_vehicle: DataFrame, lanes: DataFrame, rentals: DataFrame, rented_type: str) -> DataFrame:
    """demands (demand_id, source, destination, day, slot, volume) with an array `valued`: option, milk_run, cost, late_hours, penalty, total of each option.

    Rented vehicles (rentals: source, destination, vehicle_count) carry what is left of the lane's stock of that day when
    larger demands of RENTAL_SLOT have been served, by the direct option; the rest of it and all else goes by spot. Tables of lanes are
    broadcast; only demands of rented lanes are shuffled.
    """
    truck = lane_vehicle.where(F.col("vehicle_type") == rented_type).select("source", "destination", F.struct("spot_hourly", T.travel_minutes("hours").alias("minutes"), "capacity").alias("truck"))
    stock = rentals.groupBy("source", "destination").agg(F.sum("vehicle_count").alias("vehicles")).join(truck, ["source", "destination"])
    d = demands.select("demand_id", "source", "destination", "day", "slot", "volume").join(F.broadcast(stock), ["source", "destination"], "left")
    may = F.col("vehicles").isNotNull() & (F.col("slot") == RENTAL_SLOT)
    before = F.coalesce(F.sum("volume").over(Window.partitionBy("source", "destination", "day").orderBy(F.desc("volume"), "demand_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rented = d.where(may).withColumn("rented", F.greatest(F.lit(0.0), F.least(F.col("volume"), F.col("vehicles") * F.col("truck.capacity") - before)))
    d = rented.unionByName(d.where(~may).withColumn("rented", F.lit(0.0)))
    d = d.join(F.broadcast(priced_lanes(options, lane_vehicle)), ["source", "destination"]).join(F.broadcast(lanes.select("source", "destination", "target_days")), ["source", "destination"])
    d = d.withColumn("slot_at", F.unix_timestamp(calendar.slot_timestamp("day", "slot")))
    deadline = F.col("slot_at") + (F.col("target_days") * DAY).cast("long")

    def value(o):
        direct = o["direct"]
        c = carried(o, F.when(direct, F.col("volume") - F.col("rented")).otherwise(F.col("volume")), F.when(direct, F.col("rented")).otherwise(0.0), F.col("truck"))
        late = lambda c: F.greatest(F.lit(0), F.ceil((c["done"] - deadline) / HOUR)).cast("int")
        return let(c, lambda c: F.struct(o["option"].alias("option"), o["milk_run"].alias("milk_run"), c["cost"].alias("cost"), late(c).alias("late_hours")))

    def with_total(o):
        penalty = F.round(T.sla_penalty("volume", o["late_hours"]), 2)
        return F.struct(o["option"].alias("option"), o["milk_run"].alias("milk_run"), o["cost"].alias("cost"), o["late_hours"].alias("late_hours"), penalty.alias("penalty"), (o["cost"] + penalty).alias("total"))

    return d.select("demand_id", "volume", "rented", F.transform(F.transform("options", value), with_total).alias("valued"))


def option_totals(*tables) -> DataFrame:
    """A row for each demand and option of valued."""
    return valued(*tables).select("demand_id", F.inline("valued"))


def best_totals(*tables) -> DataFrame:
    """Of each demand the option with the lowest total by volume; equal ones by option, milk runs last."""
    best = F.array_min(F.transform("valued", lambda o: F.struct((o["total"] / F.col("volume")).alias("unit"), o["option"].alias("option"), o["milk_run"].alias("milk_run"), o["cost"].alias("cost"), o["penalty"].alias("penalty"), o["total"].alias("total"))))
    return valued(*tables).withColumn("best", best).select("demand_id", "best.option", "best.milk_run", "best.cost", "best.penalty", "best.total")
