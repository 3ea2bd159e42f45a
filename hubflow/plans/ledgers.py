"""Queries: materialised plans, ledgers of capacity and their costs.

The plan here is the deterministic one: each demand goes directly, first in the rentals of its lane, the rest by the
spot vehicle type that costs least for it.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from hubflow import adapters as V
from hubflow.catalog import query
from hubflow.functions import timecost as T
from hubflow.operators import calendar
from hubflow.operators import network as N
from hubflow.plans.dates import HOUR, split_at_midnight
from hubflow.plans.network import RENTED

R = lambda c, n=4: F.round(c, n).alias(c)


def assignments(spark, sf):
    """A row for each leg and kind of vehicle: demand_id, source, destination, day, slot, vehicle_type, is_rental, volume and the vehicle's and lane's attributes."""
    d = V.demands(spark, sf).join(F.broadcast(V.rentals(spark, sf).select("source", "destination", "vehicle_count")), ["source", "destination"], "left")
    d = N.waterfall(d.withColumn("stock", F.coalesce("vehicle_count", F.lit(0)) * 22400.0), ["source", "destination", "day"], "stock")
    d = d.join(F.broadcast(N.types_of_lanes(V.lane_vehicle(spark, sf))), ["source", "destination"])
    truck = F.filter("types", lambda t: t["vehicle_type"] == "Tır")[0]
    kinds = ((True, F.col("rental_volume"), truck), (False, F.col("spot_volume"), N.cheapest_type("types", "spot_volume")))
    parts = F.array(*(F.struct(F.lit(rental).alias("is_rental"), volume.alias("volume"), vehicle.alias("vehicle")) for rental, volume, vehicle in kinds))
    d = d.select("demand_id", "source", "destination", "day", "slot", F.inline(parts)).where("volume > 1e-9")
    attributes = ("capacity", "spot_hourly", "spot_km", "hours", "distance_km", "target_days")
    return d.select("demand_id", "source", "destination", "day", "slot", F.col("vehicle.vehicle_type"), "is_rental", "volume", *(F.col(f"vehicle.{c}") for c in attributes))


ASSIGNED = f"""
    {RENTED},
    p AS MATERIALIZED (SELECT demand_id, source, destination, day, slot, greatest(0, least(volume, stock - used)) AS rv, volume - greatest(0, least(volume, stock - used)) AS sv FROM w),
    sp AS MATERIALIZED (SELECT p.demand_id, p.source, p.destination, p.day, p.slot, v.vehicle_type, FALSE AS is_rental, p.sv AS volume, v.capacity, v.spot_hourly, v.spot_km, v.hours, v.distance_km, v.target_days,
      row_number() OVER (PARTITION BY p.demand_id ORDER BY ceil(p.sv / v.capacity - 1e-9) * round_even(v.spot_hourly * v.hours + v.spot_km * v.distance_km, 0) + round_even(2 * ceil(round(p.sv * 0.01, 9)) / 60 * v.spot_hourly, 0), v.capacity DESC) AS n
      FROM p JOIN lane_vehicle v ON v.source = p.source AND v.destination = p.destination WHERE p.sv > 1e-9),
    asg AS MATERIALIZED (SELECT p.demand_id, p.source, p.destination, p.day, p.slot, v.vehicle_type, TRUE AS is_rental, p.rv AS volume, v.capacity, v.spot_hourly, v.spot_km, v.hours, v.distance_km, v.target_days
      FROM p JOIN lane_vehicle v ON v.source = p.source AND v.destination = p.destination AND v.vehicle_type = 'Tır' WHERE p.rv > 1e-9
      UNION ALL SELECT * EXCLUDE (n) FROM sp WHERE n = 1),
    bk AS MATERIALIZED (SELECT source, destination, day, slot, vehicle_type, is_rental, sum(volume) AS volume, count(DISTINCT demand_id) AS demands, CAST(ceil(sum(volume) / any_value(capacity) - 1e-9) AS INTEGER) AS vehicles, any_value(capacity) AS capacity,
      any_value(hours) AS hours, any_value(spot_hourly) AS spot_hourly, any_value(spot_km) AS spot_km, any_value(distance_km) AS distance_km FROM asg GROUP BY source, destination, day, slot, vehicle_type, is_rental)"""

LEG = ["source", "destination", "day", "slot", "vehicle_type", "is_rental"]


def buckets(a):
    """Assignments of one leg, slot and vehicle type together. Nothing but sums and counts, so it combines before the shuffle."""
    firsts = [F.first(c).alias(c) for c in ("capacity", "hours", "spot_hourly", "spot_km", "distance_km")]
    d = a.groupBy(*LEG).agg(F.sum("volume").alias("volume"), F.count_distinct("demand_id").alias("demands"), *firsts)
    return d.withColumn("vehicles", T.vehicle_count("volume", "capacity"))


@query("dispatch_summary", f"WITH {ASSIGNED} SELECT source, destination, day, slot, vehicle_type, is_rental, volume, vehicles, vehicles * capacity AS capacity, round(volume / (vehicles * capacity) * 100, 6) AS occupancy_pct FROM bk")
def dispatch_summary(spark, sf):
    b = buckets(assignments(spark, sf)).withColumn("capacity", F.col("vehicles") * F.col("capacity"))
    return b.select(*LEG, "volume", "vehicles", "capacity", F.round(F.col("volume") / F.col("capacity") * 100, 6).alias("occupancy_pct"))


@query("consolidation_count", f"WITH {ASSIGNED} SELECT count(*) AS buckets, count(*) FILTER (demands > 1) AS consolidated FROM bk")
def consolidation_count(spark, sf):
    return buckets(assignments(spark, sf)).agg(F.count("*").alias("buckets"), F.count_if(F.col("demands") > 1).alias("consolidated"))


@query("low_occupancy_legs", f"WITH {ASSIGNED} SELECT source, destination, day, slot, vehicle_type, round(volume / (vehicles * capacity), 9) AS occupancy FROM bk WHERE NOT is_rental AND volume / (vehicles * capacity) < 0.4")
def low_occupancy_legs(spark, sf):
    b = buckets(assignments(spark, sf).where("not is_rental")).withColumn("occupancy", F.col("volume") / (F.col("vehicles") * F.col("capacity")))
    return b.where("occupancy < 0.4").select("source", "destination", "day", "slot", "vehicle_type", R("occupancy", 9))


@query("affected_assignments", f"WITH {ASSIGNED} SELECT DISTINCT demand_id FROM asg JOIN bk USING (source, destination, day, slot, vehicle_type, is_rental) WHERE NOT is_rental AND bk.volume / (vehicles * bk.capacity) < 0.4")
def affected_assignments(spark, sf):
    """Demands on legs that are under 40 % full."""
    a = assignments(spark, sf)
    low = buckets(a.where("not is_rental")).where("volume / (vehicles * capacity) < 0.4").select(*LEG)
    return a.join(low, LEG, "left_semi").select("demand_id").distinct()


#: A piece of each demand and slot, so that pieces fill vehicles in a known order.
SPLIT = f"""
    {ASSIGNED},
    hl AS MATERIALIZED (SELECT *, sum(volume) OVER (PARTITION BY source, destination, day, vehicle_type, is_rental ORDER BY slot, demand_id) AS hi FROM asg),
    vs AS MATERIALIZED (SELECT *, unnest(range(CAST(floor((hi - volume) / capacity) AS BIGINT), CAST(greatest(floor((hi - volume) / capacity), ceil(hi / capacity - 1e-9) - 1) AS BIGINT) + 1)) AS vehicle FROM hl),
    sh AS MATERIALIZED (SELECT *, least(hi, (vehicle + 1) * capacity) - greatest(hi - volume, vehicle * capacity) AS share FROM vs)"""
DAY_LEG = ["source", "destination", "day", "vehicle_type", "is_rental"]


def vehicle_stretches(spark, sf):
    return N.stretches_of_vehicles(assignments(spark, sf), DAY_LEG, ["slot", "demand_id"])


def vehicle_shares(spark, sf):
    return N.each_vehicle(vehicle_stretches(spark, sf))


@query("vehicle_split", f"WITH {SPLIT} SELECT demand_id, is_rental, CAST(vehicle AS INTEGER) AS vehicle, round(share, 6) AS share FROM sh WHERE share > 0.001")
def vehicle_split(spark, sf):
    return vehicle_shares(spark, sf).select("demand_id", "is_rental", "vehicle", R("share", 6))


@query("piece_ids", f"WITH {SPLIT} SELECT demand_id, CAST(vehicle AS INTEGER) AS vehicle, is_rental, CASE WHEN count(*) OVER (PARTITION BY demand_id) > 1 THEN demand_id || '-' || row_number() OVER (PARTITION BY demand_id ORDER BY is_rental DESC, vehicle) ELSE demand_id END AS piece_id FROM sh WHERE share > 0.001")
def piece_ids(spark, sf):
    """Numbers go by stretches of vehicles; a row for each vehicle comes last, behind all shuffles."""
    w = Window.partitionBy("demand_id")
    before = F.sum("vehicles").over(w.orderBy(F.desc("is_rental"), "vehicle").rowsBetween(Window.unboundedPreceding, -1))
    d = vehicle_stretches(spark, sf).select("demand_id", "vehicle", "vehicles", "is_rental", F.sum("vehicles").over(w).alias("n"), (F.coalesce(before, F.lit(0)) + 1).alias("k"))
    return N.each_vehicle(d, "k").select("demand_id", "vehicle", "is_rental", F.when(F.col("n") > 1, F.concat_ws("-", "demand_id", F.col("k").cast("string"))).otherwise(F.col("demand_id")).alias("piece_id"))


COSTED = f"""
    {SPLIT},
    vc AS MATERIALIZED (SELECT source, destination, day, vehicle_type, is_rental, vehicle, sum(share) AS load, any_value(spot_hourly) AS h, CASE WHEN is_rental THEN 0 ELSE round_even(any_value(spot_hourly) * any_value(hours) + any_value(spot_km) * any_value(distance_km), 0) END AS driving FROM sh WHERE share > 0.001 GROUP BY source, destination, day, vehicle_type, is_rental, vehicle),
    vk AS MATERIALIZED (SELECT *, driving + round_even(2 * ceil(round(load * 0.01, 9)) / 60 * h, 0) AS cost FROM vc)"""


def cost_of_load(load):
    """Driving, which the contract of rented vehicles pays, and handling at both ends."""
    driving = F.when(F.col("is_rental"), 0.0).otherwise(T.vehicle_leg_cost("spot_hourly", "hours", "spot_km", "distance_km"))
    return driving + T.handling_cost(load, "spot_hourly")


def vehicle_costs(spark, sf):
    """A row for each stretch of vehicles: load and cost of one of them."""
    firsts = [F.first(c).alias(c) for c in ("vehicles", "spot_hourly", "spot_km", "hours", "distance_km")]
    v = vehicle_stretches(spark, sf).groupBy(*DAY_LEG, "vehicle").agg(F.sum("share").alias("load"), *firsts)
    return v.withColumn("cost", cost_of_load(F.col("load")))


@query("vehicle_cost", f"WITH {COSTED} SELECT source, destination, day, vehicle_type, is_rental, CAST(vehicle AS INTEGER) AS vehicle, cost FROM vk")
def vehicle_cost(spark, sf):
    return N.each_vehicle(vehicle_costs(spark, sf)).select(*DAY_LEG, "vehicle", "cost")


HANDLED = f"""
    {ASSIGNED},
    op AS MATERIALIZED (SELECT source AS hub, CAST(day AS TIMESTAMP) + to_hours({HOUR}) AS began, volume, CAST(ceil(round(volume * 0.01, 9)) AS BIGINT) AS minutes FROM bk
      UNION ALL SELECT destination, CAST(day AS TIMESTAMP) + to_hours({HOUR}) + to_minutes(CAST(ceil(round(hours * 60, 9)) AS BIGINT)), volume, CAST(ceil(round(volume * 0.01, 9)) AS BIGINT) FROM bk),
    os AS MATERIALIZED (SELECT *, began + to_minutes(minutes) AS done, unnest(generate_series(date_trunc('day', began), date_trunc('day', began + to_minutes(minutes) - INTERVAL 1 SECOND), INTERVAL 1 DAY)) AS m FROM op),
    hd AS MATERIALIZED (SELECT hub, CAST(m AS DATE) AS day, sum(volume * (epoch(least(done, m + INTERVAL 1 DAY)) - epoch(greatest(began, m))) / (minutes * 60)) AS handled FROM os GROUP BY ALL)"""


def handling_ledger_of(b):
    """Volume handled at each hub and day: loading from the slot on, unloading from the arrival on, split at midnight."""
    began = calendar.slot_timestamp("day", "slot")
    ends = F.array(F.struct(F.col("source").alias("hub"), F.lit(0).alias("after")), F.struct(F.col("destination").alias("hub"), T.travel_minutes("hours").alias("after")))
    d = b.select("volume", began.alias("at"), F.inline(ends)).withColumn("began", T.plus_minutes("at", "after")).withColumn("minutes", T.handling_minutes("volume"))
    return split_at_midnight(d, "began", "minutes", "volume").groupBy("hub", "day").agg(F.sum("share").alias("handled"))


@query("handling_ledger", f"WITH {HANDLED} SELECT hub, day, round(handled, 4) AS handled FROM hd")
def handling_ledger(spark, sf):
    return handling_ledger_of(buckets(assignments(spark, sf))).select("hub", "day", R("handled"))


TRUCKS = f"""
    tr AS (SELECT hub, day, sum(n) AS trucks FROM (SELECT source AS hub, day, vehicles AS n FROM bk WHERE vehicle_type = 'Tır'
      UNION ALL SELECT destination, CAST(day + CAST(floor(({HOUR} + ceil(round(hours * 60, 9)) / 60) / 24) AS INTEGER) AS DATE), vehicles FROM bk WHERE vehicle_type = 'Tır') GROUP BY ALL)"""


def truck_ledger_of(b):
    t = b.where("vehicle_type = 'Tır'")
    arrival = T.arrival_day("day", calendar.slot_hour("slot"), T.travel_minutes("hours") / 60)
    ends = F.array(F.struct(F.col("source").alias("hub"), F.col("day").alias("at")), F.struct(F.col("destination").alias("hub"), arrival.alias("at")))
    return t.select("vehicles", F.inline(ends)).groupBy("hub", F.col("at").alias("day")).agg(F.sum("vehicles").alias("trucks"))


@query("truck_ledger", f"WITH {ASSIGNED}, {TRUCKS} SELECT hub, day, CAST(trucks AS BIGINT) AS trucks FROM tr")
def truck_ledger(spark, sf):
    return truck_ledger_of(buckets(assignments(spark, sf)))


@query("capacity_utilisation", f"""
    WITH {HANDLED}, {TRUCKS}, g AS (SELECT hub, handling, trucks AS cap, day FROM hub_capacity, (SELECT DISTINCT day FROM demands))
    SELECT hub, day, 'handling' AS kind, round(coalesce(handled, 0), 4) AS used, handling AS capacity, round(coalesce(handled, 0) / handling * 100, 6) AS pct FROM g LEFT JOIN hd USING (hub, day)
    UNION ALL SELECT hub, day, 'truck', coalesce(trucks, 0), CAST(cap AS DOUBLE), round(coalesce(trucks, 0) / cap * 100, 6) FROM g LEFT JOIN tr USING (hub, day)""")
def capacity_utilisation(spark, sf):
    """Use of each hub, day and kind of capacity; unused ones have 0."""
    b = buckets(assignments(spark, sf))
    grid = V.demands(spark, sf).select("day").distinct().crossJoin(F.broadcast(V.hub_capacity(spark, sf)))
    kinds = ((handling_ledger_of(b).withColumnRenamed("handled", "used"), "handling", F.col("handling")), (truck_ledger_of(b).select("hub", "day", F.col("trucks").cast("double").alias("used")), "truck", F.col("trucks").cast("double")))
    out = [grid.join(ledger, ["hub", "day"], "left").select("hub", "day", F.lit(kind).alias("kind"), F.round(F.coalesce("used", F.lit(0.0)), 4).alias("used"), cap.alias("capacity"), F.round(F.coalesce("used", F.lit(0.0)) / cap * 100, 6).alias("pct")) for ledger, kind, cap in kinds]
    return out[0].unionByName(out[1])


@query("headroom", f"WITH {HANDLED} SELECT hub, day, round(handling - handled, 4) AS room FROM hd JOIN hub_capacity USING (hub)")
def headroom(spark, sf):
    cap = F.broadcast(V.hub_capacity(spark, sf).select("hub", "handling"))
    room = F.coalesce("handling", F.lit(float("inf"))) - F.col("handled")
    return handling_ledger_of(buckets(assignments(spark, sf))).join(cap, "hub", "left").select("hub", "day", F.round(room, 4).alias("room"))


@query("ledger_violations", f"""
    WITH {HANDLED}, {TRUCKS} SELECT hub, day, 'handling' AS kind, round(handled - handling, 4) AS excess FROM hd JOIN hub_capacity USING (hub) WHERE handled > handling + 1e-6
    UNION ALL SELECT hub, day, 'truck', CAST(tr.trucks - h.trucks AS DOUBLE) FROM tr JOIN hub_capacity h USING (hub) WHERE tr.trucks > h.trucks""")
def ledger_violations(spark, sf):
    """Hub-days whose ledgers are over capacity."""
    b = buckets(assignments(spark, sf))
    handled = handling_ledger_of(b).select("hub", "day", F.lit("handling").alias("kind"), F.col("handled").alias("used"))
    trucks = truck_ledger_of(b).select("hub", "day", F.lit("truck").alias("kind"), F.col("trucks").cast("double").alias("used"))
    return over_capacity(handled.unionByName(trucks), V.hub_capacity(spark, sf))


def over_capacity(used, hubs):
    """hub, day, kind, excess of hub, day, kind, used; hubs without a figure have no limit."""
    cap = hubs.select("hub", F.inline(F.array(F.struct(F.lit("handling").alias("kind"), F.col("handling").alias("capacity")), F.struct(F.lit("truck").alias("kind"), F.col("trucks").cast("double").alias("capacity")))))
    return used.join(F.broadcast(cap), ["hub", "kind"]).where("used > capacity + 1e-6").select("hub", "day", "kind", F.round(F.col("used") - F.col("capacity"), 4).alias("excess"))


#: Legs at their real times: a vehicle leaves when its whole load is in. Rented trucks go at 09:00 each day, all of them, also empty.
REAL = f"""
    {ASSIGNED},
    rd AS (SELECT source, destination, day, sum(volume) AS volume FROM asg WHERE is_rental GROUP BY ALL),
    rl AS MATERIALIZED (SELECT r.source, r.destination, d.day, '09:00' AS slot, r.vehicle_type, coalesce(rd.volume, 0) AS volume, r.vehicle_count AS vehicles, v.hours
      FROM rentals r JOIN lane_vehicle v ON v.source = r.source AND v.destination = r.destination AND v.vehicle_type = r.vehicle_type CROSS JOIN (SELECT DISTINCT day FROM demands) d
      LEFT JOIN rd ON rd.source = r.source AND rd.destination = r.destination AND rd.day = d.day),
    lg AS (SELECT source, destination, day, slot, vehicle_type, volume, vehicles, hours FROM bk WHERE NOT is_rental UNION ALL SELECT * FROM rl),
    lm AS (SELECT *, CAST(day AS TIMESTAMP) + to_hours({HOUR}) AS slot_at, CAST(ceil(round(volume * 0.01, 9)) AS BIGINT) AS minutes, CAST(ceil(round(hours * 60, 9)) AS BIGINT) AS travel FROM lg),
    ro AS (SELECT source AS hub, slot_at AS began, volume, minutes FROM lm WHERE volume > 1e-9 UNION ALL SELECT destination, slot_at + to_minutes(minutes + travel), volume, minutes FROM lm WHERE volume > 1e-9),
    rp AS (SELECT *, began + to_minutes(minutes) AS done, unnest(generate_series(date_trunc('day', began), date_trunc('day', began + to_minutes(minutes) - INTERVAL 1 SECOND), INTERVAL 1 DAY)) AS m FROM ro),
    ru AS (SELECT hub, CAST(m AS DATE) AS day, 'handling' AS kind, sum(volume * (epoch(least(done, m + INTERVAL 1 DAY)) - epoch(greatest(began, m))) / (minutes * 60)) AS used FROM rp GROUP BY ALL
      UNION ALL SELECT hub, day, 'truck', CAST(sum(vehicles) AS DOUBLE) FROM (SELECT source AS hub, CAST(slot_at + to_minutes(minutes) AS DATE) AS day, vehicles FROM lm WHERE vehicle_type = 'Tır'
        UNION ALL SELECT destination, CAST(slot_at + to_minutes(minutes + travel) AS DATE), vehicles FROM lm WHERE vehicle_type = 'Tır') GROUP BY ALL)"""


def real_usage(spark, sf):
    """hub, day, kind, used: handling by the minutes it takes, and trucks on the days they leave and arrive, with loading time."""
    a, leg = assignments(spark, sf), ["source", "destination", "day", "slot", "vehicle_type", "volume", "vehicles", "hours"]
    spot = buckets(a.where("not is_rental")).select(leg)
    stock = F.broadcast(V.rentals(spark, sf).join(V.lane_vehicle(spark, sf).select("source", "destination", "vehicle_type", "hours"), ["source", "destination", "vehicle_type"]))
    loads = a.where("is_rental").groupBy("source", "destination", "day").agg(F.sum("volume").alias("load"))
    rented = stock.crossJoin(V.demands(spark, sf).select("day").distinct()).join(loads, ["source", "destination", "day"], "left")
    rented = rented.withColumns({"slot": F.lit("09:00"), "volume": F.coalesce("load", F.lit(0.0)), "vehicles": F.col("vehicle_count")})
    d = spot.unionByName(rented.select(leg)).withColumns({"at": calendar.slot_timestamp("day", "slot"), "minutes": T.handling_minutes("volume")})
    d = d.withColumns({"leaves": T.plus_minutes("at", "minutes"), "arrives": T.plus_minutes("at", F.col("minutes") + T.travel_minutes("hours"))})
    ends = F.array(F.struct(F.col("source").alias("hub"), F.col("at").alias("began"), F.col("leaves").alias("moves")), F.struct(F.col("destination").alias("hub"), F.col("arrives").alias("began"), F.col("arrives").alias("moves")))
    d = d.select("vehicle_type", "volume", "vehicles", "minutes", F.inline(ends))
    handled = split_at_midnight(d.where("volume > 1e-9"), "began", "minutes", "volume").groupBy("hub", "day").agg(F.sum("share").alias("used"))
    trucks = d.where("vehicle_type = 'Tır'").groupBy("hub", F.to_date("moves").alias("day")).agg(F.sum("vehicles").cast("double").alias("used"))
    return handled.withColumn("kind", F.lit("handling")).unionByName(trucks.withColumn("kind", F.lit("truck")))


@query("real_capacity_usage", f"WITH {REAL} SELECT hub, day, kind, round(used, 4) AS used FROM ru")
def real_capacity_usage(spark, sf):
    return real_usage(spark, sf).select("hub", "day", "kind", R("used"))


@query("real_capacity_violations", f"WITH {REAL} SELECT ru.hub, ru.day, ru.kind, round(used - CASE kind WHEN 'truck' THEN trucks ELSE handling END, 4) AS excess FROM ru JOIN hub_capacity h ON h.hub = ru.hub WHERE used > CASE kind WHEN 'truck' THEN trucks ELSE handling END + 1e-6")
def real_capacity_violations(spark, sf):
    return over_capacity(real_usage(spark, sf), V.hub_capacity(spark, sf))


@query("overloaded_hub_days", f"WITH {HANDLED} SELECT hub, day, round(handled / handling, 6) AS load FROM hd JOIN hub_capacity USING (hub) WHERE handled > 0.85 * handling")
def overloaded_hub_days(spark, sf):
    cap = F.broadcast(V.hub_capacity(spark, sf).select("hub", "handling"))
    return handling_ledger_of(buckets(assignments(spark, sf))).join(cap, "hub").where("handled > 0.85 * handling").select("hub", "day", F.round(F.col("handled") / F.col("handling"), 6).alias("load"))


@query("eviction_set", f"""
    WITH {HANDLED}, x AS (SELECT hub, day, handled - handling AS excess FROM hd JOIN hub_capacity USING (hub) WHERE handled > handling + 1e-6),
    o AS (SELECT d.demand_id, d.volume, x.*, coalesce(sum(volume) OVER (PARTITION BY hub, x.day ORDER BY volume, demand_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM demands d JOIN x ON x.hub = d.source AND x.day = d.day)
    SELECT hub, day, demand_id FROM o WHERE before < excess""")
def eviction_set(spark, sf):
    """Of overloaded hub-days the smallest outgoing demands that cover the excess."""
    cap = F.broadcast(V.hub_capacity(spark, sf).select("hub", "handling"))
    over = handling_ledger_of(buckets(assignments(spark, sf))).join(cap, "hub").where("handled > handling + 1e-6").select(F.col("hub").alias("source"), "day", (F.col("handled") - F.col("handling")).alias("excess"))
    return N.evictions(V.demands(spark, sf).join(over, ["source", "day"]), ["source", "day"], "excess").select(F.col("source").alias("hub"), "day", "demand_id")


@query("idle_rental_rows", f"""
    WITH {ASSIGNED}, u AS (SELECT source, destination, day, sum(volume) AS v FROM asg WHERE is_rental GROUP BY ALL), g AS (SELECT r.*, d.day FROM rentals r, (SELECT DISTINCT day FROM demands) d)
    SELECT source, destination, day, CAST(unnest(range(1, CAST(vehicle_count - ceil(coalesce(v, 0) / 22400 - 1e-9) AS BIGINT) + 1)) AS INTEGER) AS idle FROM g LEFT JOIN u USING (source, destination, day)""")
def idle_rental_rows(spark, sf):
    """A row for each rented vehicle that stays empty on a day."""
    used = assignments(spark, sf).where("is_rental").groupBy("source", "destination", "day").agg(F.sum("volume").alias("v"))
    grid = F.broadcast(V.rentals(spark, sf)).crossJoin(V.demands(spark, sf).select("day").distinct())
    idle = F.col("vehicle_count") - F.ceil(F.coalesce("v", F.lit(0.0)) / 22400 - T.SLACK).cast("int")
    return grid.join(used, ["source", "destination", "day"], "left").withColumn("n", idle).where("n > 0").select("source", "destination", "day", F.explode(F.sequence(F.lit(1), "n")).alias("idle"))


@query("leg_map_summary", f"WITH {ASSIGNED} SELECT source, destination, vehicle_type, sum(volume) AS volume, array_to_string(list_sort(list(DISTINCT slot)), ', ') AS slots, count(DISTINCT is_rental) AS kinds FROM asg GROUP BY ALL")
def leg_map_summary(spark, sf):
    return assignments(spark, sf).groupBy("source", "destination", "vehicle_type").agg(F.sum("volume").alias("volume"), F.array_join(F.array_sort(F.collect_set("slot")), ", ").alias("slots"), F.count_distinct("is_rental").alias("kinds"))


@query("merge_duplicates", f"WITH {ASSIGNED} SELECT source, destination, day, vehicle_type, sum(volume) AS volume, count(*) AS n FROM asg GROUP BY ALL")
def merge_duplicates(spark, sf):
    """Assignments of a day with the same sequence of legs as one: arrays of structs are grouping keys."""
    legs = F.array(F.struct("source", "destination", "vehicle_type"))
    out = assignments(spark, sf).groupBy("day", legs.alias("legs")).agg(F.sum("volume").alias("volume"), F.count("*").alias("n"))
    return out.select(F.col("legs")[0]["source"].alias("source"), F.col("legs")[0]["destination"].alias("destination"), "day", F.col("legs")[0]["vehicle_type"].alias("vehicle_type"), "volume", "n")


@query("empty_rental_union", f"""
    WITH {SPLIT}, u AS (SELECT source, destination, day, sum(volume) AS v FROM asg WHERE is_rental GROUP BY ALL), g AS (SELECT r.*, d.day FROM rentals r, (SELECT DISTINCT day FROM demands) d)
    SELECT source, destination, day, vehicle_type, demand_id, round(share, 6) AS volume FROM sh WHERE share > 0.001
    UNION ALL SELECT source, destination, day, 'Tır', '', 0 FROM (SELECT *, unnest(range(1, CAST(vehicle_count - ceil(coalesce(v, 0) / 22400 - 1e-9) AS BIGINT) + 1)) AS idle FROM g LEFT JOIN u USING (source, destination, day))""")
def empty_rental_union(spark, sf):
    """The plan's pieces, and a row without demand for each rented vehicle that runs empty."""
    plan = vehicle_shares(spark, sf).select("source", "destination", "day", "vehicle_type", "demand_id", R("share", 6).alias("volume"))
    empty = idle_rental_rows(spark, sf).select("source", "destination", "day", F.lit("Tır").alias("vehicle_type"), F.lit("").alias("demand_id"), F.lit(0.0).alias("volume"))
    return plan.unionByName(empty)
