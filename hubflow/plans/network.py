"""Queries: paths, vehicle choice, allocation and dispatch."""

from pyspark.sql import functions as F

from hubflow import adapters as V
from hubflow.catalog import query
from hubflow.functions import timecost as T
from hubflow.operators import calendar
from hubflow.operators import network as N
from hubflow.operators import options as O
from hubflow.plans.dates import HOUR

R = lambda c, n=4: F.round(c, n).alias(c)

RELAYS = """
    o0 AS (SELECT a.source, b.destination, a.destination AS r, a.distance_km AS d1, a.distance_km + b.distance_km AS km FROM lanes a JOIN lanes b ON a.destination = b.source JOIN lanes d ON d.source = a.source AND d.destination = b.destination
      WHERE a.distance_km + b.distance_km <= d.distance_km * 1.35),
    o1 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source, destination ORDER BY km, r) AS rank FROM o0),
    one AS MATERIALIZED (SELECT * FROM o1 WHERE rank <= 4),
    t0 AS (SELECT one.source, one.destination, one.r, c.destination AS s, d1 + c.distance_km + e.distance_km AS km FROM one JOIN lanes c ON c.source = one.r JOIN lanes e ON e.source = c.destination AND e.destination = one.destination
      WHERE c.destination <> one.source AND c.destination <> one.destination),
    t1 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source, destination ORDER BY km, r, s) AS rank FROM t0),
    relays AS MATERIALIZED (SELECT source, destination, [source, r, destination] AS path, km, rank, 1 AS relays FROM one UNION ALL SELECT source, destination, [source, r, s, destination], km, rank, 2 FROM t1 WHERE rank <= 3)"""


@query("relay_candidates", f"WITH {RELAYS} SELECT source, destination, array_to_string(path, '>') AS path, km, CAST(rank AS INTEGER) AS rank, relays FROM relays")
def relay_candidates(spark, sf):
    d = N.relay_candidates(V.lanes(spark, sf))
    return d.withColumn("path", F.concat_ws(">", "path"))


@query("top_relays", f"WITH {RELAYS} SELECT source, destination, km FROM relays WHERE relays = 1 AND rank = 1")
def top_relays(spark, sf):
    return N.relay_candidates(V.lanes(spark, sf)).where("relays = 1 AND rank = 1").select("source", "destination", "km")


OPTIONS = "options AS (SELECT source, destination, [source, destination] AS path, FALSE AS milk_run FROM lanes UNION ALL SELECT source, destination, path, m FROM relays, (SELECT unnest([FALSE, TRUE]) AS m))"


@query("path_options", f"WITH {RELAYS}, {OPTIONS} SELECT source, destination, array_to_string(path, '>') AS path, milk_run FROM options")
def path_options(spark, sf):
    lanes = V.lanes(spark, sf)
    return N.path_options(lanes, N.relay_candidates(lanes)).withColumn("path", F.concat_ws(">", "path"))


RANKED = """
    c AS MATERIALIZED (SELECT d.demand_id, d.day, d.volume, v.vehicle_type, v.capacity, CAST(ceil(d.volume / v.capacity - 1e-9) AS INTEGER) AS vehicles,
      ceil(d.volume / v.capacity - 1e-9) * round_even(v.spot_hourly * v.hours + v.spot_km * v.distance_km, 0) + round_even(2 * ceil(round(d.volume * 0.01, 9)) / 60 * v.spot_hourly, 0) AS cost
      FROM demands d JOIN lane_vehicle v ON v.source = d.source AND v.destination = d.destination),
    k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY demand_id ORDER BY cost, capacity DESC) AS rank FROM c)"""


def ranked(spark, sf):
    rows = V.demands(spark, sf).join(F.broadcast(V.lane_vehicle(spark, sf)), ["source", "destination"])
    return N.rank_vehicle_types(rows, ["demand_id"])


@query("rank_vehicle_types", f"WITH {RANKED} SELECT demand_id, vehicle_type, vehicles, cost, CAST(rank AS INTEGER) AS rank FROM k")
def rank_vehicle_types(spark, sf):
    return ranked(spark, sf).select("demand_id", "vehicle_type", "vehicles", "cost", "rank")


@query("best_second_regret", f"""
    WITH {RANKED}, b AS (SELECT demand_id, volume, min(cost) AS first, min(cost) FILTER (rank = 2) AS second FROM k GROUP BY ALL)
    SELECT demand_id, round(coalesce((second - first) / volume, 1e9) * volume, 4) AS regret FROM b""")
def best_second_regret(spark, sf):
    """How much the second-best vehicle type costs more."""
    b = ranked(spark, sf).groupBy("demand_id", "volume").agg(F.min("cost").alias("first"), F.min(F.when(F.col("rank") == 2, F.col("cost"))).alias("second"))
    unit = F.coalesce((F.col("second") - F.col("first")) / F.col("volume"), F.lit(1e9))
    return b.select("demand_id", F.round(unit * F.col("volume"), 4).alias("regret"))


OPTION_COST = f"""
    {RELAYS}, {OPTIONS},
    s AS MATERIALIZED (SELECT source, destination, array_to_string(path, '>') AS option, milk_run, len(path) AS stops, unnest(range(1, len(path))) AS i, path FROM options),
    l AS MATERIALIZED (SELECT d.demand_id, d.volume, s.option, s.milk_run, s.i, v.vehicle_type, v.hours,
      ceil(d.volume / v.capacity - 1e-9) * round_even(v.spot_hourly * v.hours + v.spot_km * v.distance_km, 0)
      + round_even(CASE WHEN s.milk_run THEN CAST(s.i = 1 AS INTEGER) + CAST(s.i = s.stops - 1 AS INTEGER) ELSE 2 END * ceil(round(d.volume * 0.01, 9)) / 60 * v.spot_hourly, 0) AS c
      FROM demands d JOIN s ON s.source = d.source AND s.destination = d.destination JOIN lane_vehicle v ON v.source = s.path[s.i] AND v.destination = s.path[s.i + 1]),
    p AS MATERIALIZED (SELECT demand_id, option, milk_run, CASE WHEN milk_run THEN 0 ELSE i END AS part, vehicle_type, sum(c) AS c, sum(hours) AS h, max(volume) AS volume FROM l GROUP BY ALL),
    q AS MATERIALIZED (SELECT demand_id, option, milk_run, part, min(c) AS c, min(h) AS h, max(volume) AS volume FROM p GROUP BY ALL),
    cost AS MATERIALIZED (SELECT demand_id, option, milk_run, sum(c) AS cost, sum(h) AS hours, max(volume) AS volume FROM q GROUP BY ALL)"""


def options(spark, sf):
    """All demands, the options of each lane, and the vehicle types of each leg."""
    lanes = V.lanes(spark, sf)
    return V.demands(spark, sf).select("demand_id", "source", "destination", "volume"), N.path_options(lanes, N.relay_candidates(lanes)), V.lane_vehicle(spark, sf)


@query("option_cost", f"WITH {OPTION_COST} SELECT demand_id, option, milk_run, cost, round(hours, 4) AS hours FROM cost")
def option_cost(spark, sf):
    return N.option_costs(*options(spark, sf)).select("demand_id", "option", "milk_run", "cost", R("hours"))


@query("best_option", f"WITH {OPTION_COST}, k AS (SELECT *, row_number() OVER (PARTITION BY demand_id ORDER BY cost / volume, hours, option, milk_run) AS n FROM cost) SELECT demand_id, option, milk_run, cost FROM k WHERE n = 1")
def best_option(spark, sf):
    return N.best_options(*options(spark, sf))


RENTED = """
    a AS MATERIALIZED (SELECT d.*, coalesce(r.vehicle_count, 0) * 22400 AS stock FROM demands d LEFT JOIN rentals r ON r.source = d.source AND r.destination = d.destination),
    w AS MATERIALIZED (SELECT *, coalesce(sum(volume) OVER (PARTITION BY source, destination, day ORDER BY volume DESC, demand_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM a)"""


@query("rental_first_allocation", f"WITH {RENTED} SELECT demand_id, greatest(0, least(volume, stock - used)) AS rental_volume, volume - greatest(0, least(volume, stock - used)) AS spot_volume FROM w")
def rental_first_allocation(spark, sf):
    d = V.demands(spark, sf).join(F.broadcast(V.rentals(spark, sf).select("source", "destination", "vehicle_count")), ["source", "destination"], "left")
    d = d.withColumn("stock", F.coalesce("vehicle_count", F.lit(0)) * 22400.0)
    return N.waterfall(d, ["source", "destination", "day"], "stock").select("demand_id", "rental_volume", "spot_volume")


_next = lambda at, hours: f"(CAST(floor(({at} + {hours} * 3600) / 86400) * 86400 AS BIGINT) + CASE WHEN {at} + {hours} * 3600 - floor(({at} + {hours} * 3600) / 86400) * 86400 < 32400 THEN 32400 WHEN {at} + {hours} * 3600 - floor(({at} + {hours} * 3600) / 86400) * 86400 < 61200 THEN 61200 ELSE 118800 END)"
OPTION_TOTAL = f"""
    {RELAYS}, {OPTIONS},
    ds AS MATERIALIZED (SELECT d.*, l.target_days, CAST(epoch(CAST(d.day AS TIMESTAMP) + to_hours({HOUR})) AS BIGINT) AS slot_at, CAST(ceil(round(d.volume * 0.01, 9)) AS BIGINT) AS hm, CAST(ceil(round(d.volume * 0.01 * 2, 9)) AS BIGINT) AS hm2,
        CASE WHEN r.vehicle_count IS NOT NULL AND slot = '09:00' THEN greatest(0, least(d.volume, r.vehicle_count * t.capacity - coalesce(sum(d.volume) OVER (PARTITION BY d.source, d.destination, d.day, slot ORDER BY d.volume DESC, demand_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) ELSE 0 END AS rented,
        t.spot_hourly AS truck_hourly, CAST(ceil(round(t.hours * 60, 9)) AS BIGINT) AS truck_minutes
      FROM demands d JOIN lanes l ON l.source = d.source AND l.destination = d.destination LEFT JOIN rentals r ON r.source = d.source AND r.destination = d.destination LEFT JOIN lane_vehicle t ON t.source = d.source AND t.destination = d.destination AND t.vehicle_type = 'Tır'),
    os AS MATERIALIZED (SELECT source, destination, array_to_string(path, '>') AS option, milk_run, len(path) AS stops, unnest(range(1, len(path))) AS i, path FROM options),
    oy AS MATERIALIZED (SELECT os.source, os.destination, option, milk_run, stops, CASE WHEN milk_run THEN 0 ELSE i - 1 END AS part, v.vehicle_type, any_value(v.capacity) AS capacity, any_value(v.spot_hourly) AS h, sum(v.hours) AS hours, CAST(sum(ceil(round(v.hours * 60, 9))) AS BIGINT) AS minutes,
        list(round_even(v.spot_hourly * v.hours + v.spot_km * v.distance_km, 0)) AS drives, list(CASE WHEN milk_run THEN CAST(i = 1 AS INTEGER) + CAST(i = stops - 1 AS INTEGER) ELSE 2 END) AS touches
      FROM os JOIN lane_vehicle v ON v.source = path[i] AND v.destination = path[i + 1] GROUP BY os.source, os.destination, option, milk_run, stops, CASE WHEN milk_run THEN 0 ELSE i - 1 END, v.vehicle_type),
    oc AS (SELECT ds.*, y.option, y.milk_run, y.stops, y.part, y.hours, y.minutes, y.vehicle_type, CASE WHEN stops = 2 THEN volume - rented ELSE volume END AS spot, y.capacity, y.h, y.drives, y.touches FROM ds JOIN oy y ON y.source = ds.source AND y.destination = ds.destination),
    od AS (SELECT *, ceil(spot / capacity - 1e-9) * list_sum(drives) + list_sum([round_even(k * ceil(round(spot * 0.01, 9)) / 60 * h, 0) FOR k IN touches]) AS c FROM oc),
    ob AS MATERIALIZED (SELECT * FROM od QUALIFY row_number() OVER (PARTITION BY demand_id, option, milk_run, part ORDER BY c, hours, vehicle_type) = 1),
    ow AS MATERIALIZED (SELECT demand_id, option, milk_run, any_value(stops) AS stops, any_value(volume) AS volume, any_value(rented) AS rented, any_value(slot_at) AS slot_at, any_value(target_days) AS target_days, any_value(hm) AS hm, any_value(hm2) AS hm2, any_value(truck_hourly) AS truck_hourly, any_value(truck_minutes) AS truck_minutes,
        sum(c) AS spot_cost, max(spot) AS spot, {', '.join(f"max(hours) FILTER (part = {k}) AS h{k}, max(minutes) FILTER (part = {k}) AS m{k}" for k in range(3))} FROM ob GROUP BY demand_id, option, milk_run),
    z1 AS (SELECT *, slot_at + 60 * hm + 60 * CASE WHEN stops = 2 AND rented > 1e-9 THEN CASE WHEN spot > 1e-9 THEN greatest(m0, truck_minutes) ELSE truck_minutes END ELSE m0 END AS d0, {_next('slot_at', 'h0')} AS at1 FROM ow),
    z2 AS (SELECT *, CASE WHEN h1 IS NULL THEN d0 ELSE greatest(at1, d0 + 60 * hm2) + 60 * m1 END AS d1, {_next('at1', 'h1')} AS at2 FROM z1),
    z3 AS (SELECT *, CASE WHEN h2 IS NULL THEN d1 ELSE greatest(at2, d1 + 60 * hm2) + 60 * m2 END AS d2 FROM z2),
    z4 AS (SELECT *, spot_cost + CASE WHEN stops = 2 AND rented > 1e-9 THEN round_even(2 * ceil(round(rented * 0.01, 9)) / 60 * truck_hourly, 0) ELSE 0 END AS cost, CAST(greatest(0, ceil((d2 + 60 * hm - slot_at - target_days * 86400) / 3600)) AS INTEGER) AS late_hours FROM z3),
    tot AS MATERIALIZED (SELECT demand_id, volume, option, milk_run, cost, late_hours, round(volume * late_hours * 0.4, 2) AS penalty, cost + round(volume * late_hours * 0.4, 2) AS total FROM z4)"""


def total_inputs(spark, sf):
    lanes = V.lanes(spark, sf)
    return V.demands(spark, sf), N.path_options(lanes, N.relay_candidates(lanes)), V.lane_vehicle(spark, sf), lanes, V.rentals(spark, sf), V.VEHICLES[0][0]


@query("option_total", f"WITH {OPTION_TOTAL} SELECT demand_id, option, milk_run, cost, late_hours, penalty, total FROM tot")
def option_total(spark, sf):
    """What each way of carrying each demand costs with its delay, rented trucks first."""
    return O.option_totals(*total_inputs(spark, sf))


@query("best_total", f"WITH {OPTION_TOTAL}, k AS (SELECT *, row_number() OVER (PARTITION BY demand_id ORDER BY total / volume, option, milk_run) AS n FROM tot) SELECT demand_id, option, milk_run, cost, penalty, total FROM k WHERE n = 1")
def best_total(spark, sf):
    return O.best_totals(*total_inputs(spark, sf))


@query("related_demands", """
    WITH seed AS (SELECT * FROM demands ORDER BY volume DESC, demand_id LIMIT 1)
    SELECT d.demand_id, CASE WHEN d.source = s.source AND d.destination = s.destination THEN 10 ELSE 3 * (CAST(d.source = s.source AS INTEGER) + CAST(d.destination = s.destination AS INTEGER)) END
      + CASE WHEN d.day = s.day THEN 5 + 2 * CAST(d.slot = s.slot AS INTEGER) ELSE 0 END AS relatedness FROM demands d, seed s WHERE d.demand_id <> s.demand_id ORDER BY relatedness DESC, d.demand_id LIMIT 50""")
def related_demands(spark, sf):
    """The 50 demands most related to the largest one."""
    d = V.demands(spark, sf)
    names = ("demand_id", "source", "destination", "day", "slot")
    seed = F.broadcast(d.orderBy(F.desc("volume"), "demand_id").limit(1).select(*(F.col(c).alias(f"s_{c}") for c in names)))
    same = lambda c: (F.col(c) == F.col(f"s_{c}")).cast("int")
    lane = F.when(same("source") + same("destination") == 2, 10).otherwise(3 * (same("source") + same("destination")))
    score = lane + F.when(F.col("day") == F.col("s_day"), 5 + 2 * same("slot")).otherwise(0)
    return d.crossJoin(seed).where("demand_id != s_demand_id").select("demand_id", score.alias("relatedness")).orderBy(F.desc("relatedness"), "demand_id").limit(50)


@query("worst_assignments", f"WITH {RANKED} SELECT demand_id, cost FROM k WHERE rank = 1 ORDER BY cost DESC, demand_id LIMIT (SELECT CAST(greatest(1, floor(0.04 * count(*))) AS BIGINT) FROM demands)")
def worst_assignments(spark, sf):
    """The dearest 4 % of best choices."""
    best = ranked(spark, sf).where("rank = 1").select("demand_id", "cost")
    n = max(1, int(0.04 * V.demands(spark, sf).count()))
    return best.orderBy(F.desc("cost"), "demand_id").limit(n)


def relayed(spark, sf):
    """Demands by their shortest relay: two legs, with the fastest vehicle's hours of each."""
    best = N.relay_candidates(V.lanes(spark, sf)).where("relays = 1 AND rank = 1").select("source", "destination", F.col("path")[1].alias("r"))
    fast = V.lane_vehicle(spark, sf).where("vehicle_type = 'Kamyonet'")
    one = fast.select("source", F.col("destination").alias("r"), F.col("hours").alias("h1"))
    two = fast.select(F.col("source").alias("r"), "destination", F.col("hours").alias("h2"))
    legs = F.broadcast(best.join(one, ["source", "r"]).join(two, ["r", "destination"]))
    return V.demands(spark, sf).join(legs, ["source", "destination"])


RELAYED = f"""
    {RELAYS}, rl AS (SELECT d.*, r.path[2] AS r, a.hours AS h1, b.hours AS h2, CAST(d.day AS TIMESTAMP) + to_hours({HOUR}) AS began FROM demands d JOIN relays r ON r.source = d.source AND r.destination = d.destination AND r.relays = 1 AND r.rank = 1
      JOIN lane_vehicle a ON a.source = d.source AND a.destination = r.path[2] AND a.vehicle_type = 'Kamyonet' JOIN lane_vehicle b ON b.source = r.path[2] AND b.destination = d.destination AND b.vehicle_type = 'Kamyonet')"""


@query("leg_schedule", f"""
    WITH {RELAYED}, t AS (SELECT *, {HOUR} + h1 AS total FROM rl)
    SELECT demand_id, CAST(day + CAST(floor(total / 24) AS INTEGER) + CASE WHEN total - 24 * floor(total / 24) < 17 THEN 0 ELSE 1 END AS DATE) AS second_day,
           CASE WHEN total - 24 * floor(total / 24) < 9 THEN '09:00' WHEN total - 24 * floor(total / 24) < 17 THEN '17:00' ELSE '09:00' END AS second_slot FROM t""")
def leg_schedule(spark, sf):
    """Day and slot of the second leg of each demand's shortest relay."""
    day, slot = T.next_dispatch("day", calendar.slot_hour("slot"), "h1")
    return relayed(spark, sf).select("demand_id", day.alias("second_day"), slot.alias("second_slot"))


@query("leg_timetable", f"""
    WITH {RELAYED}, a AS (SELECT *, CAST(ceil(round(volume * 0.01, 9)) AS BIGINT) AS hm FROM rl), b AS (SELECT *, began + to_minutes(hm) AS depart_1, began + to_minutes(hm + CAST(ceil(round(h1 * 60, 9)) AS BIGINT)) AS arrive_1 FROM a)
    SELECT demand_id, depart_1, arrive_1, arrive_1 + to_minutes(2 * hm) AS depart_2, arrive_1 + to_minutes(2 * hm + CAST(ceil(round(h2 * 60, 9)) AS BIGINT)) AS arrive_2 FROM b""")
def leg_timetable(spark, sf):
    """Departures and arrivals along a relay: after loading, and after unloading and loading again."""
    d = relayed(spark, sf).withColumn("began", calendar.slot_timestamp("day", "slot")).withColumn("hm", T.handling_minutes("volume"))
    d = d.withColumn("depart_1", T.plus_minutes("began", "hm")).withColumn("arrive_1", T.plus_minutes("depart_1", T.travel_minutes("h1")))
    d = d.withColumn("depart_2", T.plus_minutes("arrive_1", F.col("hm") * 2)).withColumn("arrive_2", T.plus_minutes("depart_2", T.travel_minutes("h2")))
    return d.select("demand_id", "depart_1", "arrive_1", "depart_2", "arrive_2")
