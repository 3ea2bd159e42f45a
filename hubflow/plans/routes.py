"""Queries: the plan of several legs, its times, costs and penalties, and what it breaks.

The plan is a deterministic one: a lane goes direct, by one relay, by two, or as a milk run, by a rule on its hubs' keys;
lanes with a contract go direct, and every 97th demand is left behind, so that each kind of route and of cost occurs.
"""

from pyspark.sql import functions as F

from hubflow import adapters as V
from hubflow.catalog import query
from hubflow.functions import timecost as T
from hubflow.operators import network as N
from hubflow.operators import runs
from hubflow.plans.dates import HOUR, split_at_midnight
from hubflow.plans.formulas import fixed_trucks
from hubflow.plans.network import RELAYS
from hubflow.session import cut_lineage, release

RENTED_TYPE, TRUCK = V.VEHICLES[0][:2]
R = lambda c, n=4: F.round(c, n).alias(c)

_rule = "(a.k * 7 + b.k * 3) % 6"
_step = lambda run, before: f"""SELECT ty.*, CAST(b.day + CAST(floor(({HOUR.replace('slot', 'b.slot')} + b.hours) / 24) AS INTEGER) + CASE WHEN ({HOUR.replace('slot', 'b.slot')} + b.hours) - 24 * floor(({HOUR.replace('slot', 'b.slot')} + b.hours) / 24) < 17 THEN 0 ELSE 1 END AS DATE) AS day,
      CASE WHEN ({HOUR.replace('slot', 'b.slot')} + b.hours) - 24 * floor(({HOUR.replace('slot', 'b.slot')} + b.hours) / 24) BETWEEN 9 AND 16.999999 THEN '17:00' ELSE '09:00' END AS slot FROM ty JOIN {before} b ON b.demand_id = ty.demand_id AND b.is_rental = ty.is_rental WHERE ty.run = {run}"""  # noqa: E731
_same_vehicle = "PARTITION BY trip, day, slot, vehicle_type, is_rental, run, vehicle"
_timed = lambda run, fed: f"""SELECT pc.*, max(greatest(slot_at + 60 * CAST(ceil(round(load * 0.01, 9)) AS BIGINT), {'coalesce(fed + 60 * CAST(ceil(round(share * 0.01 * 2, 9)) AS BIGINT), 0)' if fed else '0'})) OVER ({_same_vehicle}) AS departs FROM pc{f' LEFT JOIN {fed} f ON fed_demand = demand_id AND fed_rental = is_rental' if fed else ''} WHERE run = {run}"""
_fed = lambda times, run: f"(SELECT demand_id AS fed_demand, is_rental AS fed_rental, max(departs + 60 * CAST(list_sum(minutes) AS BIGINT)) AS fed FROM {times} WHERE runs > {run} + 1 GROUP BY ALL)"

PIECES = f"""
    {RELAYS},
    nk AS (SELECT n_name AS name, n_nationkey AS k FROM nation),
    ro AS MATERIALIZED (SELECT l.source, l.destination, l.target_days, r.source IS NULL AND {_rule} = 1 AND o.path IS NOT NULL AS milk_run,
        CASE WHEN r.source IS NULL AND {_rule} < 2 AND o.path IS NOT NULL THEN o.path WHEN r.source IS NULL AND {_rule} = 2 AND t.path IS NOT NULL THEN t.path ELSE [l.source, l.destination] END AS path
      FROM lanes l JOIN nk a ON a.name = l.source JOIN nk b ON b.name = l.destination LEFT JOIN rentals r ON r.source = l.source AND r.destination = l.destination
      LEFT JOIN relays o ON o.source = l.source AND o.destination = l.destination AND o.relays = 1 AND o.rank = 1 LEFT JOIN relays t ON t.source = l.source AND t.destination = l.destination AND t.relays = 2 AND t.rank = 1),
    rn AS (SELECT *, CASE WHEN milk_run THEN 1 ELSE len(path) - 1 END AS runs, unnest(range(0, CASE WHEN milk_run THEN 1 ELSE len(path) - 1 END)) AS run FROM ro),
    rr AS MATERIALIZED (SELECT * EXCLUDE (path), CASE WHEN milk_run THEN path ELSE path[run + 1:run + 2] END AS hubs FROM rn),
    rl AS (SELECT source, destination, run, hubs, unnest(range(1, len(hubs))) AS j FROM rr),
    ry AS MATERIALIZED (SELECT rl.source, rl.destination, rl.run, v.vehicle_type, any_value(v.capacity) AS capacity, any_value(v.spot_hourly) AS spot_hourly, sum(v.hours) AS hours, sum(round_even(v.spot_hourly * v.hours + v.spot_km * v.distance_km, 0)) AS drive,
        list(round_even(v.spot_hourly * v.hours + v.spot_km * v.distance_km, 0) ORDER BY j) AS drives, list(CAST(ceil(round(v.hours * 60, 9)) AS BIGINT) ORDER BY j) AS minutes
      FROM rl JOIN lane_vehicle v ON v.source = hubs[j] AND v.destination = hubs[j + 1] GROUP BY rl.source, rl.destination, rl.run, v.vehicle_type),
    dl AS MATERIALIZED (SELECT *, (len(demand_id) * 7 + CAST(floor(volume / 1000) AS BIGINT)) % 97 = 0 AS left_behind FROM demands),
    rs AS (SELECT d.*, coalesce(CASE WHEN slot = '09:00' THEN r.vehicle_count END, 0) * {TRUCK} AS stock, coalesce(sum(volume) OVER (PARTITION BY d.source, d.destination, day, slot = '09:00' ORDER BY volume DESC, demand_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
      FROM dl d LEFT JOIN rentals r ON r.source = d.source AND r.destination = d.destination WHERE NOT left_behind),
    lo AS MATERIALIZED (SELECT demand_id, source, destination, day AS asked_day, slot AS asked_slot, TRUE AS is_rental, greatest(0, least(volume, stock - used)) AS volume FROM rs
      UNION ALL SELECT demand_id, source, destination, day, slot, FALSE, volume - greatest(0, least(volume, stock - used)) FROM rs),
    tk AS (SELECT lo.*, rr.run, rr.runs, rr.milk_run, rr.target_days, array_to_string(rr.hubs, '>') AS trip, y.vehicle_type, y.capacity, y.spot_hourly, y.hours, y.drives, y.minutes,
        row_number() OVER (PARTITION BY lo.demand_id, lo.is_rental, rr.run ORDER BY ceil(lo.volume / y.capacity - 1e-9) * y.drive + round_even(2 * ceil(round(lo.volume * 0.01, 9)) / 60 * y.spot_hourly, 0), y.capacity DESC) AS n
      FROM lo JOIN rr ON rr.source = lo.source AND rr.destination = lo.destination JOIN ry y ON y.source = rr.source AND y.destination = rr.destination AND y.run = rr.run WHERE lo.volume > 1e-9 AND (NOT lo.is_rental OR y.vehicle_type = '{RENTED_TYPE}')),
    ty AS MATERIALIZED (SELECT * EXCLUDE (n) FROM tk WHERE n = 1),
    s0 AS MATERIALIZED (SELECT *, asked_day AS day, asked_slot AS slot FROM ty WHERE run = 0),
    s1 AS MATERIALIZED ({_step(1, 's0')}),
    s2 AS MATERIALIZED ({_step(2, 's1')}),
    sx AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2),
    hl AS (SELECT *, sum(volume) OVER (PARTITION BY trip, day, slot, vehicle_type, is_rental, run ORDER BY demand_id) AS hi FROM sx),
    vs AS (SELECT *, unnest(range(CAST(floor((hi - volume) / capacity) AS BIGINT), CAST(greatest(floor((hi - volume) / capacity), ceil(hi / capacity - 1e-9) - 1) AS BIGINT) + 1)) AS vehicle FROM hl),
    sh AS (SELECT *, least(hi, (vehicle + 1) * capacity) - greatest(hi - volume, vehicle * capacity) AS share FROM vs),
    pc AS MATERIALIZED (SELECT *, sum(share) OVER ({_same_vehicle}) AS load, CAST(epoch(CAST(day AS TIMESTAMP) + to_hours({HOUR})) AS BIGINT) AS slot_at FROM sh WHERE share > 0.001),
    k0 AS MATERIALIZED ({_timed(0, None)}),
    k1 AS MATERIALIZED ({_timed(1, _fed('k0', 0))}),
    k2 AS MATERIALIZED ({_timed(2, _fed('k1', 1))}),
    tm AS (SELECT * FROM k0 UNION ALL SELECT * FROM k1 UNION ALL SELECT * FROM k2),
    li AS (SELECT *, string_split(trip, '>') AS hubs, unnest(range(1, len(minutes) + 1)) AS i FROM tm),
    lg AS MATERIALIZED (SELECT *, hubs[i] AS f, hubs[i + 1] AS t, CASE WHEN milk_run THEN i ELSE run + 1 END AS leg, CASE WHEN milk_run THEN len(minutes) ELSE runs END AS legs,
        departs + 60 * coalesce(CAST(list_sum(minutes[1:i - 1]) AS BIGINT), 0) AS leg_departs, departs + 60 * CAST(list_sum(minutes[1:i]) AS BIGINT) AS leg_arrives, i = 1 AS starts, i = len(minutes) AS ends,
        CASE WHEN is_rental THEN 0 ELSE drives[i] END + round_even((CAST(i = 1 AS INTEGER) + CAST(i = len(minutes) AS INTEGER)) * ceil(round(load * 0.01, 9)) / 60 * spot_hourly, 0) AS leg_cost FROM li),
    pf AS MATERIALIZED (SELECT *, CASE WHEN leg = legs THEN round(share * greatest(0, ceil((leg_arrives + 60 * ceil(round(share * 0.01, 9)) - epoch(CAST(asked_day AS TIMESTAMP) + to_hours({HOUR.replace('slot', 'asked_slot')})) - target_days * 86400) / 3600)) * 0.4, 2) ELSE 0 END AS penalty FROM lg)"""

CODES = f"""
    vd AS MATERIALIZED (SELECT DISTINCT trip, day, slot, vehicle_type, is_rental, run, vehicle FROM pc),
    vo AS MATERIALIZED (SELECT *, format('V{{:04d}}', row_number() OVER (ORDER BY day, slot, trip, vehicle_type, is_rental, run, vehicle)) AS code FROM vd)"""
_on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in runs.VEHICLE)


def routes(spark, sf):
    """source, destination, target_days, path, milk_run of each lane (600 rows)."""
    lanes, keys = V.lanes(spark, sf), V.table(spark, sf, "nation")
    best = N.relay_candidates(lanes).where("rank = 1")
    by = [best.where(F.col("relays") == n).select("source", "destination", F.col("path").alias(f"path_{n}")) for n in (1, 2)]
    rented = V.rentals(spark, sf).select("source", "destination", F.lit(True).alias("rented"))
    d = lanes.join(F.broadcast(keys.select(F.col("n_name").alias("source"), F.col("n_nationkey").alias("a"))), "source").join(F.broadcast(keys.select(F.col("n_name").alias("destination"), F.col("n_nationkey").alias("b"))), "destination")
    for other in (*by, rented):
        d = d.join(F.broadcast(other), ["source", "destination"], "left")
    rule, free = (F.col("a") * 7 + F.col("b") * 3) % 6, F.col("rented").isNull()
    path = F.when(free & (rule < 2) & F.col("path_1").isNotNull(), F.col("path_1")).when(free & (rule == 2) & F.col("path_2").isNotNull(), F.col("path_2")).otherwise(F.array("source", "destination"))
    return d.select("source", "destination", "target_days", path.alias("path"), (free & (rule == 1) & F.col("path_1").isNotNull()).alias("milk_run"))


def left_behind():
    return (F.length("demand_id") * 7 + (F.col("volume") / 1000).cast("long")) % 97 == 0


def demands_once(spark, sf):
    """The demands written as a table: a plan and its reports read them several times, the log once."""
    return cut_lineage(V.demands(spark, sf), "demands")


def pieces(spark, sf, demands=None):
    """The plan: each demand's pieces on stretches of vehicles with their times. demands: what demands_once gave, which the caller keeps."""
    every = demands_once(spark, sf) if demands is None else demands
    stock = V.rentals(spark, sf).groupBy("source", "destination").agg(F.sum("vehicle_count").alias("vehicle_count"))
    loads = runs.dispatched(every.where(~left_behind()), runs.lane_runs(routes(spark, sf), V.lane_vehicle(spark, sf)), stock, RENTED_TYPE)
    out = runs.timed(runs.stretches(loads))
    if demands is None:
        release(every)
    return out


def legs(spark, sf, demands=None):
    """pieces by leg, with the penalty of the last one: of each vehicle of the stretch, as cost and load are."""
    d = runs.by_leg(pieces(spark, sf, demands))
    return d.withColumn("penalty", F.when(F.col("is_last"), runs.late_penalty(F.col("leg_arrives"), "share")).otherwise(0.0))


def numbered(d):
    """The stretches of vehicles of d, each with the number of its first vehicle."""
    return runs.vehicle_numbers(d.select(*runs.VEHICLE, "vehicles").distinct(), ["slot", "trip", "vehicle_type", "is_rental", "run", "vehicle"])


@query("vehicle_codes", f"WITH {PIECES}, {CODES} SELECT trip, day, slot, vehicle_type, is_rental, CAST(run AS INTEGER) AS run, CAST(vehicle AS INTEGER) AS vehicle, code FROM vo")
def vehicle_codes(spark, sf):
    """Every vehicle of the plan under a number of its own."""
    return N.each_vehicle(numbered(pieces(spark, sf)), "number").select(*runs.VEHICLE, runs.code().alias("code"))


@query("vehicle_times", f"WITH {PIECES} SELECT trip, day, slot, vehicle_type, is_rental, CAST(run AS INTEGER) AS run, CAST(vehicle AS INTEGER) AS vehicle, any_value(load) AS load, make_timestamp(any_value(departs) * 1000000) AS departs, make_timestamp((any_value(departs) + 60 * any_value(CAST(list_sum(minutes) AS BIGINT))) * 1000000) AS arrives FROM tm GROUP BY trip, day, slot, vehicle_type, is_rental, run, vehicle")
def vehicle_times(spark, sf):
    """When each vehicle leaves and arrives: by its load, its slot and all that feeds it."""
    d = pieces(spark, sf).select(*runs.VEHICLE, "vehicles", "load", F.timestamp_seconds("departs").alias("departs"), F.timestamp_seconds("arrives").alias("arrives"))
    return N.each_vehicle(d.dropDuplicates(runs.VEHICLE))


@query("plan_fact", f"""
    WITH {PIECES}, {CODES} SELECT p.demand_id, p.is_rental, o.code, CAST(leg AS INTEGER) AS leg, CAST(legs AS INTEGER) AS legs, f AS source, t AS destination, CASE WHEN legs = 1 THEN 'Direct' WHEN milk_run THEN 'Milk run ' || leg || '/' || legs ELSE 'Relay ' || leg || '/' || legs END AS kind,
      make_timestamp(leg_departs * 1000000) AS departs, make_timestamp(leg_arrives * 1000000) AS arrives, round(share, 6) AS share, round(leg_cost * share / load, 4) AS cost, penalty FROM pf p JOIN vo o ON {_on('o', 'p')}""")
def plan_fact(spark, sf):
    """A row for each piece, leg and vehicle, with its part of the vehicle's cost; the last leg has the penalty for all."""
    step = F.concat_ws("/", F.col("leg").cast("string"), F.col("legs").cast("string"))
    kind = F.when(F.col("legs") == 1, "Direct").otherwise(F.concat(F.when(F.col("milk_run"), "Milk run ").otherwise("Relay "), step))
    at = lambda c: F.timestamp_seconds(f"leg_{c}").alias(c)
    cost = F.round(F.col("leg_cost") * F.col("share") / F.col("load"), 4).alias("cost")
    d = legs(spark, sf)
    d = N.each_vehicle(d.join(numbered(d).drop("vehicles"), runs.VEHICLE), "number")
    return d.select("demand_id", "is_rental", runs.code().alias("code"), "leg", "legs", F.col("from").alias("source"), F.col("to").alias("destination"), kind.alias("kind"), at("departs"), at("arrives"), R("share", 6), cost, "penalty")


USES = f"""
    tr AS MATERIALIZED (SELECT DISTINCT {', '.join(runs.VEHICLE)}, f, t, leg_departs, leg_arrives FROM pf WHERE vehicle_type = '{RENTED_TYPE}'),
    tw AS (SELECT *, lag(t) OVER ({_same_vehicle} ORDER BY leg_departs, leg_arrives) AS before FROM tr),
    us AS MATERIALIZED (SELECT hub, day, count(*) AS uses FROM (SELECT f AS hub, CAST(make_timestamp(leg_departs * 1000000) AS DATE) AS day FROM tw WHERE before IS NULL OR before <> f UNION ALL SELECT t, CAST(make_timestamp(leg_arrives * 1000000) AS DATE) FROM tw) GROUP BY ALL)"""


def truck_uses(d):
    return runs.hub_uses(d.where(F.col("vehicle_type") == RENTED_TYPE), *runs.VEHICLE)


@query("truck_continuity", f"WITH {PIECES}, {USES} SELECT * FROM us")
def truck_continuity(spark, sf):
    """How often trucks use each hub on a day: by vehicle, departures and arrivals; one that goes on from where it came uses the hub once."""
    return truck_uses(legs(spark, sf))


@query("truck_limit", f"WITH {PIECES}, {USES} SELECT hub, day, uses AS used, coalesce(h.trucks, 0) AS capacity FROM us LEFT JOIN (SELECT * FROM hub_capacity WHERE trucks <> 8) h USING (hub) WHERE uses > coalesce(h.trucks, 0)")
def truck_limit(spark, sf):
    """Hub-days that more trucks use than fit; a hub without a figure fits none."""
    cap = F.broadcast(V.hub_capacity(spark, sf).where("trucks != 8").select("hub", F.col("trucks").alias("capacity")))
    used = truck_continuity(spark, sf).withColumnRenamed("uses", "used")
    return used.join(cap, "hub", "left").withColumn("capacity", F.coalesce("capacity", F.lit(0))).where("used > capacity").select("hub", "day", "used", "capacity")


SLA = f"""
    {PIECES},
    rp AS (SELECT demand_id, is_rental, leg, legs, vehicle, share, leg_arrives, asked_day, asked_slot, penalty, CAST(floor(share / 1000) AS BIGINT) AS k, source, destination FROM pf),
    rt AS (SELECT rp.*, CASE WHEN leg < legs THEN CASE WHEN k % 7 = 0 THEN 10 ELSE 0 END WHEN k % 13 = 0 THEN round(penalty + share * 0.4, 2) ELSE penalty END AS reported, CASE WHEN k % 11 = 5 THEN 'NOWHERE' ELSE destination END AS to_hub FROM rp),
    ss AS (SELECT rt.demand_id, rt.is_rental, rt.leg, rt.vehicle, reported, CASE WHEN leg < legs THEN 0 ELSE round(share * greatest(0, ceil((leg_arrives + 60 * ceil(round(share * 0.01, 9)) - epoch(CAST(asked_day AS TIMESTAMP) + to_hours({HOUR.replace('slot', 'asked_slot')})) - l.target_days * 86400) / 3600)) * 0.4, 2) END AS expected, leg < legs AS between_hubs, l.target_days
      FROM rt LEFT JOIN lanes l ON l.source = rt.source AND l.destination = rt.to_hub),
    st AS (SELECT demand_id, is_rental, CAST(leg AS INTEGER) AS leg, CAST(vehicle AS INTEGER) AS vehicle, CASE WHEN target_days IS NOT NULL THEN expected END AS expected, reported, CASE WHEN target_days IS NULL THEN 'NO LANE' WHEN between_hubs AND reported > 0 THEN 'INTERMEDIATE' WHEN abs(expected - reported) > 0.02 THEN 'MISMATCH' ELSE 'OK' END AS status FROM ss)"""


def sla_states(plan, lanes):
    """plan (rows of legs with reported) with expected and status: the penalty computed anew from the arrival, for the last leg of a known lane; others have none. lanes has a row a lane."""
    d = plan.drop("target_days").join(F.broadcast(lanes.select("source", "destination", "target_days")), ["source", "destination"], "left")
    known = F.col("target_days").isNotNull()
    d = d.withColumn("expected", F.when(known, F.when(F.col("is_last"), runs.late_penalty(F.col("leg_arrives"), "share")).otherwise(0.0)))
    status = F.when(~known, "NO LANE").when(~F.col("is_last") & (F.col("reported") > 0), "INTERMEDIATE").when(F.abs(F.col("expected") - F.col("reported")) > 0.02, "MISMATCH").otherwise("OK")
    return d.withColumn("status", status)


def reported(spark, sf):
    """The plan as someone reports it who counts some hours and legs too many and forgets a lane."""
    k = (F.col("share") / 1000).cast("long")
    wrong = F.when(k % 13 == 0, F.round(F.col("penalty") + T.sla_penalty("share", F.lit(1)), 2)).otherwise(F.col("penalty"))
    d = legs(spark, sf).withColumn("reported", F.when(~F.col("is_last"), F.when(k % 7 == 0, 10.0).otherwise(0.0)).otherwise(wrong))
    return d.withColumn("destination", F.when(k % 11 == 5, "NOWHERE").otherwise(F.col("destination")))


@query("sla_recheck", f"WITH {SLA} SELECT * FROM st")
def sla_recheck(spark, sf):
    return N.each_vehicle(sla_states(reported(spark, sf), V.lanes(spark, sf))).select("demand_id", "is_rental", "leg", "vehicle", "expected", "reported", "status")


@query("status_summary", f"WITH {SLA} SELECT status, count(*) AS n, round(sum(reported - expected), 2) AS difference FROM st GROUP BY status")
def status_summary(spark, sf):
    difference = (F.col("reported") - F.col("expected")) * F.col("vehicles")
    return sla_states(reported(spark, sf), V.lanes(spark, sf)).groupBy("status").agg(F.sum("vehicles").alias("n"), F.round(F.sum(difference), 2).alias("difference"))


#: The ledgers of the plan at its real times: loading ends with the departure, unloading begins with the arrival.
LEDGER = f"""
    {USES},
    vl AS MATERIALIZED (SELECT {', '.join(runs.VEHICLE)}, f, t, leg_departs, leg_arrives, starts, ends, any_value(load) AS load, any_value(leg_cost) AS cost, count(DISTINCT demand_id) AS demands FROM pf GROUP BY ALL),
    vm AS (SELECT *, CAST(ceil(round(load * 0.01, 9)) AS BIGINT) AS minutes FROM vl),
    op AS (SELECT f AS hub, leg_departs - 60 * minutes AS began, minutes, load FROM vm WHERE starts UNION ALL SELECT t, leg_arrives, minutes, load FROM vm WHERE ends),
    od AS (SELECT *, unnest(range(began // 86400, (began + 60 * minutes - 1) // 86400 + 1)) AS d FROM op),
    hd AS MATERIALIZED (SELECT hub, CAST(make_timestamp(d * 86400000000) AS DATE) AS day, sum(load * (least(began + 60 * minutes, (d + 1) * 86400) - greatest(began, d * 86400)) / (60 * minutes)) AS handled FROM od GROUP BY ALL),
    dys AS MATERIALIZED (SELECT DISTINCT day FROM demands),
    rf AS MATERIALIZED (SELECT r.*, v.hours, v.spot_hourly, v.spot_km, v.distance_km FROM rentals r JOIN lane_vehicle v ON v.source = r.source AND v.destination = r.destination AND v.vehicle_type = r.vehicle_type),
    fe AS (SELECT source AS hub, day, vehicle_count AS n FROM rf, dys UNION ALL SELECT destination, CAST(day + CAST(floor((9 + hours) / 24) AS INTEGER) AS DATE), vehicle_count FROM rf, dys),
    fu AS (SELECT hub, day, least(sum(n), any_value(trucks)) AS trucks FROM fe JOIN hub_capacity USING (hub) WHERE day IN (SELECT day FROM dys) GROUP BY hub, day),
    sw AS (SELECT *, lag(t) OVER ({_same_vehicle} ORDER BY leg_departs, leg_arrives) AS before FROM tr WHERE NOT is_rental),
    su AS (SELECT f AS hub, CAST(make_timestamp(leg_departs * 1000000) AS DATE) AS day, 1 AS trucks FROM sw WHERE before IS NULL OR before <> f UNION ALL SELECT t, CAST(make_timestamp(leg_arrives * 1000000) AS DATE), 1 FROM sw UNION ALL SELECT * FROM fu),
    ex AS MATERIALIZED (SELECT hub, day, 'handling' AS kind, handled - handling AS excess FROM hd JOIN hub_capacity USING (hub) WHERE handled > handling + 1e-6
      UNION ALL SELECT hub, day, 'truck', CAST(n - trucks AS DOUBLE) FROM (SELECT hub, day, sum(trucks) AS n FROM su GROUP BY ALL) JOIN hub_capacity USING (hub) WHERE n > trucks)"""


def vehicle_legs(d):
    """A row for each leg of each stretch of vehicles: load and cost of one of them, and how many demands share it; a demand has one piece on a vehicle."""
    keys = [*runs.VEHICLE, "vehicles", "from", "to", "leg_departs", "leg_arrives", "touches", (F.col("leg_departs") == F.col("departs")).alias("starts"), (F.col("leg_arrives") == F.col("arrives")).alias("ends")]
    return d.groupBy(*keys).agg(F.first("load").alias("load"), F.first("leg_cost").alias("cost"), F.count("*").alias("demands"))


def excesses(spark, sf, v, days):
    """hub, day, kind, excess over capacity of handling and of trucks, by the legs of vehicles on the plan's days; rented trucks count as their contract has them, used or not."""
    minutes = T.handling_minutes("load")
    ends = F.array(F.struct(F.col("starts").alias("on"), F.col("from").alias("hub"), (F.col("leg_departs") - 60 * minutes).alias("began")), F.struct(F.col("ends").alias("on"), F.col("to").alias("hub"), F.col("leg_arrives").alias("began")))
    done = v.select("load", "vehicles", minutes.alias("minutes"), F.inline(F.filter(ends, lambda e: e["on"]))).withColumn("began", F.timestamp_seconds("began"))
    handled = split_at_midnight(done, "began", "minutes", "load").groupBy("hub", "day").agg(F.sum(F.col("share") * F.col("vehicles")).alias("used"), F.lit("handling").alias("kind"))
    spot = truck_uses(v.where(~F.col("is_rental"))).select("hub", "day", F.col("uses").alias("n"))
    trucks = spot.unionByName(fixed_trucks(spark, sf, days).select("hub", "day", F.col("trucks").alias("n"))).groupBy("hub", "day").agg(F.sum("n").cast("double").alias("used"), F.lit("truck").alias("kind"))
    caps = F.inline(F.array(F.struct(F.lit("handling").alias("kind"), F.col("handling").alias("capacity")), F.struct(F.lit("truck").alias("kind"), F.col("trucks").cast("double").alias("capacity"))))
    both = handled.unionByName(trucks).join(F.broadcast(V.hub_capacity(spark, sf).select("hub", caps)), ["hub", "kind"])
    return both.where("used > capacity + 1e-6").select("hub", "day", "kind", (F.col("used") - F.col("capacity")).alias("excess"))


#: Terms of the objective, as columns of the report.
TERMS = ["fixed_rental", "rental_handling", "spot", "sla", "unassigned", "handling_excess", "truck_excess"]
COSTS = f"""
    {PIECES}, {LEDGER},
    hz AS (SELECT day FROM dys UNION ALL SELECT CAST(max(day) + CAST(k AS INTEGER) AS DATE) FROM dys, (SELECT unnest([1, 2]) AS k) GROUP BY k),
    ev AS MATERIALIZED (
      SELECT day, 'fixed_rental' AS term, vehicle_count * (hours * spot_hourly + distance_km * spot_km) AS amount FROM rf, hz
      UNION ALL SELECT day, CASE WHEN is_rental THEN 'rental_handling' ELSE 'spot' END, cost FROM vl
      UNION ALL SELECT asked_day, 'sla', penalty FROM pf WHERE penalty > 0
      UNION ALL SELECT day, 'unassigned', volume * 720 * 0.4 FROM dl WHERE left_behind
      UNION ALL SELECT day, kind || '_excess', excess * CASE kind WHEN 'handling' THEN 1000 ELSE 50000 END FROM ex
      UNION ALL SELECT asked_day, CASE WHEN milk_run THEN 'milk_runs' ELSE 'relayed' END, 1 FROM s0 WHERE milk_run OR runs > 1
      UNION ALL SELECT day, 'consolidated', 1 FROM vl WHERE demands > 1),
    cs AS MATERIALIZED (SELECT day, {', '.join(f"round(coalesce(sum(amount) FILTER (term = '{t}'), 0), 2) AS {t}" for t in TERMS)}, round(coalesce(sum(amount) FILTER (term IN ({', '.join(f"'{t}'" for t in TERMS)})), 0), 2) AS objective,
      {', '.join(f"count(*) FILTER (term = '{t}') AS {t}" for t in ('relayed', 'milk_runs', 'consolidated'))} FROM ev GROUP BY ROLLUP (day))"""


def cost_events(spark, sf):
    """day, term, amount of everything that the plan costs or counts, as one stream."""
    demands = demands_once(spark, sf)
    d = legs(spark, sf, demands)
    v = vehicle_legs(d)
    days = demands.select("day").distinct()
    more = days.agg(F.max("day").alias("last")).select(F.explode(F.array(F.date_add("last", 1), F.date_add("last", 2))).alias("day"))
    contract = V.rentals(spark, sf).join(F.broadcast(V.lane_vehicle(spark, sf)), ["source", "destination", "vehicle_type"])
    fixed = F.col("vehicle_count") * (F.col("hours") * F.col("spot_hourly") + F.col("distance_km") * F.col("spot_km"))
    event = lambda df, day, term, amount: df.select(F.col(day).alias("day"), term.alias("term"), amount.cast("double").alias("amount"))
    over = excesses(spark, sf, v, days)
    first = d.where((F.col("leg") == 1)).select(*runs.LOAD, "asked_day", "milk_run", "legs").distinct()
    parts = [
        event(days.unionByName(more).crossJoin(F.broadcast(contract)), "day", F.lit("fixed_rental"), fixed),
        event(v, "day", F.when(F.col("is_rental"), "rental_handling").otherwise("spot"), F.col("cost") * F.col("vehicles")),
        event(d.where("penalty > 0"), "asked_day", F.lit("sla"), F.col("penalty") * F.col("vehicles")),
        event(demands.where(left_behind()), "day", F.lit("unassigned"), F.col("volume") * runs.UNDELIVERED_HOURS * T.PENALTY),
        event(over, "day", F.concat("kind", F.lit("_excess")), F.col("excess") * F.when(F.col("kind") == "handling", runs.HANDLING_EXCESS).otherwise(runs.TRUCK_EXCESS)),
        event(first.where("legs > 1"), "asked_day", F.when(F.col("milk_run"), "milk_runs").otherwise("relayed"), F.lit(1)),
        event(v.where("demands > 1"), "day", F.lit("consolidated"), F.lit(1)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cost_report(events):
    """Each term, their sum and the counts, by day and for all days (day null), in one pass over the events."""
    amount = lambda *terms: F.round(F.coalesce(F.sum(F.when(F.col("term").isin(*terms), F.col("amount"))), F.lit(0.0)), 2)
    counts = [F.count_if(F.col("term") == t).alias(t) for t in ("relayed", "milk_runs", "consolidated")]
    return events.rollup("day").agg(*(amount(t).alias(t) for t in TERMS), amount(*TERMS).alias("objective"), *counts)


@query("cost_summary", f"WITH {COSTS} SELECT coalesce(CAST(day AS VARCHAR), 'all') AS day, * EXCLUDE (day) FROM cs")
def cost_summary(spark, sf):
    """The cost report by day and in all."""
    return cost_report(cost_events(spark, sf)).withColumn("day", F.coalesce(F.col("day").cast("string"), F.lit("all")))


@query("objective", f"WITH {COSTS} SELECT {', '.join(TERMS)}, objective FROM cs WHERE day IS NULL")
def objective(spark, sf):
    """What the plan costs: contracts, vehicles, delay, what is left behind, and the price of handling and trucks beyond capacity."""
    return cost_report(cost_events(spark, sf)).where("day is null").select(*TERMS, "objective")


@query("violation_penalty", f"""
    WITH {PIECES}, {LEDGER},
    en AS (SELECT demand_id, f AS hub, CAST(make_timestamp(leg_departs * 1000000) AS DATE) AS day, starts AS touched, share, vehicle_type FROM pf WHERE NOT is_rental UNION ALL SELECT demand_id, t, CAST(make_timestamp(leg_arrives * 1000000) AS DATE), ends, share, vehicle_type FROM pf WHERE NOT is_rental)
    SELECT demand_id, round(sum(CASE WHEN touched AND h.hub IS NOT NULL THEN 1000 * share ELSE 0 END + CASE WHEN vehicle_type = '{RENTED_TYPE}' AND k.hub IS NOT NULL THEN 50000 ELSE 0 END), 2) AS penalty
    FROM en LEFT JOIN (SELECT * FROM ex WHERE kind = 'handling') h ON h.hub = en.hub AND h.day = en.day LEFT JOIN (SELECT * FROM ex WHERE kind = 'truck') k ON k.hub = en.hub AND k.day = en.day GROUP BY demand_id""")
def violation_penalty(spark, sf):
    """For each demand by spot: its volume at each end of its legs where it is handled beyond capacity on that day, and each truck it goes by at an end with too many trucks."""
    demands = demands_once(spark, sf)
    d = legs(spark, sf, demands)
    over = excesses(spark, sf, vehicle_legs(d), demands.select("day").distinct()).groupBy("hub", "day").agg(F.max((F.col("kind") == "handling").cast("int")).alias("h"), F.max((F.col("kind") == "truck").cast("int")).alias("k"))
    end = lambda hub, second, on: F.struct(F.col(hub).alias("hub"), F.to_date(F.timestamp_seconds(second)).alias("day"), on.alias("touched"))
    ends = F.array(end("from", "leg_departs", F.col("leg_departs") == F.col("departs")), end("to", "leg_arrives", F.col("leg_arrives") == F.col("arrives")))
    e = d.where(~F.col("is_rental")).select("demand_id", "share", "vehicles", "vehicle_type", F.inline(ends)).join(over, ["hub", "day"], "left")
    handled = F.when(F.col("touched") & (F.col("h") == 1), runs.HANDLING_EXCESS * F.col("share")).otherwise(0.0)
    trucks = F.when((F.col("vehicle_type") == RENTED_TYPE) & (F.col("k") == 1), runs.TRUCK_EXCESS).otherwise(0.0)
    return e.groupBy("demand_id").agg(F.round(F.sum((handled + trucks) * F.col("vehicles")), 2).alias("penalty"))
