"""Queries: checks of finished plans. Each gives the rows that break a rule, or the state of all."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from hubflow import adapters as V
from hubflow.catalog import query
from hubflow.functions import timecost as T
from hubflow.operators import calendar, carry
from hubflow.plans.dates import HOUR
from hubflow.plans.ledgers import ASSIGNED, SPLIT, TRUCKS, assignments, buckets, empty_rental_union, truck_ledger_of, vehicle_shares
from hubflow.sources.readers import plan_of_demands

#: What a truck holds.
TRUCK = V.VEHICLES[0][1]

#: A shipped plan with mistakes, so that the checks find some: every 97th demand is missing and every 101st short.
FAULTY = "(SELECT demand_id, CASE WHEN (hash_no % 101) = 0 THEN share - 2 ELSE share END AS share FROM (SELECT demand_id, share, len(demand_id) * 7 + CAST(floor(volume / 1000) AS BIGINT) AS hash_no FROM sh WHERE share > 0.001) WHERE hash_no % 97 <> 0)"


def faulty(spark, sf):
    n = (F.length("demand_id") * 7 + (F.col("volume") / 1000).cast("long")).alias("n")
    d = vehicle_shares(spark, sf).select("demand_id", "share", n).where("n % 97 != 0")
    return d.select("demand_id", F.when(F.col("n") % 101 == 0, F.col("share") - 2).otherwise(F.col("share")).alias("share"))


@query("plan_vs_forecast", f"WITH {SPLIT}, f AS (SELECT DISTINCT demand_id FROM {FAULTY}) SELECT d.demand_id, f.demand_id IS NOT NULL AS carried FROM demands d LEFT JOIN f ON f.demand_id = d.demand_id")
def plan_vs_forecast(spark, sf):
    carried = faulty(spark, sf).select("demand_id").distinct().withColumn("carried", F.lit(True))
    return V.demands(spark, sf).select("demand_id").join(carried, "demand_id", "left").select("demand_id", F.coalesce("carried", F.lit(False)).alias("carried"))


@query("volume_conservation", f"""
    WITH {SPLIT}, f AS (SELECT demand_id, sum(share) AS moved FROM {FAULTY} GROUP BY demand_id)
    SELECT d.demand_id, round(d.volume - coalesce(moved, 0), 4) AS missing, moved IS NULL AS never FROM demands d LEFT JOIN f ON f.demand_id = d.demand_id WHERE d.volume > 0.01 AND abs(d.volume - coalesce(moved, 0)) > 1""")
def volume_conservation(spark, sf):
    """Demands whose vehicles carry another volume, by more than 1."""
    moved = faulty(spark, sf).groupBy("demand_id").agg(F.sum("share").alias("moved"))
    d = V.demands(spark, sf).where("volume > 0.01").join(moved, "demand_id", "left")
    missing = F.col("volume") - F.coalesce("moved", F.lit(0.0))
    return d.where(F.abs(missing) > 1).select("demand_id", F.round(missing, 4).alias("missing"), F.col("moved").isNull().alias("never"))


USED = f"""
    {SPLIT}, us AS (SELECT source, destination, day, count(DISTINCT vehicle) AS used FROM sh WHERE share > 0.001 AND is_rental GROUP BY ALL),
    ct AS (SELECT r.source, r.destination, d.day, r.vehicle_count AS contract, coalesce(us.used, 0) AS used FROM rentals r CROSS JOIN (SELECT DISTINCT day FROM demands) d LEFT JOIN us ON us.source = r.source AND us.destination = r.destination AND us.day = d.day)"""


@query("rental_usage", f"WITH {USED} SELECT source, destination, day, used FROM us")
def rental_usage(spark, sf):
    return vehicle_shares(spark, sf).where("is_rental").groupBy("source", "destination", "day").agg(F.count_distinct("vehicle").alias("used"))


@query("rental_contract", f"WITH {USED} SELECT source, destination, day, contract, used, CASE WHEN used > contract THEN 'OVER' WHEN used < contract THEN 'IDLE' ELSE 'OK' END AS status, abs(used - contract) AS amount FROM ct")
def rental_contract(spark, sf):
    """Every rented lane and day: used exactly, too much or in part."""
    used = rental_usage(spark, sf)
    every = F.broadcast(V.rentals(spark, sf)).crossJoin(V.demands(spark, sf).select("day").distinct()).join(used, ["source", "destination", "day"], "left")
    d = every.select("source", "destination", "day", F.col("vehicle_count").alias("contract"), F.coalesce("used", F.lit(0)).alias("used"))
    status = F.when(F.col("used") > F.col("contract"), "OVER").when(F.col("used") < F.col("contract"), "IDLE").otherwise("OK")
    return d.withColumns({"status": status, "amount": F.abs(F.col("used") - F.col("contract"))})


@query("min_occupancy", f"""
    WITH {ASSIGNED}, t AS (SELECT source, destination, sum(volume) AS total FROM demands GROUP BY ALL)
    SELECT source, destination, day, slot, vehicle_type, round(volume / (vehicles * capacity), 9) AS occupancy FROM bk JOIN t USING (source, destination)
    WHERE NOT is_rental AND volume / (vehicles * capacity) < least(0.3, least(1, total / capacity))""")
def min_occupancy(spark, sf):
    """Spot loads under the least occupancy (30 % here), unless the lane's whole demand can't reach it."""
    total = F.broadcast(V.demands(spark, sf).groupBy("source", "destination").agg(F.sum("volume").alias("total")))
    b = buckets(assignments(spark, sf).where("not is_rental")).join(total, ["source", "destination"]).withColumn("occupancy", F.col("volume") / (F.col("vehicles") * F.col("capacity")))
    least = T.min_occupancy("total", "capacity", F.lit(4), base=0.3)
    return b.where(F.col("occupancy") < least).select("source", "destination", "day", "slot", "vehicle_type", F.round("occupancy", 9).alias("occupancy"))


#: The plan of deferrals by a recursion over days, all lanes at once: what each lane carries after a day's first and second slot.
CARRY = f"""
    x AS MATERIALIZED (SELECT source, destination, day, sum(volume) FILTER (slot = '09:00') AS a, sum(volume) FILTER (slot = '17:00') AS b FROM demands GROUP BY ALL),
    dy AS MATERIALIZED (SELECT day, row_number() OVER (ORDER BY day) AS i, lead(day) OVER (ORDER BY day) AS after FROM (SELECT DISTINCT day FROM demands)),
    ln AS MATERIALIZED (SELECT l.*, coalesce(vehicle_count, 0) AS stock, row_number() OVER (ORDER BY l.source, l.destination) AS n FROM (SELECT DISTINCT source, destination FROM demands) l LEFT JOIN rentals r ON r.source = l.source AND r.destination = l.destination),
    gd AS MATERIALIZED (SELECT ln.*, dy.*, CAST(coalesce(a, 0) AS DOUBLE) AS a, CAST(coalesce(b, 0) AS DOUBLE) AS b FROM ln CROSS JOIN dy LEFT JOIN x ON x.source = ln.source AND x.destination = ln.destination AND x.day = dy.day),
    ca AS (SELECT list(CAST(stock * {TRUCK} + {TRUCK} AS DOUBLE) ORDER BY n) AS c FROM ln),
    dd AS MATERIALIZED (SELECT i, list(a ORDER BY n) AS a, list(b ORDER BY n) AS b FROM gd GROUP BY i),
    rc AS (SELECT CAST(0 AS BIGINT) AS i, [CAST(0 AS DOUBLE) for z in c] AS p, [CAST(0 AS DOUBLE) for z in c] AS q FROM ca
      UNION ALL SELECT i, p, list_transform(list_zip(p, b), lambda t: greatest(CAST(0 AS DOUBLE), t[1] + t[2] - {TRUCK})) FROM (
        SELECT dd.i, list_transform(list_zip(rc.q, dd.a, ca.c), lambda t: greatest(CAST(0 AS DOUBLE), t[1] + t[2] - t[3])) AS p, dd.b FROM rc JOIN dd ON dd.i = rc.i + 1, ca)),
    un AS MATERIALIZED (SELECT i, unnest(range(1, len(p) + 1)) AS n, unnest(p) AS p, unnest(q) AS q FROM rc),
    sl AS MATERIALIZED (SELECT gd.source, gd.destination, gd.day, '09:00' AS slot, gd.stock, a AS demand, o.q AS inbound, u.p AS deferred, FALSE AS last, gd.stock * {TRUCK} AS rented, 8 AS hours, CAST(gd.day AS TIMESTAMP) + INTERVAL 9 HOUR AS began
        FROM gd JOIN un u ON u.n = gd.n AND u.i = gd.i JOIN un o ON o.n = gd.n AND o.i = gd.i - 1
      UNION ALL SELECT gd.source, gd.destination, gd.day, '17:00', gd.stock, b, u.p, CASE WHEN after IS NULL THEN 0 ELSE u.q END, after IS NULL, 0, coalesce(date_diff('day', gd.day, after) * 24 - 8, 0), CAST(gd.day AS TIMESTAMP) + INTERVAL 17 HOUR
        FROM gd JOIN un u ON u.n = gd.n AND u.i = gd.i),
    pl AS MATERIALIZED (SELECT *, inbound + demand - deferred AS moved, least(inbound + demand - deferred, rented) AS rental_load, inbound + demand - deferred - least(inbound + demand - deferred, rented) AS spot_load FROM sl)"""


def deferred_plan(spark, sf):
    """Of each lane and slot of the calendar what waits, what goes and by which vehicles: rented trucks at 09:00, one more truck in each slot, all in the last."""
    return carry.weekly_plan(V.demands(spark, sf), V.rentals(spark, sf), TRUCK, V.SLOTS)


@query("deferral_penalty", f"WITH RECURSIVE {CARRY} SELECT source, destination, day, slot, deferred, round_even(deferred * hours * 0.4, 0) AS penalty FROM pl WHERE deferred > 0")
def deferral_penalty(spark, sf):
    """What waits in a slot, for as long as it takes to the next one; the same volume may wait several times."""
    hours = F.coalesce((F.col("next") - F.col("began")) / 3600, F.lit(0.0))
    return deferred_plan(spark, sf).where("deferred > 0").select("source", "destination", "day", "slot", "deferred", F.bround(T.sla_penalty("deferred", hours), 0).alias("penalty"))


@query("carry_balance", f"""
    WITH RECURSIVE {CARRY},
    fn AS (SELECT *, dayofyear(day) + 3 * length(source) + length(destination) AS k, CAST(ceil(rental_load / {TRUCK} - 1e-9) AS BIGINT) AS rv, CAST(ceil(spot_load / {TRUCK} - 1e-9) AS BIGINT) AS sv FROM pl),
    fp AS MATERIALIZED (SELECT source, destination, day, slot, began, last, stock, demand, rental_load, sv, rv + CASE WHEN k % 89 = 0 AND slot = '09:00' THEN 1 ELSE 0 END AS rv,
      CASE WHEN last AND length(source) % 3 = 0 THEN greatest(0, spot_load - 10) WHEN k % 83 = 0 AND spot_load > 20000 THEN spot_load + 5000 ELSE spot_load END AS spot_load,
      CASE WHEN last AND length(source) % 3 = 0 THEN deferred + least(10, spot_load) WHEN k % 97 = 0 THEN deferred + 1 WHEN k % 83 = 0 AND spot_load > 20000 THEN deferred - 5000 ELSE deferred END AS deferred FROM fn),
    fw AS (SELECT *, coalesce(lag(deferred) OVER (PARTITION BY source, destination ORDER BY began), 0) AS before, sum(rv) OVER (PARTITION BY source, destination, day) AS day_rentals FROM fp)
    SELECT source, destination, day, slot, 'balance' AS rule, round(before + demand - rental_load - spot_load - deferred, 4) AS amount FROM fw WHERE abs(before + demand - rental_load - spot_load - deferred) > 1e-6
    UNION ALL SELECT source, destination, day, slot, 'left_at_end', round(deferred, 4) FROM fw WHERE last AND deferred > 1e-6
    UNION ALL SELECT source, destination, day, slot, 'rental_stock', CAST(day_rentals - stock AS DOUBLE) FROM fw WHERE day_rentals > stock
    UNION ALL SELECT source, destination, day, slot, 'load', round(rental_load + spot_load - (rv + sv) * {TRUCK}, 4) FROM fw WHERE rental_load + spot_load > (rv + sv) * {TRUCK} + 1e-6
    UNION ALL SELECT source, destination, day, slot, 'low_load', round(spot_load, 4) FROM fw WHERE NOT last AND spot_load + 1e-6 < 0.1 * sv * {TRUCK}""")
def carry_balance(spark, sf):
    """The rules that a plan breaks in which some slots were tampered with: volume that vanishes, that is left at the end or over capacity, and a rented truck too many."""
    k = F.dayofyear("day") + 3 * F.length("source") + F.length("destination")
    end, over = F.col("next").isNull() & (F.length("source") % 3 == 0), (k % 83 == 0) & (F.col("spot_load") > 20000)
    plan = deferred_plan(spark, sf).withColumns({
        "rental_vehicles": F.col("rental_vehicles") + ((k % 89 == 0) & (F.col("slot") == "09:00")).cast("int"),
        "deferred": F.when(end, F.col("deferred") + F.least(F.lit(10.0), F.col("spot_load"))).when(k % 97 == 0, F.col("deferred") + 1).when(over, F.col("deferred") - 5000).otherwise(F.col("deferred")),
        "spot_load": F.when(end, F.greatest(F.lit(0.0), F.col("spot_load") - 10)).when(over, F.col("spot_load") + 5000).otherwise(F.col("spot_load")),
    })
    return carry.broken_rules(plan, TRUCK)


@query("carry_over_view", f"""
    WITH RECURSIVE {CARRY},
    ax AS MATERIALIZED (SELECT *, greatest(0, moved - inbound) AS on_time, demand - greatest(0, moved - inbound) AS late, round(sum(demand) OVER w, 4) AS asked, round(sum(moved) OVER w, 4) AS gone FROM pl WINDOW w AS (PARTITION BY source, destination ORDER BY began)),
    mv AS MATERIALIZED (SELECT source, destination, began, gone FROM ax WHERE moved > 0),
    lt AS MATERIALIZED (SELECT source, destination, began, round(asked - late, 4) AS low, asked AS high FROM ax WHERE late > 1e-6),
    ft AS (SELECT lt.source, lt.destination, lt.began, mv.began AS target FROM lt ASOF JOIN mv ON mv.source = lt.source AND mv.destination = lt.destination AND lt.low < mv.gone),
    tt AS (SELECT lt.source, lt.destination, lt.began, mv.began AS target FROM lt ASOF JOIN mv ON mv.source = lt.source AND mv.destination = lt.destination AND lt.high <= mv.gone)
    SELECT ax.source, ax.destination, ax.day, ax.slot, demand, on_time, late AS deferred, moved - on_time AS inbound, ft.target AS first_target, tt.target AS last_target, demand > 0 AND late > 1e-6 AND on_time <= 0 AS cancelled, late > 1e-6 AND on_time > 0 AS partial
    FROM ax LEFT JOIN ft ON ft.source = ax.source AND ft.destination = ax.destination AND ft.began = ax.began LEFT JOIN tt ON tt.source = ax.source AND tt.destination = ax.destination AND tt.began = ax.began WHERE demand > 0 OR moved > 0""")
def carry_over_view(spark, sf):
    """What goes in time and what waits of each slot's demand, until when, and what came in from before."""
    return carry.waiting(deferred_plan(spark, sf))


@query("read_results", f"WITH {SPLIT} SELECT sh.demand_id, sh.source, sh.destination, round(sh.share, 6) AS volume, l.target_days FROM sh LEFT JOIN lanes l ON l.source = sh.source AND l.destination = sh.destination WHERE share > 0.001")
def read_results(spark, sf):
    """A finished plan as the delivery check reads it: without empty trips, with the target days of its lanes."""
    plan = plan_of_demands(empty_rental_union(spark, sf), ["demand_id", "source", "destination", "volume"])
    days = F.broadcast(V.lanes(spark, sf).select("source", "destination", "target_days"))
    return plan.select("demand_id", "source", "destination", "volume").join(days, ["source", "destination"], "left")
