"""Queries: transport times, costs and risk formulas over real rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from hubflow import adapters as V
from hubflow.catalog import query
from hubflow.functions import risk
from hubflow.functions import timecost as T
from hubflow.operators import calendar
from hubflow.plans.dates import HOUR

R = lambda c, n=6: F.round(c, n).alias(c)


def legs(spark, sf):
    """Demands with the lane's attributes for each vehicle type."""
    return V.demands(spark, sf).join(F.broadcast(V.lane_vehicle(spark, sf)), ["source", "destination"])


LEGS = "demands d JOIN lane_vehicle v ON v.source = d.source AND v.destination = d.destination"


@query("travel_minutes", "SELECT source, destination, vehicle_type, CAST(ceil(round(hours * 60, 9)) AS INTEGER) AS minutes, round(ceil(round(hours * 60, 9)) / 60, 9) AS hours FROM lane_vehicle")
def travel_minutes(spark, sf):
    m = T.travel_minutes("hours")
    return V.lane_vehicle(spark, sf).select("source", "destination", "vehicle_type", m.alias("minutes"), F.round(m / 60, 9).alias("hours"))


@query("handling_minutes", "SELECT demand_id, CAST(ceil(round(volume * 0.01, 9)) AS INTEGER) AS once, CAST(ceil(round(volume * 0.02, 9)) AS INTEGER) AS consolidated FROM demands")
def handling_minutes(spark, sf):
    return V.demands(spark, sf).select("demand_id", T.handling_minutes("volume").alias("once"), T.handling_minutes("volume", True).alias("consolidated"))


TIMES = f"""
    SELECT d.demand_id, v.vehicle_type, d.volume, v.target_days, CAST(d.day AS TIMESTAMP) + to_hours({HOUR}) AS began,
           CAST(d.day AS TIMESTAMP) + to_hours({HOUR}) + to_minutes(CAST(ceil(round(v.hours * 60, 9)) AS BIGINT)) AS arrival,
           CAST(d.day AS TIMESTAMP) + to_hours({HOUR}) + to_minutes(CAST(ceil(round(v.hours * 60, 9)) + ceil(round(d.volume * 0.01, 9)) AS BIGINT)) AS done FROM {LEGS}"""


def times(spark, sf):
    d = legs(spark, sf).withColumn("at", calendar.slot_timestamp("day", "slot"))
    d = d.withColumn("arrival", T.plus_minutes("at", T.travel_minutes("hours")))
    return d.withColumn("done", T.plus_minutes("arrival", T.handling_minutes("volume")))


@query("completion_time", f"SELECT demand_id, vehicle_type, arrival, done FROM ({TIMES})")
def completion_time(spark, sf):
    return times(spark, sf).select("demand_id", "vehicle_type", "arrival", "done")


@query("arrival_time", f"SELECT demand_id, vehicle_type, arrival FROM ({TIMES})")
def arrival_time(spark, sf):
    return times(spark, sf).select("demand_id", "vehicle_type", "arrival")


@query("late_hours", f"SELECT demand_id, vehicle_type, CAST(greatest(0, ceil((epoch(done) - epoch(began) - target_days * 3600 * 5) / 3600)) AS INTEGER) AS late_hours FROM ({TIMES})")
def late_hours(spark, sf):
    d = times(spark, sf).withColumn("deadline", T.sla_deadline("at", F.col("target_days") * 5 / 24))
    return d.select("demand_id", "vehicle_type", T.late_hours("done", "deadline").alias("late_hours"))


@query("sla_deadline", f"SELECT demand_id, vehicle_type, began + to_hours(CAST(target_days * 24 AS BIGINT)) AS deadline FROM ({TIMES})")
def sla_deadline(spark, sf):
    return times(spark, sf).select("demand_id", "vehicle_type", T.sla_deadline("at", "target_days").alias("deadline"))


@query("sla_penalty", f"""
    SELECT demand_id, vehicle_type, CAST(greatest(0, ceil((epoch(done) - epoch(began) - target_days * 3600 * 5) / 3600)) AS INTEGER) AS late_hours,
           round(volume * greatest(0, ceil((epoch(done) - epoch(began) - target_days * 3600 * 5) / 3600)) * 0.4, 4) AS penalty FROM ({TIMES})""")
def sla_penalty(spark, sf):
    """Lateness against five hours for a target day, so that some are late."""
    d = times(spark, sf).withColumn("deadline", T.sla_deadline("at", F.col("target_days") * 5 / 24)).withColumn("late_hours", T.late_hours("done", "deadline"))
    return d.select("demand_id", "vehicle_type", "late_hours", F.round(T.sla_penalty("volume", "late_hours"), 4).alias("penalty"))


@query("vehicle_leg_cost", "SELECT source, destination, vehicle_type, round_even(spot_hourly * hours + spot_km * distance_km, 0) AS cost FROM lane_vehicle")
def vehicle_leg_cost(spark, sf):
    return V.lane_vehicle(spark, sf).select("source", "destination", "vehicle_type", T.vehicle_leg_cost("spot_hourly", "hours", "spot_km", "distance_km").alias("cost"))


@query("handling_cost", f"SELECT d.demand_id, v.vehicle_type, round_even(2 * ceil(round(d.volume * 0.01, 9)) / 60 * v.spot_hourly, 0) AS cost FROM {LEGS}")
def handling_cost(spark, sf):
    return legs(spark, sf).select("demand_id", "vehicle_type", T.handling_cost("volume", "spot_hourly").alias("cost"))


@query("vehicle_count", f"SELECT d.demand_id, v.vehicle_type, CAST(least(9, ceil(d.volume / v.capacity - 1e-9)) AS INTEGER) AS n FROM {LEGS}")
def vehicle_count(spark, sf):
    return legs(spark, sf).select("demand_id", "vehicle_type", T.vehicle_count("volume", "capacity", F.lit(9)).alias("n"))


@query("fixed_rental_cost", """
    SELECT r.source, r.destination, round((SELECT count(DISTINCT day) + 2 FROM demands) * r.vehicle_count * (v.hours * v.spot_hourly + v.distance_km * v.spot_km), 2) AS cost
    FROM rentals r JOIN lane_vehicle v ON v.source = r.source AND v.destination = r.destination AND v.vehicle_type = r.vehicle_type""")
def fixed_rental_cost(spark, sf):
    """Paid for each day of the horizon and two more, used or not."""
    days = F.broadcast(V.demands(spark, sf).agg((F.countDistinct("day") + 2).alias("days")))
    r = V.rentals(spark, sf).join(V.lane_vehicle(spark, sf), ["source", "destination", "vehicle_type"]).crossJoin(days)
    cost = F.col("days") * F.col("vehicle_count") * (F.col("hours") * F.col("spot_hourly") + F.col("distance_km") * F.col("spot_km"))
    return r.select("source", "destination", F.round(cost, 2).alias("cost"))


@query("fixed_truck_usage", """
    WITH days AS (SELECT DISTINCT day FROM demands), r AS (SELECT r.*, v.hours FROM rentals r JOIN lane_vehicle v ON v.source = r.source AND v.destination = r.destination AND v.vehicle_type = r.vehicle_type),
    e AS (SELECT source AS hub, day, vehicle_count AS n FROM r, days UNION ALL SELECT destination, CAST(day + CAST(floor((9 + hours) / 24) AS INTEGER) AS DATE), vehicle_count FROM r, days)
    SELECT hub, day, CAST(least(sum(n), any_value(trucks)) AS BIGINT) AS trucks FROM e JOIN hub_capacity USING (hub) WHERE day IN (SELECT day FROM days) GROUP BY hub, day""")
def fixed_truck_usage(spark, sf):
    """Rental trucks at each hub and day, going at 09:00 and coming, at most what the hub takes."""
    return fixed_trucks(spark, sf, V.demands(spark, sf).select("day").distinct())


def fixed_trucks(spark, sf, days):
    """fixed_truck_usage on the given days (distinct)."""
    r = V.rentals(spark, sf).join(V.lane_vehicle(spark, sf).select("source", "destination", "vehicle_type", "hours"), ["source", "destination", "vehicle_type"])
    every = F.broadcast(r).crossJoin(days)
    out = every.select(F.col("source").alias("hub"), "day", F.col("vehicle_count").alias("n"))
    into = every.select(F.col("destination").alias("hub"), T.arrival_day("day", F.lit(9), "hours").alias("day"), F.col("vehicle_count").alias("n")).join(days, "day", "left_semi").select("hub", "day", "n")
    cap = F.broadcast(V.hub_capacity(spark, sf).select("hub", "trucks"))
    return out.unionByName(into).groupBy("hub", "day").agg(F.sum("n").alias("n")).join(cap, "hub").select("hub", "day", F.least("n", F.col("trucks").cast("long")).alias("trucks"))


@query("min_occupancy_threshold", """
    WITH t AS (SELECT source, destination, sum(volume) AS total FROM demands GROUP BY ALL), n AS (SELECT count(DISTINCT (day, slot)) AS slots FROM demands),
    s AS (SELECT day, slot, row_number() OVER (ORDER BY day, slot) - 1 AS i FROM (SELECT DISTINCT day, slot FROM demands))
    SELECT d.demand_id, v.vehicle_type, round(least(0.10, least(1, t.total / (v.capacity * 1000))) * least(1, (n.slots - 1 - s.i) / 4.0), 9) AS threshold
    FROM demands d JOIN lane_vehicle v ON v.source = d.source AND v.destination = d.destination JOIN t ON t.source = d.source AND t.destination = d.destination JOIN s ON s.day = d.day AND s.slot = d.slot, n""")
def min_occupancy_threshold(spark, sf):
    """Against capacities of a thousand vehicles, so that some lanes can't reach the base."""
    d = V.demands(spark, sf)
    slots = d.select("day", "slot").distinct().withColumn("i", F.row_number().over(Window.orderBy("day", "slot")) - 1)
    n = F.broadcast(slots.agg(F.count("*").alias("slots")))
    total = F.broadcast(d.groupBy("source", "destination").agg(F.sum("volume").alias("total")))  # at most 600 lanes
    out = legs(spark, sf).join(total, ["source", "destination"]).join(slots, ["day", "slot"]).crossJoin(n)
    threshold = T.min_occupancy("total", F.col("capacity") * 1000, F.col("slots") - 1 - F.col("i"))
    return out.select("demand_id", "vehicle_type", F.round(threshold, 9).alias("threshold"))


@query("maape_scale", "SELECT lane, date, round(CASE WHEN q50 - 5 <= 0 THEN 1 ELSE 2 / pi() * atan(greatest(q90 - q10, 0) / (q50 - 5)) END, 9) AS scaled FROM predictions")
def maape_scale(spark, sf):
    return V.predictions(spark, sf).select("lane", "date", F.round(risk.maape_scale(F.col("q90") - F.col("q10"), F.col("q50") - 5), 9).alias("scaled"))


#: log1p of 50 and 1500, as dynamic_tau has them.
TAU_SQL = "0.50 + (0.95 - 0.50) / (1 + exp((ln(1 + greatest(q50, 0)) - (ln(51::DOUBLE) + ln(1501::DOUBLE)) / 2) / ((ln(1501::DOUBLE) - ln(51::DOUBLE)) / 8)))"


@query("dynamic_tau", f"SELECT lane, date, round({TAU_SQL}, 9) AS tau FROM predictions")
def dynamic_tau(spark, sf):
    return V.predictions(spark, sf).select("lane", "date", F.round(risk.dynamic_tau(F.col("q50")), 9).alias("tau"))


@query("volume_damping", "SELECT lane, date, round(greatest(0, 2 / (1 + exp(-3.0 * q50 / 150.0)) - 1), 9) AS damping FROM predictions")
def volume_damping(spark, sf):
    return V.predictions(spark, sf).select("lane", "date", F.round(risk.volume_damping(F.col("q50")), 9).alias("damping"))


@query("surge_dampening", """
    WITH b AS (SELECT lane, avg(q50) AS base FROM predictions WHERE NOT (isodow(date) = 7 AND day(date) <= 7) GROUP BY lane)
    SELECT lane, date, round(CASE WHEN isodow(date) = 7 AND day(date) <= 7 THEN 1 / (1 + 0.2 * greatest(0, (q50 - base) / (base + 1e-6))) ELSE 1 END, 9) AS weight FROM predictions JOIN b USING (lane)""")
def surge_dampening(spark, sf):
    """First Sundays stand for campaign Sundays; base: the lane's mean on other days."""
    special = (F.weekday("date") == 6) & (F.dayofmonth("date") <= 7)
    d = V.predictions(spark, sf).withColumn("special", special)
    base = F.broadcast(d.where("not special").groupBy("lane").agg(F.avg("q50").alias("base")))
    weight = F.when(F.col("special"), 1 / (1 + 0.2 * F.greatest(F.lit(0.0), (F.col("q50") - F.col("base")) / (F.col("base") + 1e-6)))).otherwise(1.0)
    return d.join(base, "lane").select("lane", "date", F.round(weight, 9).alias("weight"))


@query("asym_logcosh", "SELECT lane, date, round(ln(cosh(greatest(-20, least(20, y - q50)))) * CASE WHEN y - q50 > 0 THEN 0.65 ELSE 0.35 END, 6) AS loss FROM predictions")
def asym_logcosh(spark, sf):
    return V.predictions(spark, sf).select("lane", "date", F.round(risk.asym_logcosh(F.col("y") - F.col("q50"), 0.65), 6).alias("loss"))


@query("surge_trigger", "SELECT event_id, event_type = 'purchase' OR coalesce(value, 0) / 1000 > 0.05 AS surge FROM events")
def surge_trigger(spark, sf):
    e = V.table(spark, sf, "events").select("event_id", (F.col("event_type") == "purchase").cast("int").alias("is_event"), (F.col("value") / 1000).alias("release_index"))
    return e.select("event_id", risk.surge_trigger(e.columns, ("is_event", "is_holiday"), ("release_index", "campaign_release_index")).alias("surge"))


@query("event_bucket", "SELECT event_id, CASE WHEN isodow(ts) = 7 THEN 'sunday' WHEN value / 200 > 0.35 THEN 'event' ELSE 'normal' END AS bucket FROM events")
def event_bucket(spark, sf):
    bucket = F.when(F.weekday("ts") == 6, "sunday").when(F.col("value") / 200 > 0.35, "event").otherwise("normal")
    return V.table(spark, sf, "events").select("event_id", bucket.alias("bucket"))
