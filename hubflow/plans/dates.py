"""Queries: calendar, slots and handling over midnight."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from hubflow import adapters as V
from hubflow.catalog import query
from hubflow.functions import timecost as T
from hubflow.operators import calendar
from hubflow.plans.windows import CAMPAIGNS, FIRST, LAST, MD

R = lambda c, n=6: F.round(c, n).alias(c)
HOUR = "CAST(split_part(slot, ':', 1) AS INTEGER)"


def days(spark, sf):
    return V.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("lane")).distinct()


DAYS = "(SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS lane FROM orders)"


@query("time_features", f"""
    SELECT lane, date, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, CAST(day(date) AS INTEGER) AS day, CAST(isodow(date) - 1 AS INTEGER) AS weekday, CAST(quarter(date) AS INTEGER) AS quarter,
           CAST(weekofyear(date) AS INTEGER) AS week, CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend, round(sin(2 * pi() * month(date) / 12), 9) + 0 AS month_sin, round(cos(2 * pi() * month(date) / 12), 9) + 0 AS month_cos,
           round(sin(2 * pi() * (isodow(date) - 1) / 7), 9) + 0 AS weekday_sin, round(cos(2 * pi() * (isodow(date) - 1) / 7), 9) + 0 AS weekday_cos FROM {DAYS}""")
def time_features(spark, sf):
    d = calendar.time_features(days(spark, sf))
    circles = ("month_sin", "month_cos", "weekday_sin", "weekday_cos")
    return d.select("lane", "date", "year", "month", "day", "weekday", "quarter", "week", "is_weekend", *((F.round(c, 9) + 0.0).alias(c) for c in circles))


@query("payday_features", f"""
    WITH d AS (SELECT lane, date, day(date) AS d, day(last_day(date)) AS n FROM {DAYS})
    SELECT lane, date, CAST(d BETWEEN 1 AND 5 OR d BETWEEN 15 AND 20 AS INTEGER) AS is_payday, round(sin(2 * pi() * d / n), 9) + 0 AS payday_sin_k1, round(cos(4 * pi() * d / n), 9) + 0 AS payday_cos_k2,
           round(CASE WHEN d >= 15 THEN exp(-(d - 15) / 2.2) ELSE exp(-(15 - d) / 1.2) END, 9) AS public_decay, round(CASE WHEN d <= 3 THEN exp(-(3 - d) / 1.5) ELSE exp(-(n - d) / 3.0) END, 9) AS private_decay,
           lane || '_' || (isodow(date) - 1) AS route_weekday FROM d""")
def payday_features(spark, sf):
    d = calendar.payday_features(days(spark, sf))
    return d.select("lane", "date", "is_payday", *((F.round(c, 9) + 0.0).alias(c) for c in ("payday_sin_k1", "payday_cos_k2")), R("public_decay", 9), R("private_decay", 9), "route_weekday")


@query("holiday_dim", f"SELECT o.o_orderkey, CAST(o.o_orderdate AS DATE) AS day FROM orders o WHERE CAST(o.o_orderdate AS DATE) IN (SELECT make_date(y, m, d) FROM (SELECT unnest(range({FIRST}, {LAST + 1})) AS y), (VALUES {MD}) t(m, d))")
def holiday_dim(spark, sf):
    """Orders of holidays, by the table of holidays."""
    o = V.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return o.join(F.broadcast(calendar.holiday_days(spark, FIRST, LAST)), "day", "left_semi").select("o_orderkey", "day")


@query("campaign_dim", f"WITH k AS ({CAMPAIGNS}) SELECT k.day, count(*) AS n FROM k JOIN orders o ON CAST(o.o_orderdate AS DATE) = k.day GROUP BY k.day")
def campaign_dim(spark, sf):
    o = V.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day"))
    return o.join(F.broadcast(calendar.campaign_days(spark, FIRST, LAST + 1)), "day").groupBy("day").agg(F.count("*").alias("n"))


@query("slot_timestamp", f"SELECT demand_id, CAST(day AS TIMESTAMP) + to_hours({HOUR}) AS at FROM demands")
def slot_timestamp(spark, sf):
    return V.demands(spark, sf).select("demand_id", calendar.slot_timestamp("day", "slot").alias("at"))


@query("normalize_slot", """
    WITH s AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'noon' ELSE (event_id % 24) || ':' || (event_id % 7) END AS raw FROM events)
    SELECT event_id, CASE WHEN regexp_matches(raw, '^[0-9]{1,2}:[0-9]{1,2}$') THEN lpad(split_part(raw, ':', 1), 2, '0') || ':' || lpad(split_part(raw, ':', 2), 2, '0') ELSE raw END AS slot FROM s""")
def normalize_slot(spark, sf):
    e = F.col("event_id")
    raw = F.when(e % 5 == 0, "noon").otherwise(F.concat_ws(":", (e % 24).cast("string"), (e % 7).cast("string")))
    return V.table(spark, sf, "events").select("event_id", raw.alias("raw")).select("event_id", calendar.normalize_slot("raw").alias("slot"))


@query("logical_slot", "SELECT event_id, user_id % 25 AS hub, CASE WHEN event_id % 10 = 0 THEN '09:00' WHEN hour(ts) < 13 THEN '09:00' ELSE '17:00' END AS slot FROM events")
def logical_slot(spark, sf):
    hour = F.when(F.col("event_id") % 10 == 0, "none").otherwise(F.hour("ts").cast("string"))
    return V.table(spark, sf, "events").select("event_id", (F.col("user_id") % 25).alias("hub"), calendar.logical_slot(hour).alias("slot"))


@query("arrival_day", f"""
    SELECT d.demand_id, v.vehicle_type, CAST(d.day + CAST(floor(({HOUR} + v.hours) / 24) AS INTEGER) AS DATE) AS arrival FROM demands d JOIN lane_vehicle v ON v.source = d.source AND v.destination = d.destination
    WHERE CAST(d.day + CAST(floor(({HOUR} + v.hours) / 24) AS INTEGER) AS DATE) IN (SELECT day FROM demands)""")
def arrival_day(spark, sf):
    """Days of arrival within the horizon."""
    d = V.demands(spark, sf)
    v = F.broadcast(V.lane_vehicle(spark, sf).select("source", "destination", "vehicle_type", "hours"))
    out = d.join(v, ["source", "destination"]).select("demand_id", "vehicle_type", T.arrival_day("day", calendar.slot_hour("slot"), "hours").alias("arrival"))
    return out.join(d.select(F.col("day").alias("arrival")).distinct(), "arrival", "left_semi").select("demand_id", "vehicle_type", "arrival")


@query("next_dispatch", f"""
    WITH t AS (SELECT d.demand_id, d.day, {HOUR} + v.hours AS total FROM demands d JOIN lane_vehicle v ON v.source = d.source AND v.destination = d.destination WHERE v.vehicle_type = 'Tır'),
    u AS (SELECT *, total - 24 * floor(total / 24) AS h, CAST(floor(total / 24) AS INTEGER) AS k FROM t)
    SELECT demand_id, CAST(day + k + CASE WHEN h < 17 THEN 0 ELSE 1 END AS DATE) AS next_day, CASE WHEN h < 9 THEN '09:00' WHEN h < 17 THEN '17:00' ELSE '09:00' END AS next_slot FROM u""")
def next_dispatch(spark, sf):
    v = F.broadcast(V.lane_vehicle(spark, sf).where("vehicle_type = 'Tır'").select("source", "destination", "hours"))
    day, slot = T.next_dispatch("day", calendar.slot_hour("slot"), "hours")
    return V.demands(spark, sf).join(v, ["source", "destination"]).select("demand_id", day.alias("next_day"), slot.alias("next_slot"))


@query("slot_step_hours", f"""
    WITH s AS (SELECT DISTINCT day, slot, CAST(day AS TIMESTAMP) + to_hours({HOUR}) AS began FROM demands)
    SELECT day, slot, coalesce((epoch(lead(began) OVER (ORDER BY began)) - epoch(began)) / 3600, 0) AS step FROM s""")
def slot_step_hours(spark, sf):
    """Hours to the next slot of the calendar. The window runs over distinct slots only."""
    s = V.demands(spark, sf).select("day", "slot").distinct().withColumn("at", F.unix_timestamp(calendar.slot_timestamp("day", "slot")))
    return s.select("day", "slot", F.coalesce((F.lead("at").over(Window.orderBy("at")) - F.col("at")) / 3600, F.lit(0.0)).alias("step"))


@query("date_window_filter", "SELECT lane, date, volume_0900 FROM lane_day WHERE date BETWEEN (SELECT max(date) FROM lane_day) - CAST(41 AS INTEGER) AND (SELECT max(date) FROM lane_day) - CAST(7 AS INTEGER)")
def date_window_filter(spark, sf):
    """The 35 days before the last seven."""
    d = V.lane_day(spark, sf)
    last = F.broadcast(d.agg(F.max("date").alias("last")))
    return d.crossJoin(last).where(F.col("date").between(F.date_sub("last", 41), F.date_sub("last", 7))).select("lane", "date", "volume_0900")


def split_at_midnight(rows, start: str, minutes: str, volume: str):
    """A row for each calendar day that an operation touches, with its share of the volume by time."""
    begin = F.unix_timestamp(start)
    d = rows.withColumn("_a", begin).withColumn("_b", begin + F.col(minutes) * 60)
    last = F.to_date(F.timestamp_seconds(F.greatest(F.col("_b") - 1, F.col("_a"))))
    d = d.withColumn("day", F.explode(F.sequence(F.to_date(start), last)))
    midnight = F.unix_date("day") * 86400
    inside = F.least("_b", midnight + 86400) - F.greatest("_a", midnight)
    return d.withColumn("share", F.when(F.col("_b") > F.col("_a"), F.col(volume) * inside / (F.col("_b") - F.col("_a"))).otherwise(F.col(volume))).drop("_a", "_b")


@query("midnight_split", f"""
    WITH o AS (SELECT demand_id, CAST(day AS TIMESTAMP) + to_hours({HOUR} + 6) AS began, volume, CAST(ceil(volume * 0.01) AS BIGINT) AS minutes FROM demands),
    s AS (SELECT *, began + to_minutes(minutes) AS done, unnest(generate_series(date_trunc('day', began), date_trunc('day', began + to_minutes(minutes) - INTERVAL 1 SECOND), INTERVAL 1 DAY)) AS m FROM o)
    SELECT demand_id, CAST(m AS DATE) AS day, round(volume * (epoch(least(done, m + INTERVAL 1 DAY)) - epoch(greatest(began, m))) / (minutes * 60), 6) AS share FROM s""")
def midnight_split(spark, sf):
    at = F.timestamp_seconds(F.unix_timestamp(calendar.slot_timestamp("day", "slot")) + 6 * 3600)
    d = V.demands(spark, sf).select("demand_id", at.alias("at"), "volume", T.handling_minutes("volume").alias("minutes"))
    return split_at_midnight(d, "at", "minutes", "volume").select("demand_id", "day", R("share"))
