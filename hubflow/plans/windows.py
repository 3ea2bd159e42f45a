"""Queries: window features of lanes and hubs."""

from pyspark.sql import functions as F

from hubflow import adapters as V
from hubflow.catalog import query
from hubflow.operators import calendar, features, hubs, rollups

R = lambda c, n=6: F.round(c, n).alias(c)
X = "volume_0900"
#: Years of the test tables.
FIRST, LAST = 1995, 2001
B = lambda n: f"OVER (PARTITION BY lane ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
L = "OVER (PARTITION BY lane ORDER BY date)"
MD = ", ".join(f"({m}, {d})" for m, d in V.HOLIDAYS)


@query("lags", f"SELECT lane, date, {', '.join(f'lag({X}, {k}) {L} AS lag_{k}' for k in (1, 7, 14))} FROM lane_day")
def lags(spark, sf):
    return features.lags(V.lane_day(spark, sf), X).select("lane", "date", "lag_1", "lag_7", "lag_14")


@query("rolling", f"""
    SELECT lane, date, {', '.join(f"round(avg({X}) {B(w)}, 6) AS rolling_mean_{w}, round(coalesce(stddev_samp({X}) {B(w)}, 0), 6) AS rolling_std_{w}, round(coalesce(stddev_samp({X}) {B(w)}, 0) / (avg({X}) {B(w)} + 1e-5), 5) AS rolling_cov_{w}" for w in (7, 14))}
    FROM lane_day""")
def rolling(spark, sf):
    d = features.rolling(V.lane_day(spark, sf), X)
    return d.select("lane", "date", *(R(f"rolling_{k}_{w}", 5 if k == "cov" else 6) for w in (7, 14) for k in ("mean", "std", "cov")))


@query("same_weekday", f"""
    SELECT lane, date, round(avg({X}) OVER w, 6) AS weekday_mean, round(coalesce(stddev_samp({X}) OVER w, 0), 6) AS weekday_std
    FROM lane_day WINDOW w AS (PARTITION BY lane, isodow(date) ORDER BY date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)""")
def same_weekday(spark, sf):
    return features.same_weekday(V.lane_day(spark, sf), X).select("lane", "date", R("weekday_mean"), R("weekday_std"))


@query("ema_momentum", f"""
    SELECT lane, date, CASE WHEN len(a) > 0 THEN round(list_reduce(list_prepend(0.0::DOUBLE, a), lambda s, v: s * 0.5 + v) / list_reduce(list_prepend(0.0::DOUBLE, a), lambda s, v: s * 0.5 + 1), 6) END AS ema, round(coalesce(m, 1), 6) AS momentum
    FROM (SELECT lane, date, coalesce(list({X}) {B(60)}, []) AS a, avg({X}) {B(3)} / (avg({X}) {B(14)} + 1e-5) AS m FROM lane_day)""")
def ema_momentum(spark, sf):
    return features.ema_momentum(V.lane_day(spark, sf), X).select("lane", "date", R("ema"), R("momentum"))


@query("target_scale", f"""
    SELECT lane, date, round(greatest(1, coalesce(m, (SELECT avg({X}) FROM lane_day))), 6) AS scale_factor, round({X} / greatest(1, coalesce(m, (SELECT avg({X}) FROM lane_day))), 6) AS scaled
    FROM (SELECT *, avg({X}) {B(14)} AS m FROM lane_day)""")
def target_scale(spark, sf):
    return features.target_scale(V.lane_day(spark, sf), X).select("lane", "date", R("scale_factor"), R("scaled"))


def streak_sql(table: str, flag: str, weight: str, alpha: float = 1.4, most: int = 4) -> str:
    """Rows of table with streak, accumulated, days_since, release, by islands."""
    return f"""
    SELECT *, CASE WHEN days_since BETWEEN 1 AND {most} THEN accumulated * exp(-days_since / {alpha}::DOUBLE) ELSE 0 END AS release FROM (
      SELECT *, CASE WHEN {flag} = 1 THEN 0 ELSE first_value(before) OVER (PARTITION BY lane, run ORDER BY date) END AS accumulated,
             CASE WHEN {flag} = 1 THEN -1 ELSE row_number() OVER (PARTITION BY lane, run ORDER BY date) END AS days_since FROM (
        SELECT *, coalesce(lag(streak) {L}, 0) AS before FROM (
          SELECT *, CASE WHEN {flag} = 1 THEN sum(coalesce({weight}, 0)) OVER (PARTITION BY lane, run ORDER BY date) ELSE 0 END AS streak FROM (
            SELECT *, sum(change) {L} AS run FROM (SELECT *, CASE WHEN lag({flag}) {L} IS NULL OR lag({flag}) {L} <> {flag} THEN 1 ELSE 0 END AS change FROM {table})))))"""


@query("streak_backlog", f"""
    WITH f AS (SELECT lane, date, {X} AS w, CASE WHEN {X} > 40 THEN 1 ELSE 0 END AS up FROM lane_day), s AS ({streak_sql("f", "up", "w")})
    SELECT lane, date, CAST(streak AS DOUBLE) AS streak, CAST(accumulated AS DOUBLE) AS accumulated, days_since, round(release, 6) AS release FROM s""")
def streak_backlog(spark, sf):
    d = V.lane_day(spark, sf).withColumn("up", (F.col(X) > 40).cast("int"))
    return features.streak_backlog(d, "up", X).select("lane", "date", "streak", "accumulated", "days_since", R("release"))


@query("holiday_backlog", f"""
    WITH h AS (SELECT DISTINCT make_date(y, m, d) AS day FROM (SELECT unnest(range({FIRST}, {LAST + 2})) AS y), (VALUES {MD}) t(m, d)),
    c AS (SELECT *, CASE WHEN date IN (SELECT day FROM h) THEN 1 ELSE 0 END AS is_holiday, CASE WHEN date + CAST(1 AS INTEGER) IN (SELECT day FROM h) OR date + CAST(2 AS INTEGER) IN (SELECT day FROM h) THEN 1 ELSE 0 END AS is_holiday_eve FROM lane_day),
    o AS (SELECT *, CASE WHEN is_holiday = 1 OR isodow(date) = 7 THEN 1 ELSE 0 END AS is_closed, CASE WHEN is_holiday = 1 OR isodow(date) = 7 THEN NULL ELSE {X} END AS x FROM c),
    u AS (SELECT *, CASE WHEN count(x) {B(28)} >= 7 THEN quantile_cont(x, 0.5) {B(28)} END AS usual0, avg(x) {B(14)} AS base0 FROM o),
    f AS (SELECT *, last_value(usual0 IGNORE NULLS) {L} AS usual, last_value(base0 IGNORE NULLS) {L} AS base FROM u), s AS ({streak_sql("f", "is_closed", "usual")})
    SELECT lane, date, is_holiday, is_holiday_eve, is_closed, round(accumulated, 6) AS backlog_accumulated, round(coalesce(accumulated / (base + 1e-5), 0), 5) AS backlog_severity_ratio,
           round(CASE WHEN days_since BETWEEN 1 AND 4 THEN coalesce(accumulated / (base + 1e-5), 0) * exp(-days_since / 1.4::DOUBLE) ELSE 0 END, 5) AS backlog_release_index FROM s""")
def holiday_backlog(spark, sf):
    d = features.holiday_backlog(V.lane_day(spark, sf), calendar.holiday_days(spark, FIRST, LAST + 1), X)
    return d.select("lane", "date", "is_holiday", "is_holiday_eve", "is_closed", R("backlog_accumulated"), R("backlog_severity_ratio", 5), R("backlog_release_index", 5))


CAMPAIGNS = f"""SELECT y, unnest([make_date(y, 2, 14), make_date(y, 11, 11),
      CAST(make_date(y, 5, 1) + CAST((7 - isodow(make_date(y, 5, 1))) + 7 AS INTEGER) AS DATE), CAST(make_date(y, 6, 1) + CAST((7 - isodow(make_date(y, 6, 1))) + 14 AS INTEGER) AS DATE),
      CAST(make_date(y, 11, 30) - CAST((isodow(make_date(y, 11, 30)) + 2) % 7 AS INTEGER) AS DATE)]) AS day FROM (SELECT unnest(range({FIRST}, {LAST + 2})) AS y)"""


def campaign_marked(spark, sf):
    return features.campaign_backlog(V.lane_day(spark, sf), calendar.campaign_days(spark, FIRST, LAST + 1), X)


@query("campaign_backlog", f"""
    WITH k AS ({CAMPAIGNS}), c AS (SELECT *, CASE WHEN date IN (SELECT day FROM k) THEN 1 ELSE 0 END AS is_campaign_day,
      CASE WHEN date + CAST(1 AS INTEGER) IN (SELECT day FROM k) OR date + CAST(2 AS INTEGER) IN (SELECT day FROM k) OR date + CAST(3 AS INTEGER) IN (SELECT day FROM k) THEN 1 ELSE 0 END AS is_campaign_eve, avg({X}) {B(14)} AS base FROM lane_day),
    s AS ({streak_sql("c", "is_campaign_eve", X)})
    SELECT lane, date, is_campaign_day, is_campaign_eve, CAST(accumulated AS DOUBLE) AS campaign_accumulated, round(coalesce(accumulated / (base + 1e-5), 0), 5) AS campaign_severity_ratio,
           round(CASE WHEN days_since BETWEEN 1 AND 4 THEN coalesce(accumulated / (base + 1e-5), 0) * exp(-days_since / 1.4::DOUBLE) ELSE 0 END, 5) AS campaign_release_index FROM s""")
def campaign_backlog(spark, sf):
    return campaign_marked(spark, sf).select("lane", "date", "is_campaign_day", "is_campaign_eve", "campaign_accumulated", R("campaign_severity_ratio", 5), R("campaign_release_index", 5))


@query("campaign_lags", f"""
    WITH k AS ({CAMPAIGNS}), c AS (SELECT lane, date, CASE WHEN date IN (SELECT day FROM k) THEN 1 ELSE 0 END AS f FROM lane_day)
    SELECT lane, date, coalesce(lag(f, 1) {L}, 0) AS campaign_lag_1, coalesce(lag(f, 2) {L}, 0) AS campaign_lag_2,
           (CASE WHEN lag(f, 1) {L} = 1 THEN 'CampaignLag1_day' ELSE 'NoCampaignLag1_day' END) || (isodow(date) - 1) AS campaign_lag_weekday FROM c""")
def campaign_lags(spark, sf):
    return features.campaign_lags(campaign_marked(spark, sf)).select("lane", "date", "campaign_lag_1", "campaign_lag_2", "campaign_lag_weekday")


@query("post_event_flags", f"""
    WITH k AS ({CAMPAIGNS}), h AS (SELECT DISTINCT make_date(y, m, d) AS day FROM (SELECT unnest(range({FIRST}, {LAST + 2})) AS y), (VALUES {MD}) t(m, d)),
    c AS (SELECT lane, date, CASE WHEN date IN (SELECT day FROM k) THEN 1 ELSE 0 END AS c, CASE WHEN date IN (SELECT day FROM h) THEN 1 ELSE 0 END AS h FROM lane_day)
    SELECT lane, date, CASE WHEN lag(h) {L} = 1 AND h = 0 THEN 1 ELSE 0 END AS is_post_holiday, CASE WHEN lag(c) {L} = 1 AND c = 0 THEN 1 ELSE 0 END AS is_post_campaign FROM c""")
def post_event_flags(spark, sf):
    d = features.holiday_backlog(campaign_marked(spark, sf), calendar.holiday_days(spark, FIRST, LAST + 1), X)
    return features.post_event_flags(d).select("lane", "date", "is_post_holiday", "is_post_campaign")


@query("organic_backlog", f"""
    WITH a AS (SELECT lane, date, coalesce(lag({X}) {L} / (avg({X}) {B(14)} + 1e-5), 1) AS activity_ratio FROM lane_day),
    f AS (SELECT *, least(1, greatest(0, 1 - activity_ratio)) AS deficit, CASE WHEN activity_ratio < 0.5 THEN 1 ELSE 0 END AS is_slow FROM a), s AS ({streak_sql("f", "is_slow", "deficit")})
    SELECT lane, date, round(activity_ratio, 5) AS activity_ratio, round(deficit, 5) AS deficit, is_slow, round(accumulated, 5) AS organic_accumulated, days_since AS organic_days_since, round(release, 5) AS organic_release FROM s""")
def organic_backlog(spark, sf):
    d = features.organic_backlog(V.lane_day(spark, sf), X)
    return d.select("lane", "date", R("activity_ratio", 5), R("deficit", 5), "is_slow", R("organic_accumulated", 5), "organic_days_since", R("organic_release", 5))


@query("regime_shift", f"""
    SELECT lane, date, round(coalesce(volume_1700 / 100 * lag({X}) {L} / (avg({X}) {B(14)} + 1e-5), 0), 5) AS backlog_scaled_impact,
           round(coalesce((avg({X}) {B(3)} - avg({X}) {B(14)}) / (coalesce(stddev_samp({X}) {B(14)}, 0) + 1e-5), 0), 4) AS demand_acceleration FROM lane_day""")
def regime_shift(spark, sf):
    return features.regime_shift(V.lane_day(spark, sf), X, F.col("volume_1700") / 100).select("lane", "date", R("backlog_scaled_impact", 5), R("demand_acceleration", 4))


@query("cross_lag", "SELECT lane, date, volume_1700, volume_0900 AS cross_lag_0900_same_day FROM lane_day")
def cross_lag(spark, sf):
    return V.lane_day(spark, sf).select("lane", "date", "volume_1700", F.col("volume_0900").alias("cross_lag_0900_same_day"))


@query("lane_codes", "SELECT lane, date, CAST(dense_rank() OVER (ORDER BY lane) - 1 AS INTEGER) AS lane_code, CAST((dense_rank() OVER (ORDER BY lane) - 1) * 10 + isodow(date) - 1 AS INTEGER) AS lane_weekday FROM lane_day")
def lane_codes(spark, sf):
    return features.lane_codes(V.lane_day(spark, sf)).select("lane", "date", "lane_code", "lane_weekday")


@query("censored_demand", f"""
    WITH c AS (SELECT *, {X} > 50 AND {X} >= 0.98 * max({X}) {B(14)} AS candidate FROM lane_day),
    o AS (SELECT *, coalesce(sum(CAST(candidate AS INTEGER)) OVER (PARTITION BY lane, isodow(date) ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) >= 2 AS often, sum({X}) OVER (PARTITION BY source, date) AS hub FROM c),
    g AS (SELECT lane, date, {X}, coalesce(candidate AND CASE WHEN source < 'B' THEN hub >= 0.9 * 120 WHEN source < 'E' THEN hub >= 0.9 * 150 ELSE often END, FALSE) AS hit FROM o)
    SELECT lane, date, CAST(hit AS INTEGER) AS is_censored, round(CASE WHEN hit THEN {X} * 1.05 ELSE {X} END, 6) AS unconstrained FROM g""")
def censored_demand(spark, sf):
    hubs_of = V.table(spark, sf, "region").where("r_name < 'E'").select(F.col("r_name").alias("hub"), F.when(F.col("r_name") < "B", 120.0).otherwise(150.0).alias("capacity"))
    return features.censored_demand(V.lane_day(spark, sf), X, hubs_of).select("lane", "date", "is_censored", R("unconstrained"))


@query("hub_lag", f"""
    WITH h AS (SELECT source, date, lag(sum({X})) OVER (PARTITION BY source ORDER BY date) AS hub_lag_1 FROM lane_day GROUP BY source, date)
    SELECT lane, date, hub_lag_1 FROM lane_day JOIN h USING (source, date)""")
def hub_lag(spark, sf):
    return hubs.hub_lag(V.lane_day(spark, sf), X).select("lane", "date", "hub_lag_1")


_means = lambda name, end: ", ".join(f"avg(total) OVER (PARTITION BY {end} ORDER BY date ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) AS {name}_{w}" for w in (1, 7))
_pressures = ", ".join(f"round(hub_out_{w}, 5) AS hub_out_{w}, round(hub_in_{w}, 5) AS hub_in_{w}, round(hub_in_{w} / (hub_out_{w} + 1e-5), 5) AS pressure_{w}, round(hub_out_{w} / (network_{w} + 1e-5), 5) AS centrality_{w}" for w in (1, 7))


@query("hub_pressure", f"""
    WITH o AS (SELECT source, date, sum({X}) AS total FROM lane_day GROUP BY ALL), i AS (SELECT dest, date, sum({X}) AS total FROM lane_day GROUP BY ALL),
    a AS (SELECT source, date, {_means('hub_out', 'source')}, lag(total) OVER (PARTITION BY source ORDER BY date) AS y FROM o),
    b AS (SELECT dest, date, {_means('hub_in', 'dest')}, lag(total) OVER (PARTITION BY dest ORDER BY date) AS neighbours_2 FROM i), n AS (SELECT date, avg(hub_out_1) AS network_1, avg(hub_out_7) AS network_7 FROM a GROUP BY date),
    d AS (SELECT *, lag({X}) {L} AS own FROM lane_day)
    SELECT lane, date, {_pressures}, CASE WHEN y IS NULL THEN 0 ELSE greatest(0, y - own) END AS neighbours_1, neighbours_2
    FROM d JOIN a USING (source, date) JOIN b USING (dest, date) JOIN n USING (date)""")
def hub_pressure(spark, sf):
    d = hubs.hub_pressure(V.lane_day(spark, sf), X)
    return d.select("lane", "date", *(R(f"{c}_{w}", 5) for w in (1, 7) for c in ("hub_out", "hub_in", "pressure", "centrality")), "neighbours_1", "neighbours_2")


@query("hub_share", f"""
    WITH s AS (SELECT lane, date, coalesce({X} / nullif(sum({X}) OVER (PARTITION BY source, date), 0), 0) AS share FROM lane_day)
    SELECT lane, date, round(share, 6) AS share, {', '.join(f'round(lag(share, {k}) {L}, 6) AS share_lag_{k}' for k in (7, 14, 21))} FROM s""")
def hub_share(spark, sf):
    return hubs.hub_share(V.lane_day(spark, sf), X).select("lane", "date", R("share"), *(R(f"share_lag_{k}") for k in (7, 14, 21)))


@query("cross_group_stats", f"""
    WITH d AS (SELECT *, CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend FROM lane_day),
    b AS (SELECT source, is_weekend, date, max({X}) AS m, sum({X}) AS s, sum({X} * {X}) AS q, count(*) AS n FROM d GROUP BY ALL),
    w AS (SELECT source, is_weekend, date, max(m) OVER w AS m, sum(s) OVER w AS s, sum(q) OVER w AS q, sum(n) OVER w AS n FROM b WINDOW w AS (PARTITION BY source, is_weekend ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT lane, d.date, m AS group_max, round(s / n, 6) AS group_mean, CASE WHEN n > 1 THEN round(sqrt(greatest(0, (q - s * s / n) / (n - 1))), 5) WHEN n = 1 THEN 0 END AS group_std FROM d JOIN w ON w.source = d.source AND w.is_weekend = d.is_weekend AND w.date = d.date""")
def cross_group_stats(spark, sf):
    d = V.lane_day(spark, sf).withColumn("is_weekend", (F.weekday("date") >= 5).cast("int"))
    return features.cross_group_stats(d, X, "source", "is_weekend").select("lane", "date", "group_max", R("group_mean"), R("group_std", 5))


@query("extreme_events", f"""
    WITH e AS (SELECT lane, date, coalesce(CAST(lag({X}) {L} > avg({X}) {B(7)} + 2 * coalesce(stddev_samp({X}) {B(7)}, 0) AS INTEGER), 0) AS is_extreme, coalesce(coalesce(stddev_samp({X}) {B(7)}, 0) / (avg({X}) {B(7)} + 1e-5), 0) AS restless FROM lane_day)
    SELECT lane, date, is_extreme, round(restless, 5) AS restless, round(coalesce(avg(is_extreme) OVER (PARTITION BY lane ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 9) AS extreme_share FROM e""")
def extreme_events(spark, sf):
    return features.extreme_events(V.lane_day(spark, sf), X).select("lane", "date", "is_extreme", R("restless", 5), R("extreme_share", 9))


@query("regret_weights", f"""
    WITH p AS (SELECT lane, {X} AS x FROM lane_day WHERE {X} > 0),
    k AS (SELECT lane, CASE WHEN count(*) >= 5 THEN quantile_cont(x, 0.9) ELSE (SELECT quantile_cont(x, 0.9) FROM p) END AS capacity FROM p GROUP BY lane),
    r AS (SELECT lane, date, CASE WHEN {X} > capacity THEN ({X} - capacity) * 3 ELSE capacity - {X} END AS regret FROM lane_day JOIN k USING (lane)),
    m AS (SELECT *, coalesce(avg(regret) OVER (PARTITION BY lane ORDER BY date RANGE BETWEEN INTERVAL 14 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING), 1e-5) AS mean FROM r),
    w AS (SELECT lane, date, regret, regret / sqrt(mean + 1) AS raw FROM m)
    SELECT lane, date, round(regret, 6) AS regret, round(1 + 4 * (raw - (SELECT min(raw) FROM w)) / ((SELECT max(raw) FROM w) - (SELECT min(raw) FROM w)), 5) AS weight FROM w""")
def regret_weights(spark, sf):
    days = V.lane_day(spark, sf)
    return features.regret_weights(days, X, rollups.regret_capacity(days, X).select("lane", "capacity")).select("lane", "date", R("regret"), R("weight", 5))


@query("context_tail", f"SELECT lane, date, {X} FROM (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY date DESC) AS back FROM lane_day) WHERE back <= 44")
def context_tail(spark, sf):
    return features.context_tail(V.lane_day(spark, sf), 44).select("lane", "date", X)


@query("edge_fill", f"""
    SELECT lane, date, coalesce(last_value(lag_30 IGNORE NULLS) {L}, first_value(lag_30 IGNORE NULLS) OVER (PARTITION BY lane ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS lag_30
    FROM (SELECT lane, date, lag({X}, 30) {L} AS lag_30 FROM lane_day)""")
def edge_fill(spark, sf):
    return features.edge_fill(features.lags(V.lane_day(spark, sf), X, (30,)), ["lag_30"]).select("lane", "date", "lag_30")
