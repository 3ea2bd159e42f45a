"""Queries: forecast scores, risk bands and payloads."""

from pyspark.sql import functions as F

from hubflow import adapters as V
from hubflow.catalog import query
from hubflow.functions import risk
from hubflow.operators import rollups, scores
from hubflow.sources import files

P = "predictions"
R = lambda c, n=6: F.round(c, n).alias(c)
ERR = "(y - q50)"
SQL = {
    "n": "count(*)", "wape": f"round(coalesce(sum(abs{ERR}) / nullif(sum(y), 0), 0), 6)", "mae": f"round(avg(abs{ERR}), 6)", "rmse": f"round(sqrt(avg({ERR} * {ERR})), 6)",
    "pinball_10": "round(avg(greatest(0.1 * (y - q10), -0.9 * (y - q10))), 6)", "pinball_50": f"round(avg(greatest(0.5 * {ERR}, -0.5 * {ERR})), 6)", "pinball_90": "round(avg(greatest(0.9 * (y - q90), -0.1 * (y - q90))), 6)",
    "regret": f"round(avg(CASE WHEN {ERR} > 0 THEN 9 * {ERR} ELSE -{ERR} END), 6)", "coverage": "round(avg(CAST(y BETWEEN q10 AND q90 AS INTEGER)), 9)",
    "spot_q50": f"round(sum(greatest({ERR}, 0) + 0.2 * greatest(-{ERR}, 0)), 4)", "spot_q90": "round(sum(greatest(y - q90, 0) + 0.2 * greatest(q90 - y, 0)), 4)",
}
DIGITS = {"coverage": 9, "spot_q50": 4, "spot_q90": 4}


def shown(names):
    return [F.col(n) if n == "n" else R(n, DIGITS.get(n, 6)) for n in names]


def columns(names) -> str:
    return ", ".join(f"{SQL[n]} AS {n}" for n in names)


def scored(name, names, key=None, key_sql=None):
    head = f"{key_sql or key} AS {key}, " if key else ""

    @query(name, f"SELECT {head}{columns(names)} FROM {P}{f' GROUP BY {key_sql or key}' if key else ''}")
    def run(spark, sf, key_column=key):
        d = V.predictions(spark, sf)
        if key == "month":
            d = d.withColumn("month", F.month("date"))
        return scores.evaluate(d, *([key] if key else [])).select(*([key] if key else []), *shown(names))

    return run


wape = scored("wape", ["wape"])
mae = scored("mae", ["mae"], "lane")
rmse = scored("rmse", ["rmse"], "lane")
mae_rmse = scored("mae_rmse", ["mae", "rmse"], "lane")
pinball = scored("pinball", ["pinball_10", "pinball_50", "pinball_90"], "lane")
decision_regret = scored("decision_regret", ["regret"], "lane")
coverage = scored("coverage", ["coverage"], "lane")
spot_cost_sim = scored("spot_cost_sim", ["spot_q50", "spot_q90"], "lane")
evaluate_all = scored("evaluate_all", list(SQL), "lane")


@query("horizon_errors", f"SELECT (date_diff('day', (SELECT min(date) FROM {P}), date)) % 7 AS horizon, {columns(['n', 'wape', 'regret'])} FROM {P} GROUP BY 1")
def horizon_errors(spark, sf):
    """By days since the last of weekly cutoffs."""
    p = V.predictions(spark, sf)
    d = p.crossJoin(F.broadcast(p.agg(F.min("date").alias("first")))).withColumn("horizon", F.datediff("date", "first") % 7)
    return scores.evaluate(d, "horizon").select("horizon", *shown(["n", "wape", "regret"]))


@query("flatten_scores", f"SELECT {', '.join(f'{SQL[n]} AS slot_0900__{n}' for n in ('wape', 'regret'))} FROM {P}")
def flatten_scores(spark, sf):
    """A nested row of scores as flat columns."""
    one = scores.evaluate(V.predictions(spark, sf)).select(F.struct(*shown(["wape", "regret"])).alias("slot_0900"))
    return one.select(*(F.col(f"slot_0900.{n}").alias(f"slot_0900__{n}") for n in ("wape", "regret")))


HYBRID = """coalesce(sum(abs(y - q50)) / nullif(sum(y), 0), 0) AS wape, coalesce(sum(greatest(y - q50, 0)) / nullif(sum(y), 0), 0) AS under_rate,
    coalesce(sum(q90 - q10) / nullif(sum(q50), 0), 0) AS width, avg(CAST(q10 > q50 OR q50 > q90 AS INTEGER)) AS crossing"""


@query("hybrid_score", f"SELECT lane, round(wape, 6) AS wape, round(under_rate, 6) AS under_rate, round(width, 6) AS width, crossing, round(wape + 0.5988 * under_rate + 0.03 * width + 0.10 * crossing, 6) AS hybrid FROM (SELECT lane, {HYBRID} FROM {P} GROUP BY lane)")
def hybrid_score(spark, sf):
    return scores.hybrid_score(V.predictions(spark, sf), 0.5988, "lane").select("lane", R("wape"), R("under_rate"), R("width"), "crossing", R("hybrid"))


ALPHAS = [0.5, 0.54, 0.58, 0.62, 0.66, 0.7]
LONG = f"(SELECT y, q10 * (0.5 + a) AS q10, q50 * (0.5 + a) AS q50, q90 * (0.5 + a) AS q90, a AS alpha FROM {P}, (SELECT CAST(unnest({ALPHAS}) AS DOUBLE) AS a))"


def sweep(spark, sf):
    """Predictions of each candidate alpha, here scaled ones."""
    d = V.predictions(spark, sf).withColumn("alpha", F.explode(F.array(*map(F.lit, ALPHAS))))
    return d.withColumns({c: F.col(c) * (0.5 + F.col("alpha")) for c in ("q10", "q50", "q90")})


@query("alpha_sweep_scores", f"SELECT alpha, {columns(['wape', 'regret', 'coverage'])} FROM {LONG} GROUP BY alpha")
def alpha_sweep_scores(spark, sf):
    return scores.evaluate(sweep(spark, sf), "alpha").select("alpha", *shown(["wape", "regret", "coverage"]))


@query("alpha_knee", f"""
    WITH s AS (SELECT alpha, {HYBRID}, avg(CASE WHEN y > q50 THEN 9 * (y - q50) ELSE q50 - y END) AS regret FROM {LONG} GROUP BY alpha)
    SELECT arg_min(alpha, wape + 0.5988 * under_rate + 0.03 * width + 0.10 * crossing) AS best_hybrid, arg_min(alpha, regret) AS best_regret FROM s""")
def alpha_knee(spark, sf):
    d = sweep(spark, sf)
    h = scores.hybrid_score(d, 0.5988, "alpha").select("alpha", "hybrid")
    r = scores.evaluate(d, "alpha").select("alpha", "regret")
    return h.join(r, "alpha").agg(F.min_by("alpha", "hybrid").alias("best_hybrid"), F.min_by("alpha", "regret").alias("best_regret"))


@query("clean_wape", f"""
    WITH w AS (SELECT year(date) AS y, weekofyear(date) AS k, avg(y) AS m FROM {P} WHERE y > 0 GROUP BY ALL), x AS (SELECT y, k FROM w WHERE m > 1.1 * (SELECT avg(m) FROM w))
    SELECT CASE WHEN count(*) >= 10 THEN round(coalesce(sum(abs(p.y - p.q50)) / nullif(sum(p.y), 0), 0), 6) END AS clean_wape FROM {P} p
    WHERE isodow(p.date) < 7 AND NOT (month(p.date) = 1 AND day(p.date) = 1) AND (year(p.date), weekofyear(p.date)) NOT IN (SELECT (y, k) FROM x)""")
def clean_wape(spark, sf):
    """Without Sundays, New Year and abnormal weeks; null under ten rows."""
    p = V.predictions(spark, sf)
    odd = F.broadcast(rollups.abnormal_weeks(p, "y", 1.1).select("year", "week"))
    d = p.where((F.weekday("date") < 6) & ~((F.month("date") == 1) & (F.dayofmonth("date") == 1)))
    d = d.withColumns({"year": F.year("date"), "week": F.weekofyear("date")}).join(odd, ["year", "week"], "left_anti")
    return d.agg(F.when(F.count("*") >= 10, F.round(scores.wape(), 6)).alias("clean_wape"))


LANE_ERRORS = f"""SELECT lane, count(*) AS n, avg(y) AS mean, sum(y) AS total, coalesce(sum(abs(y - q50)) / nullif(sum(y), 0), 0) AS wape, avg(CASE WHEN y > q50 THEN 9 * (y - q50) ELSE q50 - y END) AS regret,
    coalesce(sum(q50 - y) / nullif(sum(y), 0), 0) * 100 AS bias_pct FROM {P} GROUP BY lane"""


@query("lane_errors", f"""
    SELECT lane, n, round(mean, 6) AS mean, total, round(wape, 6) AS wape, round(regret, 6) AS regret, round(bias_pct, 6) AS bias_pct,
           CASE WHEN bias_pct > 15 THEN 'over' WHEN bias_pct < -15 THEN 'under' ELSE 'balanced' END AS direction, round(n / (n + 30), 9) AS shrink FROM ({LANE_ERRORS})""")
def lane_errors(spark, sf):
    d = scores.lane_errors(V.predictions(spark, sf))
    return d.select("lane", "n", R("mean"), "total", R("wape"), R("regret"), R("bias_pct"), "direction", R("shrink", 9))


@query("lane_error_ranking", f"SELECT lane, round(regret, 6) AS regret FROM ({LANE_ERRORS}) WHERE mean >= 1 ORDER BY regret DESC, lane LIMIT 10")
def lane_error_ranking(spark, sf):
    return scores.lane_errors(V.predictions(spark, sf)).where("mean >= 1").orderBy(F.desc("regret"), "lane").limit(10).select("lane", R("regret"))


def bins_sql(value: str, n: int, where: str = "TRUE") -> str:
    edges = ", ".join(f"quantile_cont({value}, {i / n})" for i in range(1, n))
    return f"(SELECT p.*, len(list_filter(list_distinct(e), lambda x: x < {value})) AS bin FROM (SELECT * FROM {P} WHERE {where}) p, (SELECT [{edges}] AS e FROM {P} WHERE {where}))"


BIN_COLUMNS = "count(*) AS n, round(avg(CASE WHEN y > 0 THEN (q50 - y) / y * 100 END), 5) AS mean_pct, round(quantile_cont(CASE WHEN y > 0 THEN (q50 - y) / y * 100 END, 0.5), 5) AS median_pct, round(sum(greatest(q50 - y, 0)), 4) AS over"


@query("decile_errors", f"SELECT CAST(bin AS INTEGER) AS bin, {BIN_COLUMNS.replace('AS over', 'AS over_volume')} FROM {bins_sql('q50', 10, 'y >= 20')} GROUP BY bin")
def decile_errors(spark, sf):
    d = scores.bin_errors(scores.binned(V.predictions(spark, sf).where("y >= 20"), "q50", 10))
    return d.select("bin", "n", R("mean_pct", 5), R("median_pct", 5), F.round("over", 4).alias("over_volume"))


@query("correction_bins", f"SELECT CAST(bin AS INTEGER) AS bin, {BIN_COLUMNS.replace('AS over', 'AS over_volume')} FROM {bins_sql('(q90 - q50)', 5)} GROUP BY bin")
def correction_bins(spark, sf):
    """Quintiles of what a correction adds, here the upper half of the band."""
    p = V.predictions(spark, sf).withColumn("added", F.col("q90") - F.col("q50"))
    return scores.bin_errors(scores.binned(p, "added", 5)).select("bin", "n", R("mean_pct", 5), R("median_pct", 5), F.round("over", 4).alias("over_volume"))


@query("weekday_errors", f"""
    SELECT CAST(isodow(date) - 1 AS INTEGER) AS weekday, count(*) AS n, round(quantile_cont(CASE WHEN y > 0 THEN (q50 - y) / y * 100 END, 0.5), 5) AS median_pct, count(*) FILTER (y > q50) AS n_under, count(*) FILTER (y < q50) AS n_over,
           round(sum(greatest(y - q50, 0)), 4) AS under_volume, round(sum(greatest(q50 - y, 0)), 4) AS over_volume, {SQL['regret']} AS regret FROM {P} WHERE q50 >= 10 AND q50 < 1200 GROUP BY 1""")
def weekday_errors(spark, sf):
    d = scores.weekday_errors(V.predictions(spark, sf), 10)
    return d.select("weekday", "n", R("median_pct", 5), "n_under", "n_over", F.round("under", 4).alias("under_volume"), F.round("over", 4).alias("over_volume"), R("regret"))


@query("tracked_lanes", f"SELECT lane, date, round((q50 - y) / nullif(y, 0) * 100, 5) AS before_pct, round((q90 - y) / nullif(y, 0) * 100, 5) AS after_pct FROM {P} WHERE lane LIKE 'ASIA%' AND y > 0")
def tracked_lanes(spark, sf):
    pct = lambda c: F.round(F.try_divide(F.col(c) - F.col("y"), "y") * 100, 5)
    return V.predictions(spark, sf).where(F.col("lane").startswith("ASIA") & (F.col("y") > 0)).select("lane", "date", pct("q50").alias("before_pct"), pct("q90").alias("after_pct"))


def slotted(spark, sf):
    """Bands of both slots; the afternoon's are half as wide."""
    p = V.predictions(spark, sf)
    late = p.withColumns({"q10": (F.col("q10") + F.col("q50")) / 2, "q90": (F.col("q90") + F.col("q50")) / 2})
    return p.withColumn("slot", F.lit("09:00")).unionByName(late.withColumn("slot", F.lit("17:00"))).drop("y")


SLOTTED = f"(SELECT lane, source, dest, date, q10, q50, q90, '09:00' AS slot FROM {P} UNION ALL SELECT lane, source, dest, date, (q10 + q50) / 2, q50, (q90 + q50) / 2, '17:00' FROM {P})"

PARAMS = f"""
    a AS MATERIALIZED (SELECT slot, quantile_cont(q50, 0.1) FILTER (q50 > 1) AS p10, quantile_cont(q50, 0.25) FILTER (q50 > 1) AS p25, quantile_cont(q50, 0.5) FILTER (q50 > 1) AS p50 FROM b GROUP BY slot),
    c AS MATERIALIZED (SELECT b.slot, quantile_cont((q90 - q10) / greatest(q50, 1), 0.5) AS scale FROM b JOIN a ON a.slot = b.slot WHERE q50 > p10 GROUP BY b.slot),
    t AS MATERIALIZED (SELECT b.slot, quantile_cont(CASE WHEN scale > 0 THEN 2 / pi() * atan(greatest((q90 - q10) / greatest(q50, 1), 0) / scale) ELSE 1 END, 0.5) AS tau FROM b JOIN c ON c.slot = b.slot GROUP BY b.slot),
    r AS MATERIALIZED (SELECT a.slot, greatest(p25, greatest(50, 0.1 * p50)) AS floor, scale, tau FROM a JOIN c ON c.slot = a.slot JOIN t ON t.slot = a.slot)"""


@query("risk_params", f"WITH b AS (SELECT * FROM {SLOTTED}), {PARAMS} SELECT slot, round(floor, 6) AS floor, round(scale, 6) AS scale, round(tau, 6) AS tau FROM r")
def risk_params(spark, sf):
    return rollups.risk_params(slotted(spark, sf), ["slot"]).select("slot", R("floor"), R("scale"), R("tau"))


BAND = f"""
    b AS MATERIALIZED (SELECT * FROM {SLOTTED}), {PARAMS},
    d AS MATERIALIZED (SELECT lane, source, dest, date, b.slot, CAST(round_even(CAST(round(least(greatest(0, q10), greatest(0, q50)), 10) AS DECIMAL(30, 10)), 4) AS DOUBLE) AS q10, CAST(round_even(CAST(round(greatest(0, q50), 10) AS DECIMAL(30, 10)), 4) AS DOUBLE) AS q50, CAST(round_even(CAST(round(greatest(q90, greatest(0, q50)), 10) AS DECIMAL(30, 10)), 4) AS DOUBLE) AS q90, round(floor, 6) AS floor, round(scale, 6) AS scale, round(tau, 6) AS tau FROM b JOIN r ON r.slot = b.slot),
    e AS MATERIALIZED (SELECT *, CAST(round_even(CAST(round(q90 - q10, 10) AS DECIMAL(30, 10)), 4) AS DOUBLE) AS uncertainty_range, CAST(round_even(CAST(round((q90 - q50) * 0.5, 10) AS DECIMAL(30, 10)), 4) AS DOUBLE) AS safety_buffer FROM d),
    f AS MATERIALIZED (SELECT *, CAST(round_even(CAST(round(q50 + safety_buffer, 10) AS DECIMAL(30, 10)), 4) AS DOUBLE) AS recommended, CAST(round_even(CAST(round(CASE WHEN scale <= 0 THEN 1 ELSE 2 / pi() * atan(greatest(uncertainty_range / greatest(q50, 1), 0) / scale) END, 10) AS DECIMAL(30, 10)), 4) AS DOUBLE) AS relative,
          CAST(round_even(CAST(round(tau + 0.35 * pow(greatest(q50, 1), -0.30), 10) AS DECIMAL(30, 10)), 4) AS DOUBLE) AS threshold, CAST(round_even(CAST(round(2 + ln(1 + greatest(q50, 1)), 10) AS DECIMAL(30, 10)), 4) AS DOUBLE) AS steepness FROM e),
    g AS MATERIALIZED (SELECT *, CAST(round_even(CAST(round(1 / (1 + exp(-greatest(-100, least(100, steepness * (relative - threshold))))), 10) AS DECIMAL(30, 10)), 4) AS DOUBLE) AS raw_score FROM f),
    h AS MATERIALIZED (SELECT *, CAST(round_even(CAST(round(raw_score * sqrt(least(1, q50 / floor)), 10) AS DECIMAL(30, 10)), 4) AS DOUBLE) AS risk_score FROM g),
    k AS MATERIALIZED (SELECT *, CASE WHEN risk_score < 0.35 THEN 'LOW' WHEN risk_score <= 0.82 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_class FROM h)"""


def bands(spark, sf, b=None):
    b = slotted(spark, sf) if b is None else b
    params = rollups.risk_params(b, ["slot"]).select("slot", R("floor"), R("scale"), R("tau"))
    return risk.risk_score(risk.demand_band(b).join(F.broadcast(params), "slot"))


@query("demand_band", f"WITH {BAND} SELECT lane, date, slot, q10, q50, q90, uncertainty_range, safety_buffer, recommended FROM k")
def demand_band(spark, sf):
    return bands(spark, sf).select("lane", "date", "slot", "q10", "q50", "q90", "uncertainty_range", "safety_buffer", "recommended")


@query("risk_score", f"WITH {BAND} SELECT lane, date, slot, relative, threshold, steepness, raw_score, risk_score, risk_class FROM k")
def risk_score(spark, sf):
    return bands(spark, sf).select("lane", "date", "slot", "relative", "threshold", "steepness", "raw_score", "risk_score", "risk_class")


@query("risk_class", f"WITH {BAND} SELECT lane, date, slot, risk_class FROM k")
def risk_class(spark, sf):
    return bands(spark, sf).select("lane", "date", "slot", "risk_class")


@query("risk_summary", f"WITH {BAND} SELECT slot, count(*) FILTER (risk_class = 'LOW') AS low, count(*) FILTER (risk_class = 'MEDIUM') AS medium, count(*) FILTER (risk_class = 'HIGH') AS high, count(DISTINCT date) AS horizon, count(*) FILTER (raw_score > 0.82 AND risk_class <> 'HIGH') AS damped FROM k GROUP BY slot UNION ALL SELECT 'all', count(*) FILTER (risk_class = 'LOW'), count(*) FILTER (risk_class = 'MEDIUM'), count(*) FILTER (risk_class = 'HIGH'), count(DISTINCT date), count(*) FILTER (raw_score > 0.82 AND risk_class <> 'HIGH') FROM k")
def risk_summary(spark, sf):
    """Counts of classes for each slot and for all, in one pass."""
    n = lambda c: F.count_if(F.col("risk_class") == c)
    out = bands(spark, sf).rollup("slot").agg(n("LOW").alias("low"), n("MEDIUM").alias("medium"), n("HIGH").alias("high"), F.count_distinct("date").alias("horizon"), F.count_if((F.col("raw_score") > risk.MEDIUM) & (F.col("risk_class") != "HIGH")).alias("damped"))
    return out.withColumn("slot", F.coalesce("slot", F.lit("all")))


#: Bands in tenths of a unit, twenty times as wide above on the first three days of a month, as surges make them.
SURGED = f"(SELECT * REPLACE (10 * q10 AS q10, 10 * q50 AS q50, CASE WHEN day(date) <= 3 THEN 10 * q50 + 200 * (q90 - q50) ELSE 10 * q90 END AS q90) FROM {SLOTTED})"


@query("high_risk_filter", f"WITH {BAND.replace(SLOTTED, SURGED)} SELECT lane, date, slot, risk_score FROM k WHERE risk_class = 'HIGH'")
def high_risk_filter(spark, sf):
    """Demands of the highest class, with the bands of surge days widened."""
    b = slotted(spark, sf)
    wide = F.when(F.dayofmonth("date") <= 3, 10 * F.col("q50") + 200 * (F.col("q90") - F.col("q50"))).otherwise(10 * F.col("q90"))
    return bands(spark, sf, b.withColumns({"q10": 10 * F.col("q10"), "q50": 10 * F.col("q50"), "q90": wide})).where("risk_class = 'HIGH'").select("lane", "date", "slot", "risk_score")


IDS = "format('D{:05d}', row_number() OVER (ORDER BY date, slot, lane))"


@query("demand_ids", f"SELECT lane, date, slot, {IDS} AS demand_id FROM {SLOTTED}")
def demand_ids(spark, sf):
    return scores.ids_in_order(slotted(spark, sf)).select("lane", "date", "slot", "demand_id")


@query("forecast_table", f"WITH {BAND} SELECT {IDS} AS demand_id, strftime(date, '%d.%m.%Y') AS day, slot, source, dest, CAST(round_even(CAST(round(q50, 10) AS DECIMAL(30, 10)), 2) AS DOUBLE) AS q50, CAST(round_even(CAST(round(recommended, 10) AS DECIMAL(30, 10)), 2) AS DOUBLE) AS recommended, risk_class FROM k")
def forecast_table(spark, sf):
    """The hand-over table with dates as day.month.year."""
    d = scores.ids_in_order(bands(spark, sf))
    return d.select("demand_id", F.date_format("date", "dd.MM.yyyy").alias("day"), "slot", "source", "dest", risk.r4(F.col("q50"), 2).alias("q50"), risk.r4(F.col("recommended"), 2).alias("recommended"), "risk_class")


def payloads(spark, sf):
    """A folder of payloads written from the forecasts, a document for each date and slot."""
    path = files.folder(spark, "payloads")
    d = bands(spark, sf).withColumn("demand_id", F.concat_ws("|", "lane", F.col("date").cast("string"), "slot"))
    files.write_payloads(d.select("date", "slot", "demand_id", "lane", "q10", "q50", "q90", "recommended", "risk_class"), path)
    return files.published(spark, path, files.PAYLOAD)


@query("write_payload", f"WITH {BAND} SELECT date, count(*) AS n, count(*) FILTER (risk_class = 'HIGH') AS high FROM k GROUP BY date")
def write_payload(spark, sf):
    """What the documents say about themselves: demands and those of the highest class."""
    high = F.coalesce(F.col("risk_summary")["HIGH"], F.lit(0))
    d = payloads(spark, sf).groupBy(F.to_date("metadata.date").alias("date"))
    return d.agg(F.sum("metadata.demands").alias("n"), F.sum(high).alias("high"))


@query("read_payload", f"WITH {BAND} SELECT date, lane, slot, coalesce(recommended, q50) AS volume FROM k")
def read_payload(spark, sf):
    """The demands of all documents again, with what stands for a missing recommendation."""
    return files.payload_rows(payloads(spark, sf)).select("date", "lane", "slot", F.col("recommended").alias("volume"))
