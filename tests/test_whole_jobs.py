"""Queries that must do the whole job: no demand, row or document is left out."""

import datetime as dt
import math
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from hubflow.adapters import VEHICLES
from hubflow.operators import forecast, quantiles
from hubflow.plans import ingest, models
from hubflow.plans import network as network_plans

LANES = [("A", "B", 500.0, 1.0), ("A", "C", 212.0, 1.0), ("C", "B", 331.0, 1.0), ("C", "D", 120.0, 1.0), ("D", "B", 192.0, 1.0), ("A", "D", 340.0, 1.0)]
#: Days of 1995 and later, so that no horizon may cut them.
DEMANDS = [("d1", "A", "B", dt.date(1995, 3, 1), 4100.0), ("d2", "A", "B", dt.date(1996, 8, 9), 23000.0), ("d3", "A", "B", dt.date(2001, 5, 2), 51000.0), ("d4", "C", "D", dt.date(1998, 1, 1), 7300.0), ("d5", "A", "D", dt.date(1995, 7, 1), 12000.0)]
PATHS = {("A", "B"): ["AB", "ACB", "ADB", "ACDB"], ("C", "D"): ["CD"], ("A", "D"): ["AD", "ACD"]}


def brute_costs():
    km = {(a, b): d for a, b, d, _ in LANES}
    out = {}
    for demand, a, b, _, volume in DEMANDS:
        for path in PATHS[a, b]:
            legs = list(zip(path, path[1:]))
            for milk in (False, True) if len(path) > 2 else (False,):
                cost = []  # of each leg by type
                for i, leg in enumerate(legs):
                    touches = (i == 0) + (i == len(legs) - 1) if milk else 2
                    minutes = math.ceil(round(volume * 0.01, 9))
                    cost.append([math.ceil(volume / c - 1e-9) * round(h * round(km[leg] / s, 2) + k * km[leg]) + round(touches * minutes / 60 * h) for _, c, h, k, s in VEHICLES])
                total = min(map(sum, zip(*cost))) if milk else sum(map(min, cost))
                out[demand, ">".join(path), milk] = (float(total), round(sum(round(km[g] / 80.0, 2) for g in legs), 4))
    return out


@pytest.fixture(scope="module")
def network_inputs(spark):
    demands = spark.createDataFrame(DEMANDS, "demand_id string, source string, destination string, day date, volume double")
    lanes = spark.createDataFrame(LANES, "source string, destination string, distance_km double, target_days double")
    options = spark.createDataFrame([(a, b, list(p), m) for (a, b), ps in PATHS.items() for p in ps for m in ((False, True) if len(p) > 2 else (False,))], "source string, destination string, path array<string>, milk_run boolean")
    types = spark.createDataFrame(VEHICLES, "vehicle_type string, capacity double, spot_hourly double, spot_km double, speed double")
    return demands, lanes, options, lanes.crossJoin(types).selectExpr("*", "round(distance_km / speed, 2) AS hours")


def query_on(inputs, monkeypatch, query):
    """Rows of a query whose tables are the fixture's."""
    demands, lanes, options, lane_vehicle = inputs
    for name, table in (("demands", demands), ("lanes", lanes), ("lane_vehicle", lane_vehicle)):
        monkeypatch.setattr(network_plans.V, name, lambda spark, sf, table=table: table)
    monkeypatch.setattr(network_plans.N, "relay_candidates", lambda lanes: None)
    monkeypatch.setattr(network_plans.N, "path_options", lambda lanes, relays: options)
    return query(None, None).collect()


def test_option_cost_of_every_demand(network_inputs, monkeypatch):
    got = {(r.demand_id, r.option, r.milk_run): (r.cost, r.hours) for r in query_on(network_inputs, monkeypatch, network_plans.option_cost)}
    assert got == brute_costs()


def test_best_option_of_every_demand(network_inputs, monkeypatch):
    volume = {d[0]: d[-1] for d in DEMANDS}
    ranked = sorted((d, c / volume[d], h, o, m, c) for (d, o, m), (c, h) in brute_costs().items())
    expected = {d: next(rows)[3:] for d, rows in groupby(ranked, key=lambda r: r[0])}
    got = {r.demand_id: (r.option, r.milk_run, r.cost) for r in query_on(network_inputs, monkeypatch, network_plans.best_option)}
    assert got == expected and len(got) == len(DEMANDS)


def test_demand_history_of_every_volume(spark, monkeypatch):
    log = [("A", "B", dt.date(1995, 3, 1), v, "09:00") for v in (0.0, 1.0, 45.0, 45.5, 50.0)] + [("B", "A", None, None, "17:00")]
    table = spark.createDataFrame(log, "source string, dest string, date date, volume double, slot string")
    monkeypatch.setattr(ingest.V, "demand_log", lambda spark, sf: table)
    got = [tuple(r) for r in ingest.load_demand_history(None, None).collect()]
    assert sorted(got, key=str) == sorted(log, key=str)


def test_fold_models_find_the_median_of_each_scale(spark):
    start = dt.date(1996, 1, 1)
    rows = [(lane, lane, "X", start + dt.timedelta(d), scale * (2.5 if d % 10 in (2, 5, 8) else 0.8), scale, 1.0) for lane, scale in (("small", 10.0), ("large", 1000.0)) for d in range(80)]
    rows = [(*r[:5], r[5], r[4] / r[5]) for r in rows]
    days = spark.createDataFrame(rows, "lane string, source string, dest string, date date, v double, scale_factor double, scaled double")
    matrix = days.withColumns({c: F.lit(0.0) for c in forecast.INPUTS}).withColumn("weekday", F.weekday("date"))
    _, out = forecast.fit_folds(matrix, "v", [(1, start + dt.timedelta(70), start + dt.timedelta(79))])
    found = {r.lane: r.q50 / r.scale_factor for r in out.groupBy("lane", "scale_factor").agg(F.avg("q50").alias("q50")).collect()}
    assert found == {"small": pytest.approx(0.8, abs=0.15), "large": pytest.approx(0.8, abs=0.15)}


def test_bands_are_in_units_of_the_scale(spark):
    rows = spark.createDataFrame([(s, s * (1 + k / 10), s, 0) for s in (10.0, 1000.0) for k in range(-10, 11)], "scale_factor double, y double, q50 double, is_weekend int")
    bands = forecast.residual_bands(rows)
    r = bands.first()
    assert (r.low, r.high) == (pytest.approx(-0.8), pytest.approx(0.8))
    got = {x.scale_factor: (x.q10, x.q90) for x in forecast.with_bands(rows, bands).collect()}
    assert got == {s: (pytest.approx(0.2 * s), pytest.approx(1.8 * s)) for s in (10.0, 1000.0)}


def test_backtests_that_leak_are_rejected(spark):
    first = dt.date(1999, 1, 1)
    days = spark.createDataFrame([("a", first + dt.timedelta(i)) for i in range(60)], "lane string, date date")
    last = first + dt.timedelta(59)
    assert forecast.leakage_guard(days, last - dt.timedelta(6), last).count() == 7
    assert forecast.leakage_guard(days, last - dt.timedelta(2), last - dt.timedelta(1)).count() == 2
    for start, end in ((last - dt.timedelta(7), last), (last, last + dt.timedelta(1))):
        with pytest.raises(ValueError):
            forecast.leakage_guard(days, start, end)
    with pytest.raises(ValueError):
        forecast.leakage_guard(days.limit(0), first, last)


class Flat:
    """In a model's place: it predicts the scale."""

    def transform(self, rows):
        return rows.withColumn("_q", F.lit(1.0))


@pytest.fixture
def flat_fits(monkeypatch):
    """Last days that fits have seen."""
    seen = []

    def fit(train, inputs, label, alphas, **how):
        seen.append(train.agg(F.max("date")).first()[0])
        return {a: (Flat(), 0.0) for a in alphas}

    monkeypatch.setattr(quantiles, "fit_quantiles", fit)
    return seen


def test_the_sweep_pools_the_windows_of_all_folds(spark, monkeypatch, flat_fits):
    start, days = dt.date(1996, 1, 1), 70
    volumes = [[(10.0 + lane) * (1 + (day - 42) // 7 if day >= 42 else 1) for day in range(days)] for lane in range(3)]
    rows = [(f"L{n}", f"S{n}", f"D{n}", start + dt.timedelta(i), v) for n, lane in enumerate(volumes) for i, v in enumerate(lane)]
    table = spark.createDataFrame(rows, "lane string, source string, dest string, date date, volume_0900 double")
    monkeypatch.setattr(models, "lane_days", lambda spark, sf: table)
    got = models.alpha_sweep_fits(spark, None).collect()
    unseen = [(lane[i], sum(lane[i - 14 : i]) / 14) for lane in volumes for i in range(days - 28, days)]
    wape = sum(abs(y - q) for y, q in unseen) / sum(y for y, _ in unseen)
    below = sum(y <= q + 1e-9 for y, q in unseen) / len(unseen)
    assert sorted(r.alpha for r in got) == models.ALPHAS
    assert all((r.n, r.wape, r.below) == (3 * 28, pytest.approx(wape, abs=1e-6), pytest.approx(below)) for r in got)
    assert sorted(flat_fits) == [start + dt.timedelta(days - 7 * k - 1) for k in (4, 3, 2, 1)]


def test_a_sweep_of_a_short_history_has_the_windows_with_days_before_them(spark, flat_fits):
    start = dt.date(1996, 1, 1)
    rows = [("a", start + dt.timedelta(i), 5.0, 1.0, 5.0, 0) for i in range(20)]
    matrix = spark.createDataFrame(rows, "lane string, date date, y double, scaled double, scale_factor double, is_weekend int")
    folds = [tuple(r) for r in forecast.walk_forward_folds(matrix).orderBy("fold").collect()]
    got = quantiles.sweep(matrix, (), folds, [0.5])
    assert sorted((r.fold, r["count"]) for r in got.groupBy("fold").count().collect()) == [(3, 7), (4, 7)]
    for few in (matrix.where(F.col("date") > F.lit(start + dt.timedelta(12))), matrix.limit(0)):
        with pytest.raises(ValueError):
            quantiles.sweep(few, (), [tuple(r) for r in forecast.walk_forward_folds(few).orderBy("fold").collect()], [0.5])
