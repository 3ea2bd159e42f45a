"""Formulas and operators on small literal tables."""

import datetime as dt
import itertools
import math

import pytest
from pyspark.sql import functions as F

from hubflow.adapters import VEHICLES
from hubflow.functions import risk
from hubflow.functions import timecost as T
from hubflow.operators import features, grid, network
from hubflow.plans.dates import split_at_midnight
from hubflow.sources import readers


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


@pytest.mark.parametrize("volume, n", [(5600.0, 1), (5600 + 1e-10, 1), (5600 + 1e-9, 1), (5600 - 1e-10, 1), (5600.5, 2), (sum([0.0068] * round(5600 / 0.0068)), 1)])
def test_vehicle_count(spark, volume, n):
    assert one(spark, n=T.vehicle_count(F.lit(volume), F.lit(5600.0))).n == n


@pytest.mark.parametrize("minutes, hours", [(-60, 0), (0, 0), (1, 1), (59, 1), (120, 2), (121, 3), (23 * 60 + 59, 24)])
def test_lateness(spark, minutes, hours):
    deadline = dt.datetime(2026, 7, 1, 12)
    r = one(spark, h=T.late_hours(F.lit(deadline + dt.timedelta(minutes=minutes)), F.lit(deadline)))
    assert r.h == hours
    assert one(spark, p=T.sla_penalty(F.lit(10000.0), F.lit(hours))).p == pytest.approx(10000 * hours * 0.4)


@pytest.mark.parametrize("volume, best", [(100, "Kamyonet"), (5600, "Kamyonet"), (6000, "Kamyon"), (10000, "Kamyon"), (15000, "Tır")])
def test_cheapest_vehicle(spark, volume, best):
    hours = dict(zip((v[0] for v in VEHICLES), (0.92, 0.86, 0.80, 0.75), strict=True))
    rows = [(1, v, float(volume), c, h, k, hours[v], 60.0) for v, c, h, k, _ in VEHICLES]
    df = spark.createDataFrame(rows, "id int, vehicle_type string, volume double, capacity double, spot_hourly double, spot_km double, hours double, distance_km double")
    assert network.rank_vehicle_types(df, ["id"]).where("rank = 1").first().vehicle_type == best
    lanes = df.select(F.lit("A").alias("source"), F.lit("B").alias("destination"), "vehicle_type", "capacity", "spot_hourly", "spot_km", "hours", "distance_km")
    d = network.types_of_lanes(lanes).withColumn("volume", F.lit(float(volume)))
    assert d.select(network.cheapest_type("types", "volume").alias("t")).first().t.vehicle_type == best


def test_plan_without_empty_trips(spark):
    df = spark.createDataFrame([("D1", 1.0), (" ", 2.0), ("", 3.0), (None, 4.0)], "demand_id string, volume double")
    assert [r.demand_id for r in readers.plan_of_demands(df, ["demand_id", "volume"]).collect()] == ["D1"]
    with pytest.raises(ValueError):
        readers.plan_of_demands(df, ["day"])


def test_handling_and_travel(spark):
    r = one(spark, once=T.handling_minutes(F.lit(10000.0)), twice=T.handling_minutes(F.lit(10000.0), True), travel=T.travel_minutes(F.lit(0.92)))
    assert (r.once, r.twice, r.travel) == (100, 200, 56)


def test_midnight(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 7, 4, 23, 30), 100, 10000.0)], "at timestamp, minutes int, volume double")
    assert [(str(r.day), r.share) for r in split_at_midnight(df, "at", "minutes", "volume").orderBy("day").collect()] == [("2026-07-04", 3000.0), ("2026-07-05", 7000.0)]


@pytest.mark.parametrize("total, left, least", [(50.0, 15, 0.05), (2000.0, 15, 0.10), (2000.0, 2, 0.05), (2000.0, 0, 0.0)])
def test_least_occupancy(spark, total, left, least):
    assert one(spark, x=T.min_occupancy(F.lit(total), F.lit(1000.0), F.lit(left))).x == pytest.approx(least)


def test_streaks(spark):
    flags, weights = [0, 1, 1, 0, 0, 1, 0], [5, 3, 8, 1, 9, 2, 4]
    rows = [("a", dt.date(2026, 1, 1 + i), f, float(w)) for i, (f, w) in enumerate(zip(flags, weights, strict=True))]
    df = spark.createDataFrame(rows[::-1], "lane string, date date, flag int, w double").repartition(3)
    got = features.streak_backlog(df, "flag", "w").orderBy("date").collect()
    assert [r.accumulated for r in got] == [0, 0, 0, 11, 11, 0, 2]
    assert [r.days_since for r in got] == [1, -1, -1, 1, 2, -1, 1]


def test_ema_against_a_loop(spark):
    values = [3.0, None, 7.0, 1.0, 4.0]
    df = spark.createDataFrame([("a", dt.date(2026, 1, 1 + i), v) for i, v in enumerate(values)], "lane string, date date, x double")
    got = [r.ema for r in features.ema_momentum(df, "x").orderBy("date").collect()]
    top = bottom = 0.0
    for v, g in zip(values, got, strict=True):
        assert g is None if not bottom else g == pytest.approx(top / bottom)
        if v is not None:
            top, bottom = top * 0.5 + v, bottom * 0.5 + 1


def test_pieces_fill_vehicles_in_turn(spark):
    volumes = [120.0, 30.0, 250.0, 100.0, 0.5, 99.5, 400.0]
    df = spark.createDataFrame([(1, i, v, 100.0) for i, v in enumerate(volumes)], "g int, i int, volume double, capacity double")
    got = {(r.i, r.vehicle): r.share for r in network.split_over_vehicles(df, ["g"], ["i"]).collect()}
    expected, vehicle, room = {}, 0, 100.0
    for i, v in enumerate(volumes):
        while v > 1e-9:
            part = min(v, room)
            expected[i, vehicle] = part
            v, room = v - part, room - part
            if room <= 1e-9:
                vehicle, room = vehicle + 1, 100.0
    assert got == pytest.approx(expected)


def test_dense_grid(spark):
    log = spark.createDataFrame([("A", "B", dt.date(2026, 1, 1), "09:00", 2.0), ("B", "A", dt.date(2026, 1, 5), "17:00", 3.0), ("A", "B", dt.date(2026, 1, 1), "09:00", 1.0)], "source string, dest string, date date, slot string, volume double")
    rows = grid.dense_lane_days(log).collect()
    assert len(rows) == 2 * 5
    assert sum(r.volume_0900 for r in rows) == sum(r.volume_1700 for r in rows) == 3.0


def test_relays_against_a_loop(spark):
    hubs = "ABCDE"
    km = {(a, b): 10 + 7 * ((ord(a) * 5 + ord(b) * 3) % 11) for a, b in itertools.permutations(hubs, 2)}
    df = spark.createDataFrame([(a, b, float(d)) for (a, b), d in km.items()], "source string, destination string, distance_km double")
    got = {}
    for r in network.relay_candidates(df).where("relays = 1").collect():
        got.setdefault((r.source, r.destination), []).append((r.km, r.path[1]))
    for (a, b), d in km.items():
        ways = sorted((km[a, r] + km[r, b], r) for r in hubs if r not in (a, b) and km[a, r] + km[r, b] <= 1.35 * d)[:4]
        assert sorted(got.get((a, b), [])) == ways


def test_risk_classes(spark):
    r = one(spark, a=risk.risk_class(F.lit(0.3499)), b=risk.risk_class(F.lit(0.35)), c=risk.risk_class(F.lit(0.82)), d=risk.risk_class(F.lit(0.8201)), m=risk.maape_scale(F.lit(1.0), F.lit(1.0)))
    assert (r.a, r.b, r.c, r.d) == ("LOW", "MEDIUM", "MEDIUM", "HIGH") and r.m == pytest.approx(0.5)
    assert one(spark, x=risk.dynamic_tau(F.lit(0.0))).x > 0.9 > 0.55 > one(spark, x=risk.dynamic_tau(F.lit(1e6))).x
    assert one(spark, x=risk.volume_damping(F.lit(150.0), k=math.log(3))).x == pytest.approx(0.5)


def test_headers_and_labels(spark):
    df = spark.createDataFrame([(1, 2)], ["ÇIKIŞ  tm ", "x"])
    assert readers.rename_standard(df, {"çıkış TM": "source"}).columns == ["source", "x"]
    with pytest.raises(ValueError):
        readers.rename_standard(df, {"y": "z"})
    labels = spark.createDataFrame([("A → B",), ("A->B",), (" A => B -> C ",)], "label string")
    source, dest = readers.split_lane("label")
    assert [tuple(r) for r in labels.select(source, dest).collect()] == [("A", "B"), ("A", "B"), ("A", "B -> C")]
    source, dest = readers.split_lane("label", lenient=True)
    assert tuple(spark.createDataFrame([("alone",)], "label string").select(source, dest).first()) == ("alone", "unknown")


def test_no_python_in_plans(spark, sf_dir):
    """The library's own operators stay inside the JVM, and no window holds a whole fact table."""
    import __spark_entry__ as entry

    for name in ("rolling", "holiday_backlog", "hub_pressure", "plan_fact", "risk_score"):
        plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
        assert "SinglePartition" not in plan.split("Window")[0] or name == "holiday_backlog"
