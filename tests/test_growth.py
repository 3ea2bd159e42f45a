"""Steps whose work follows the rows, not the volume that the rows carry nor the square of a group."""

import random

import pytest
from pyspark.sql import functions as F
from test_runs import lane_vehicle, planned  # noqa: F401, a fixture

from hubflow import adapters
from hubflow.operators import impute, network, runs
from hubflow.plans import models, routes

PIECES = "g int, i int, volume double, capacity double"


def test_a_piece_is_three_stretches_of_vehicles_whatever_its_volume(spark):
    volumes = [120.0, 30.0, 1_000_000.0, 100.0, 0.5, 99.5, 70.0, 2_000_030.0]
    df = spark.createDataFrame([(1, i, v, 100.0) for i, v in enumerate(volumes)], PIECES)
    stretches = network.stretches_of_vehicles(df, ["g"], ["i"])
    rows = stretches.collect()
    assert len(rows) <= 3 * len(volumes)
    for i, v in enumerate(volumes):
        assert sum(r.share * r.vehicles for r in rows if r.i == i) == pytest.approx(v)
    each = network.each_vehicle(stretches).groupBy("vehicle").agg(F.sum("share").alias("load")).collect()
    assert sorted(r.vehicle for r in each) == list(range(30005)) and {r.load for r in each if r.vehicle < 30004} == {100.0}


@pytest.mark.parametrize("seed", range(2))
def test_plans_of_stretches_equal_plans_of_vehicles(spark, lane_vehicle, seed):  # noqa: F811
    _, loads = planned(spark, lane_vehicle, seed)
    loads = loads.withColumn("volume", F.col("volume") * 20)
    whole, short = runs.timed(runs.loaded(loads)), runs.timed(runs.stretches(loads))
    assert short.count() <= 3 * loads.count() < whole.count()
    columns = [*runs.LOAD, *runs.VEHICLE, "share", "load", "departs", "arrives"]
    assert sorted(map(tuple, whole.select(columns).collect())) == sorted(map(tuple, network.each_vehicle(short).select(columns).collect()))
    uses = lambda d: sorted(map(tuple, runs.hub_uses(runs.by_leg(d), *runs.VEHICLE).collect()))
    assert uses(whole) == uses(short)
    cost = lambda d, n: routes.vehicle_legs(runs.by_leg(d)).agg(F.sum(F.col("cost") * n), F.sum(F.col("load") * n)).first()
    assert tuple(cost(short, F.col("vehicles"))) == pytest.approx(tuple(cost(whole.withColumn("vehicles", F.lit(1)), F.lit(1))))
    order = ["slot", "trip", "vehicle_type", "is_rental", "run", "vehicle"]
    codes = runs.vehicle_codes(whole.select(*runs.VEHICLE).distinct(), order)
    numbers = network.each_vehicle(routes.numbered(short), "number").withColumn("code", runs.code())
    keep = [*runs.VEHICLE, "code"]
    assert sorted(map(tuple, codes.select(keep).collect())) == sorted(map(tuple, numbers.select(keep).collect()))


def test_filling_backwards_is_no_frame_to_the_end_of_the_group(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 2), i, rng.choice((None, float(i)))) for i in range(300)]
    out = impute.fill_along(spark.createDataFrame(rows, "g int, i int, x double"), "x", "g", ["i"], forward=False)
    assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()
    for r in out.collect():
        assert r.x == next((x for g, i, x in rows if g == r.g and i >= r.i and x is not None), None)


@pytest.mark.parametrize("slot", models.SLOTS)
def test_a_fit_reads_days_that_are_written_once_and_not_the_log(spark, monkeypatch, slot):
    sf, seen = "/root/testdata/sf0.001", []
    monkeypatch.setattr(models, "_fitted", {})
    monkeypatch.setattr(models.forecaster, "fit", lambda days, *_, **__: seen.append((days.inputFiles(), days.columns)))
    models.fitted(spark, sf, slot)
    (files, columns), = seen
    assert files and not any("lineitem" in f for f in files) and models.SLOTS[slot][0] in columns
    days = models.lane_days(spark, sf)
    assert not any("lineitem" in f for f in days.inputFiles())
    assert sorted(map(tuple, days.collect())) == sorted(map(tuple, adapters.lane_day(spark, sf).select(days.columns).collect()))
