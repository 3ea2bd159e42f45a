"""Plans of several legs against plain loops and literal cases."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from hubflow.operators import runs
from hubflow.plans import routes

DAY = datetime.date(2024, 5, 1)
LANES = "source string, destination string, target_days double, path array<string>, milk_run boolean"
ROUTES = [
    ("A", "D", 1.0, ["A", "B", "C", "D"], False),
    ("A", "C", 1.0, ["A", "B", "C"], False),
    ("B", "D", 2.0, ["B", "C", "D"], True),
    ("B", "C", 1.0, ["B", "C"], False),
    ("C", "D", 1.0, ["C", "D"], False),
    ("D", "A", 1.0, ["D", "C", "A"], False),
]
TYPES = [("Big", 100.0, 10.0, 2.0), ("Small", 30.0, 6.0, 1.5)]


@pytest.fixture(scope="module")
def lane_vehicle(spark):
    rng = random.Random(5)
    rows = [(a, b, t, c, h, round(rng.uniform(0.3, 9), 2), k, float(rng.randint(20, 500))) for a in "ABCD" for b in "ABCD" if a != b for t, c, h, k in TYPES]
    return spark.createDataFrame(rows, "source string, destination string, vehicle_type string, capacity double, spot_hourly double, hours double, spot_km double, distance_km double")


def planned(spark, lane_vehicle, seed):
    rng = random.Random(seed)
    rows = [(f"D{i:03d}", *rng.choice(ROUTES)[:2], DAY + datetime.timedelta(rng.randint(0, 2)), rng.choice(("09:00", "17:00")), float(rng.randint(1, 260))) for i in range(60)]
    demands = spark.createDataFrame(rows, "demand_id string, source string, destination string, day date, slot string, volume double")
    stock = spark.createDataFrame([("B", "C", 1)], "source string, destination string, vehicle_count int")
    loads = runs.dispatched(demands, runs.lane_runs(spark.createDataFrame(ROUTES, LANES), lane_vehicle), stock, "Big")
    return {r[0]: r for r in rows}, loads


@pytest.mark.parametrize("seed", range(3))
def test_times_equal_a_recursion(spark, lane_vehicle, seed):
    demands, loads = planned(spark, lane_vehicle, seed)
    rows = runs.timed(runs.loaded(loads)).collect()
    vehicles, of_load = {}, {}
    for r in rows:
        vehicles.setdefault(tuple(r[c] for c in runs.VEHICLE), []).append(r)
        of_load.setdefault((r.demand_id, r.is_rental, r.run), set()).add(tuple(r[c] for c in runs.VEHICLE))
    hours = {(r.source, r.destination, r.vehicle_type): r.hours for r in lane_vehicle.collect()}
    minutes = lambda v, n=1: math.ceil(round(v * 0.01 * n, 9))
    known = {}

    def times(key):
        if key not in known:
            aboard = vehicles[key]
            assert sum(r.share for r in aboard) == pytest.approx(aboard[0].load) and aboard[0].load <= aboard[0].capacity + 1e-9
            slot = datetime.datetime.combine(aboard[0].day, datetime.time(int(aboard[0].slot[:2])), datetime.UTC).timestamp()
            ready = [slot + 60 * minutes(aboard[0].load)]
            for r in aboard:
                if r.run:
                    ready.append(max(times(k)[1] for k in of_load[r.demand_id, r.is_rental, r.run - 1]) + 60 * minutes(r.share, 2))
            hubs = aboard[0].trip.split(">")
            travel = sum(math.ceil(round(hours[a, b, aboard[0].vehicle_type] * 60, 9)) for a, b in zip(hubs, hubs[1:]))
            known[key] = max(ready), max(ready) + 60 * travel
        return known[key]

    assert all((r.departs, r.arrives) == times(tuple(r[c] for c in runs.VEHICLE)) for r in rows)
    for (demand, _, _), keys in of_load.items():
        assert keys and demand in demands
    moved = {}
    for r in rows:
        moved[r.demand_id, r.run] = moved.get((r.demand_id, r.run), 0) + r.share
    assert all(v == pytest.approx(demands[d][5]) for (d, _), v in moved.items())
    rented = [r for r in rows if r.is_rental]
    assert rented and all((r.trip, r.slot, r.vehicle_type) == ("B>C", "09:00", "Big") and r.vehicle == 0 for r in rented)


def test_legs_cost_and_follow_each_other(spark, lane_vehicle):
    _, loads = planned(spark, lane_vehicle, 9)
    rows = runs.by_leg(runs.timed(runs.loaded(loads))).collect()
    rate = {(r.source, r.destination, r.vehicle_type): r for r in lane_vehicle.collect()}
    chains = {}
    for r in rows:
        v = rate[r["from"], r["to"], r.vehicle_type]
        driving = 0 if r.is_rental else round(v.spot_hourly * v.hours + v.spot_km * v.distance_km)
        handling = round((int(r.leg_departs == r.departs) + int(r.leg_arrives == r.arrives)) * math.ceil(round(r.load * 0.01, 9)) / 60 * v.spot_hourly)
        assert abs(r.leg_cost - driving - handling) <= 1  # Python's and Spark's halves
        chains.setdefault((r.demand_id, r.is_rental, r.vehicle if r.milk_run else 0), []).append(r)
    route = {(s, d): p for s, d, _, p, _ in ROUTES}
    for chain in chains.values():
        chain.sort(key=lambda r: r.leg)
        hops = list(dict.fromkeys((r["from"], r["to"]) for r in chain))
        path = route[chain[0].source, chain[0].destination]
        assert hops == list(zip(path, path[1:]))
        assert [r.is_last for r in chain] == [r.leg == len(path) - 1 for r in chain]
        for a, b in zip(chain, chain[1:]):
            assert b.leg_departs >= a.leg_departs


LEG = "code string, from string, to string, leg_departs long, leg_arrives long"


def at(day, hour):
    return int(datetime.datetime(2024, 5, day, hour, tzinfo=datetime.UTC).timestamp())


@pytest.mark.parametrize(
    "trips, expected",
    [
        ([("V1", "A", "B", at(1, 9), at(1, 12)), ("V2", "C", "D", at(1, 9), at(1, 12))], {("A", 1): 1, ("B", 1): 1, ("C", 1): 1, ("D", 1): 1}),
        ([("V1", "A", "B", at(1, 9), at(1, 12)), ("V1", "A", "B", at(1, 9), at(1, 12))], {("A", 1): 1, ("B", 1): 1}),
        ([("V1", "A", "B", at(1, 9), at(1, 12)), ("V1", "B", "C", at(1, 12), at(1, 20))], {("A", 1): 1, ("B", 1): 1, ("C", 1): 1}),
        ([("V1", "A", "B", at(1, 9), at(1, 12)), ("V1", "B", "C", at(3, 9), at(4, 1))], {("A", 1): 1, ("B", 1): 1, ("C", 4): 1}),
        ([("V1", "A", "B", at(1, 9), at(1, 12)), ("V1", "C", "D", at(2, 9), at(2, 12))], {("A", 1): 1, ("B", 1): 1, ("C", 2): 1, ("D", 2): 1}),
        ([("V1", "A", "B", at(1, 9), at(1, 12)), ("V2", "B", "A", at(1, 17), at(2, 1))], {("A", 1): 1, ("B", 1): 2, ("A", 2): 1}),
        ([], {}),
    ],
)
def test_uses_of_hubs_by_unique_vehicle(spark, trips, expected):
    got = runs.hub_uses(spark.createDataFrame(trips, LEG), "code").collect()
    assert {(r.hub, r.day.day): r.uses for r in got} == expected


def test_trucks_of_two_lanes_that_share_a_number_are_two(spark):
    """The first truck of two lanes and days: neither continues the other's trip, and both count."""
    rows = [("A>B", DAY, "09:00", "Tır", False, 0, 0), ("B>C", DAY, "17:00", "Tır", False, 0, 0), ("A>B", DAY + datetime.timedelta(1), "09:00", "Tır", False, 0, 0)]
    vehicles = spark.createDataFrame(rows, "trip string, day date, slot string, vehicle_type string, is_rental boolean, run int, vehicle int")
    codes = runs.vehicle_codes(vehicles, ["slot", "trip", "vehicle_type", "is_rental", "run", "vehicle"])
    got = sorted((r.code, r.trip, r.day) for r in codes.collect())
    assert got == [("V0001", "A>B", DAY), ("V0002", "B>C", DAY), ("V0003", "A>B", DAY + datetime.timedelta(1))]
    departs = F.unix_timestamp("day") + F.when(F.col("slot") == "09:00", 9).otherwise(17) * 3600
    legs = codes.withColumns({"from": F.substring("trip", 1, 1), "to": F.substring("trip", 3, 1), "leg_departs": departs, "leg_arrives": departs + 3600})
    uses = {(r.hub, r.day): r.uses for r in runs.hub_uses(legs, "code").collect()}
    assert uses["B", DAY] == 2


@pytest.mark.parametrize("after, hours", [(-60, 0), (0, 0), (1, 1), (59, 1), (120, 2), (121, 3), (1439, 24)])
def test_lateness_counts_begun_hours_to_the_end_of_unloading(spark, after, hours):
    """A demand of 2026-06-30 12:00 with one day; 10 000 units take 100 minutes to unload."""
    deadline = int(datetime.datetime(2026, 7, 1, 12, tzinfo=datetime.UTC).timestamp())
    row = spark.createDataFrame([(datetime.date(2026, 6, 30), "12:00", 1.0, 10000.0, deadline + 60 * (after - 100))], "asked_day date, asked_slot string, target_days double, share double, arrives long")
    assert row.select(runs.late_penalty(F.col("arrives"), "share")).first()[0] == 10000 * hours * 0.4


def test_states_of_reported_penalties(spark):
    lanes = spark.createDataFrame([("A", "B", 1.0)], "source string, destination string, target_days double")
    late = int(datetime.datetime(2024, 5, 2, 10, tzinfo=datetime.UTC).timestamp())
    columns = "source string, destination string, asked_day date, asked_slot string, share double, leg_arrives long, is_last boolean, reported double"
    rows = [
        ("A", "B", DAY, "09:00", 100.0, late, True, 80.0),
        ("A", "B", DAY, "09:00", 100.0, late, True, 80.02),
        ("A", "B", DAY, "09:00", 100.0, late, True, 80.03),
        ("A", "B", DAY, "09:00", 100.0, late, False, 0.0),
        ("A", "B", DAY, "09:00", 100.0, late, False, 1.0),
        ("A", "Z", DAY, "09:00", 100.0, late, True, 80.0),
    ]
    got = routes.sla_states(spark.createDataFrame(rows, columns), lanes).select("expected", "reported", "status").collect()
    assert sorted((r.reported, r.status, r.expected) for r in got) == [(0.0, "OK", 0.0), (1.0, "INTERMEDIATE", 0.0), (80.0, "NO LANE", None), (80.0, "OK", 80.0), (80.02, "OK", 80.0), (80.03, "MISMATCH", 80.0)]


def test_terms_add_up_by_day_and_in_all(spark):
    rng = random.Random(1)
    rows = [(DAY + datetime.timedelta(rng.randint(0, 3)), rng.choice([*routes.TERMS, "relayed", "milk_runs", "consolidated"]), float(rng.randint(0, 1000)) / 4) for _ in range(300)]
    got = {r.day: r for r in routes.cost_report(spark.createDataFrame(rows, "day date, term string, amount double")).collect()}
    for day in {r[0] for r in rows} | {None}:
        here = [r for r in rows if day is None or r[0] == day]
        assert all(got[day][t] == round(sum(a for _, k, a in here if k == t), 2) for t in routes.TERMS)
        assert got[day].objective == pytest.approx(sum(got[day][t] for t in routes.TERMS))
        assert got[day].relayed == sum(k == "relayed" for _, k, _ in here)
