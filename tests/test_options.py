"""Totals of options against a plain loop over a small network."""

import datetime as dt
import math

import pytest

from hubflow.adapters import VEHICLES
from hubflow.operators import options as O

KM = {("A", "B"): 500.0, ("A", "C"): 212.0, ("C", "B"): 331.0, ("C", "D"): 1920.0, ("D", "B"): 192.0, ("A", "D"): 340.0}
DAYS = {lane: 1.0 for lane in KM} | {("A", "B"): 0.5}
PATHS = {("A", "B"): ["AB", "ACB", "ADB", "ACDB"], ("C", "D"): ["CD"], ("A", "D"): ["AD", "ACD"]}
DAY = dt.date(2024, 2, 28)
DEMANDS = [
    ("d1", "A", "B", DAY, "09:00", 4100.0),
    ("d2", "A", "B", DAY, "09:00", 23000.0),
    ("d3", "A", "B", DAY, "17:00", 51000.0),
    ("d4", "C", "D", DAY, "09:00", 7300.0),
    ("d5", "A", "D", DAY, "17:00", 12000.0),
    ("d6", "A", "B", DAY, "09:00", 21800.0),
    ("d7", "A", "B", DAY + dt.timedelta(1), "09:00", 500.0),
]
STOCK = {("A", "B"): 2}


def handling(volume, n=1):
    return math.ceil(round(volume * 0.01 * n, 9))


def even(x):
    return float(round(x))


def loop():
    left = {}
    rented = {}
    for d, a, b, day, slot, volume in sorted(DEMANDS, key=lambda r: (-r[5], r[0])):
        stock = left.setdefault((a, b, day), STOCK.get((a, b), 0) * 22400.0)
        rented[d] = min(volume, stock) if slot == "09:00" else 0.0
        left[a, b, day] -= rented[d]
    out = {}
    for d, a, b, day, slot, volume in DEMANDS:
        began = dt.datetime.combine(day, dt.time(int(slot[:2])))
        for path in PATHS[a, b]:
            legs = list(zip(path, path[1:]))
            for milk in (False, True) if len(path) > 2 else (False,):
                direct = len(legs) == 1
                r = rented[d] if direct else 0.0
                spot = volume - r
                parts = [legs] if milk else [[g] for g in legs]
                cost, at, done = 0.0, began, None
                for part in parts:
                    best = []
                    for name, c, h, k, s in VEHICLES:
                        hours = [round(KM[g] / s, 2) for g in part]
                        n = math.ceil(spot / c - 1e-9)
                        x = 0.0
                        for i, g in enumerate(part):
                            touches = ((i == 0) + (i == len(part) - 1)) if milk else 2
                            x += n * even(h * hours[i] + k * KM[g]) + even(touches * handling(spot) / 60 * h)
                        best.append((x, sum(hours), name, sum(math.ceil(round(t * 60, 9)) for t in hours)))
                    x, hours, _, minutes = min(best)
                    truck = math.ceil(round(round(KM[part[0]] / VEHICLES[0][4], 2) * 60, 9))
                    if r > 1e-9:
                        minutes = max(minutes, truck) if spot > 1e-9 else truck
                    ready = at + dt.timedelta(minutes=handling(volume)) if done is None else max(at, done + dt.timedelta(minutes=handling(volume, 2)))
                    done = ready + dt.timedelta(minutes=minutes)
                    cost += x
                    arrival = at + dt.timedelta(hours=hours)
                    midnight = dt.datetime.combine(arrival.date(), dt.time())
                    at = next(t for t in (midnight + dt.timedelta(hours=h) for h in (9, 17, 33)) if t > arrival)
                if r > 1e-9:
                    cost += even(2 * handling(r) / 60 * VEHICLES[0][2])
                late = max(0, math.ceil((done + dt.timedelta(minutes=handling(volume)) - began - dt.timedelta(days=DAYS[a, b])).total_seconds() / 3600))
                out[d, ">".join(path), milk] = (cost, late, round(volume * late * 0.4, 2))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    demands = spark.createDataFrame(DEMANDS, "demand_id string, source string, destination string, day date, slot string, volume double").repartition(3)
    lanes = spark.createDataFrame([(*k, v, DAYS[k]) for k, v in KM.items()], "source string, destination string, distance_km double, target_days double")
    options = spark.createDataFrame([(a, b, list(p), m) for (a, b), ps in PATHS.items() for p in ps for m in ((False, True) if len(p) > 2 else (False,))], "source string, destination string, path array<string>, milk_run boolean")
    types = spark.createDataFrame(VEHICLES, "vehicle_type string, capacity double, spot_hourly double, spot_km double, speed double")
    rentals = spark.createDataFrame([(*k, n) for k, n in STOCK.items()], "source string, destination string, vehicle_count int")
    return demands, options, lanes.crossJoin(types).selectExpr("*", "round(distance_km / speed, 2) AS hours"), lanes, rentals, VEHICLES[0][0]


def test_totals_equal_a_loop(tables):
    got = {(r.demand_id, r.option, r.milk_run): (r.cost, r.late_hours, r.penalty) for r in O.option_totals(*tables).collect()}
    expected = loop()
    assert got == expected
    assert any(late for _, late, _ in expected.values()) and got["d6", "A>B", False][0] < got["d3", "A>B", False][0]


def test_the_best_has_the_lowest_unit_total(tables):
    volume = {r[0]: r[-1] for r in DEMANDS}
    best = {}
    for (d, o, m), (cost, _, penalty) in loop().items():
        best[d] = min(best.get(d, (math.inf,)), ((cost + penalty) / volume[d], o, m, cost, penalty))
    assert {r.demand_id: (r.option, r.milk_run, r.cost, r.penalty) for r in O.best_totals(*tables).collect()} == {d: x[1:] for d, x in best.items()}
