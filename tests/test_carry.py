"""Deferral from slot to slot against plain loops."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from hubflow.operators import carry

SLOTS = ("09:00", "17:00")
DEMANDS = "source string, destination string, day date, slot string, volume double"


def slot_times(rows):
    days = sorted({r[2] for r in rows})
    return [(d, s) for d in days for s in SLOTS]


def began(day, slot):
    return datetime.datetime.combine(day, datetime.time(int(slot[:2])))


def loop(rows, stock, capacity):
    """deferral, vehicles and first-come-first-served targets, slot by slot."""
    out, times = {}, slot_times(rows)
    for lane in {r[:2] for r in rows}:
        queue = []
        for k, (day, slot) in enumerate(times):
            inbound = sum(v for _, v in queue)
            demand = sum(max(0, r[4]) for r in rows if r[:2] == lane and r[2:4] == (day, slot))
            rented = stock.get(lane, 0) * capacity if slot == SLOTS[0] else 0
            moved = inbound + demand if k == len(times) - 1 else min(inbound + demand, rented + capacity)
            queue.append([(day, slot), demand])
            out[(*lane, day, slot)] = here = {"demand": demand, "inbound": inbound, "moved": moved, "deferred": inbound + demand - moved, "on_time": 0, "targets": []}
            left = moved
            for q in queue:
                part = min(left, q[1])
                q[1] -= part
                left -= part
                if part:
                    if q[0] == (day, slot):
                        here["on_time"] = part
                    else:
                        out[(*lane, *q[0])]["targets"].append(began(day, slot))
            queue = [q for q in queue if q[1]]
    return out


def random_demands(seed):
    rng = random.Random(seed)
    days = [datetime.date(2024, 2, 26) + datetime.timedelta(d) for d in (0, 1, 2, 5, 6, 9)]
    lanes = [("A", "B"), ("A", "C"), ("B", "A")]
    return [(*rng.choice(lanes), rng.choice(days), rng.choice(SLOTS), float(rng.choice((-5, 0, 1, 40, 100, 100, 250, 700)))) for _ in range(rng.choice((1, 12, 40)))]


@pytest.mark.parametrize("seed", range(6))
def test_deferral_and_targets_equal_a_loop(spark, seed):
    rows, stock = random_demands(seed), {("A", "B"): 2}
    rentals = spark.createDataFrame([("A", "B", 2), ("X", "Y", 1)], "source string, destination string, vehicle_count int")
    plan = carry.weekly_plan(spark.createDataFrame(rows, DEMANDS).repartition(3), rentals, 100.0, SLOTS).cache()
    expected = loop(rows, stock, 100)
    got = {(r.source, r.destination, r.day, r.slot): r for r in plan.collect()}
    assert got.keys() == expected.keys()
    for key, e in expected.items():
        r = got[key]
        assert (r.demand, r.inbound, r.moved, r.deferred) == (e["demand"], e["inbound"], e["moved"], e["deferred"]), key
        assert r.rental_load + r.spot_load == e["moved"] and r.rental_vehicles <= r.stock
    assert not carry.broken_rules(plan, 100.0).where("rule != 'low_load'").count()
    seen = {(r.source, r.destination, r.day, r.slot): r for r in carry.waiting(plan).collect()}
    assert seen.keys() == {k for k, e in expected.items() if e["demand"] or e["moved"]}
    for key, r in seen.items():
        e = expected[key]
        late = e["demand"] - e["on_time"]
        assert (r.on_time, r.deferred, r.inbound) == (e["on_time"], late, e["moved"] - e["on_time"])
        assert (r.first_target, r.last_target) == ((e["targets"][0], e["targets"][-1]) if late else (None, None)), key
        assert (r.cancelled, r.partial) == (e["demand"] > 0 and late > 0 and not e["on_time"], late > 0 and e["on_time"] > 0)


def test_each_rule_is_found(spark):
    day = datetime.date(2024, 1, 1)
    columns = "source string, destination string, day date, slot string, began long, demand double, deferred double, stock int, rental_vehicles int, rental_load double, spot_vehicles int, spot_load double"
    rows = [
        ("A", "B", day, "09:00", 1, 100.0, 20.0, 1, 1, 70.0, 0, 0.0),
        ("A", "B", day, "17:00", 2, 5.0, 0.0, 1, 1, 0.0, 1, 25.0),
        ("A", "C", day, "09:00", 1, 300.0, 0.0, 0, 0, 0.0, 2, 300.0),
        ("A", "C", day, "17:00", 2, 9.0, 4.0, 0, 0, 0.0, 1, 5.0),
        ("A", "D", day, "09:00", 1, 9.0, 0.0, 0, 0, 0.0, 1, 9.0),
        ("A", "D", day, "17:00", 2, 0.0, 0.0, 0, 0, 0.0, 0, 0.0),
    ]
    got = sorted((r.destination, r.slot, r.rule, r.amount) for r in carry.broken_rules(spark.createDataFrame(rows, columns), 100.0).collect())
    assert got == [("B", "09:00", "balance", 10.0), ("B", "09:00", "rental_stock", 1.0), ("B", "17:00", "rental_stock", 1.0), ("C", "09:00", "load", 100.0), ("C", "17:00", "left_at_end", 4.0), ("D", "09:00", "low_load", 9.0)]


def test_empty_demands(spark):
    rentals = spark.createDataFrame([], "source string, destination string, vehicle_count int")
    plan = carry.weekly_plan(spark.createDataFrame([], DEMANDS), rentals, 100.0, SLOTS)
    assert carry.waiting(plan).count() == 0 and carry.broken_rules(plan, 100.0).count() == 0


def test_lanes_are_dealt_once(spark):
    """Behind the exchange by lane no other one moves rows of lanes, and no window is without a partition."""
    rentals = spark.createDataFrame([], "source string, destination string, vehicle_count int")
    df = carry.deferral(carry.slot_grid(spark.createDataFrame(random_demands(1), DEMANDS), SLOTS), F.lit(100.0), carry.LANE)
    plan = df._jdf.queryExecution().executedPlan().toString()
    top = plan[: plan.index("Union")]
    assert top.count("Exchange hashpartitioning") == 1 and "SinglePartition" not in top
    rentals.unpersist()
