"""Percentiles by narrowed brackets against F.percentile on the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from hubflow.operators.selection import percentiles, summarised

POINTS = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]


def same(df, keys, points=POINTS, **how):
    df = df.cache()
    got = {tuple(r[k] for k in keys): (r.n, r.p) for r in percentiles(df, keys, "x", points, **how).collect()}
    v = F.when(~F.isnan("x"), F.col("x"))
    expected = {tuple(r[k] for k in keys): (r.n, r.p) for r in df.groupBy(*keys).agg(F.count(v).alias("n"), F.percentile(v, F.array(*map(F.lit, points))).alias("p")).collect()}
    df.unpersist()
    assert got.keys() == expected.keys()
    for k, (n, p) in expected.items():
        assert got[k][0] == n
        assert (got[k][1] is None) == (p is None)
        assert p is None or got[k][1] == pytest.approx(p, rel=1e-14, abs=1e-14)
    return got


def rows(seed=7, n=6000):
    r = random.Random(seed)
    out = []
    for i in range(n):
        kind = r.choice(["even", "ties", "wide", "heavy", None])
        x = {"even": r.random(), "ties": float(r.randrange(4)), "wide": r.choice([-1, 1]) * 10.0 ** r.uniform(-300, 300), "heavy": 5.0 if r.random() < 0.7 else r.gauss(5, 1), None: float(i)}[kind]
        out.append((kind, r.choice([None, float("nan")]) if r.random() < 0.05 else x))
    return out + [("empty", None), ("empty", float("nan")), ("one", 3.5), ("infinite", float("inf")), ("infinite", float("-inf")), ("infinite", 1.0)]


@pytest.mark.parametrize("how", [{}, {"most": 5, "steps": 8}, {"most": 1, "steps": 20, "accuracy": 50}, {"most": 40, "steps": 1000}])
def test_as_percentile(spark, how):
    got = same(spark.createDataFrame(rows(), "kind string, x double"), ["kind"], **how)
    assert got[("empty",)] == (0, None) and got[("one",)] == (1, [3.5] * len(POINTS))


def test_sketch_that_misleads(spark):
    """A sketch so rough that ranks lie outside of its brackets: counts lead back."""
    same(spark.createDataFrame([(float(i * i % 7919),) for i in range(5000)], "x double").repartition(7), [], most=3, steps=200, accuracy=3)


def test_without_keys_and_empty(spark):
    same(spark.range(3001).select((F.col("id") % 977).cast("double").alias("x")), [], most=50, steps=10)
    none = spark.createDataFrame([], "k string, x double")
    assert [tuple(r) for r in percentiles(none, [], "x", [0.5]).collect()] == [(0, None)]
    assert percentiles(none, ["k"], "x", [0.5]).collect() == []


def test_two_keys_with_clashing_names(spark):
    d = spark.range(4000).select((F.col("id") % 2 == 0).alias("v"), (F.col("id") % 3).cast("int").alias("group"), F.hash("id").cast("double").alias("x"), F.lit("other").alias("rank"))
    same(d, ["v", "group"], most=20, steps=12)


def test_changed_values_are_an_error(spark):
    with pytest.raises(RuntimeError, match="changed"):
        percentiles(spark.range(5000).select((F.col("id") + F.unix_micros(F.current_timestamp())).alias("x")), [], "x", [0.5], most=10)


def test_no_task_holds_a_groups_values(spark):
    """The first pass shuffles sketches and later ones counts; only brackets of at most `most` values are sorted."""
    d = spark.range(0, 200_000, 1, 16).select(F.xxhash64("id").cast("double").alias("x"))
    same(d, [], [0.5, 0.9], most=1000, steps=100)


def test_summarised(spark):
    d = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", 5.0), ("b", None)], "k string, x double")
    got = summarised(d, ["k"], [F.count("*").alias("rows"), F.sum("x").alias("sum")], "x", [0.5], "few").collect()
    assert {tuple(r) for r in ((r.k, r.rows, r["sum"], tuple(r.p or ())) for r in got)} == {(None, 2, 3.0, (1.5,)), ("a", 1, 5.0, (5.0,)), ("b", 1, None, ())}
    assert summarised(d, [], [F.count("*").alias("rows")], "x", [0.0, 1.0], "few").collect()[0].asDict() == {"rows": 4, "p": [1.0, 5.0]}
