"""The fitted forecaster on planted series: what it learns, what it may not see, and that corrections are just the chain."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from hubflow.operators import calendar, forecast, forecaster, quantiles

START = datetime.date(2023, 9, 4)
DAYS = 140
COLUMNS = "lane string, source string, dest string, date date, a double, b double"


def volumes(lane, i):
    """A weekly wave, and after each Sunday a Monday of piled-up volume; b is three times a."""
    day = START + datetime.timedelta(i)
    a = 100 + 40 * lane + 20 * math.sin(2 * math.pi * i / 7) + (i * 7919 + lane * 31) % 13
    a = 0.2 * a if day.weekday() == 6 else a * (1.8 if day.weekday() == 0 and i % 2 else 1.0)
    return a, 3 * a


@pytest.fixture(scope="module")
def history(spark):
    rows = [(f"L{n}", f"S{n}", f"D{n}", START + datetime.timedelta(i), *volumes(n, i)) for n in range(4) for i in range(DAYS)]
    return spark.createDataFrame(rows, COLUMNS).repartition(4).cache()


@pytest.fixture(scope="module")
def tables(spark):
    return calendar.holiday_days(spark, 2023, 2025), calendar.campaign_days(spark, 2023, 2025)


@pytest.fixture(scope="module")
def both(history, tables):
    first = forecaster.fit(history.drop("b"), "a", *tables, rounds=8, depth=3)
    second = forecaster.fit(history.withColumnRenamed("a", forecaster.SAME_DAY), "b", *tables, rounds=12, depth=3, sunday=0.55)
    return first, second


def rows_of(df):
    return {(r.lane, r.date): r for r in df.collect()}


def test_days_of_both_slots_and_the_first_feeds_the_second(history, both):
    first, second = both
    got = forecaster.cascade({"09:00": first, "17:00": second}, history, 2).cache()
    assert got.count() == 4 * 2 * 2 and got.where("q10 > q50 or q50 > q90 or q10 < 0").count() == 0
    assert sorted({r.date for r in got.collect()}) == [START + datetime.timedelta(DAYS + h) for h in range(2)]
    alone = rows_of(forecaster.predict_sequential(first, history.drop("b"), 2))
    assert all(alone[r.lane, r.date].q50 == r.q50 for r in got.where("slot = '09:00'").collect())
    end = START + datetime.timedelta(DAYS)
    context = history.withColumnRenamed("a", forecaster.SAME_DAY)
    frame = context.where(F.col("date") == START).select("lane", "source", "dest", F.lit(end).alias("date"))
    morning = {r.lane: r.q50 for r in got.where("slot = '09:00'").collect() if r.date == end}
    told = [rows_of(forecaster.predict_batch(second, context, frame.withColumn(forecaster.SAME_DAY, F.element_at(F.create_map(*(x for k, v in morning.items() for x in (F.lit(k), F.lit(v * by)))), F.col("lane"))))) for by in (1.0, 0.3)]
    seen = {(r.lane, r.date): r for r in got.where("slot = '17:00'").collect()}
    assert all(r.q50 == seen[k].q50 for k, r in told[0].items())
    assert sum(r.q50 for r in told[1].values()) < 0.9 * sum(r.q50 for r in told[0].values())


def test_the_future_reaches_no_prediction(history, both, tables):
    """Models, corrections and forecasts of the past are the same whatever comes after it."""
    first, _ = both
    end = START + datetime.timedelta(DAYS - 8)
    past = history.drop("b").where(F.col("date") <= F.lit(end))
    frame = forecaster.next_days(past, 1, 3)
    changed = frame.withColumn("a", F.lit(1e6))
    assert sorted(map(tuple, forecaster.predict_batch(first, past, frame).collect())) == sorted(map(tuple, forecaster.predict_batch(first, past, changed).select(*frame.columns, "q10", "q50", "q90", "q50_base", "surge_added", "is_surge", "rolling_mean_7").collect()))
    windows = [tuple(r) for r in forecast.walk_forward_folds(history).orderBy("fold").collect()]
    number, begins, _ = windows[1]
    other = history.drop("b").withColumn("a", F.when(F.col("date") >= F.lit(begins), F.col("a") * 3 + 50).otherwise(F.col("a")))
    again = forecaster.fit(other, "a", *tables, rounds=8, depth=3)
    one, two = (rows_of(f.residuals.where(F.col("fold") < number).select("lane", "date", F.round("q50", 6).alias("q50"))) for f in (first, again))
    assert one == two and one


def test_a_forecast_differs_from_the_bare_model_by_the_chain_alone(history, both):
    _, second = both
    context = history.withColumnRenamed("a", forecaster.SAME_DAY)
    frame = forecaster.next_days(context, 1, 7).withColumn(forecaster.SAME_DAY, F.lit(120.0))
    bare = rows_of(forecaster.add_surge(forecaster.base(second, context, frame), second.surge))
    ratios = {(r.lane, r.bucket): r.ratio for r in second.ratios.collect()}
    lanes = {r.lane: r.ratio for r in second.lane_ratios.collect()}
    eves = {r.lane: r.multiplier for r in second.multipliers.collect()}
    got = rows_of(forecaster.predict_batch(second, context, frame))
    assert ratios and len(got) == 28
    for key, r in bare.items():
        sunday, q50 = r.date.weekday() == 6, r.q50
        own = ratios.get((r.lane, r.bucket))
        x = q50 * (0.55 if sunday and own is None else 1)
        x *= eves.get(r.lane, 1.0) if r.is_campaign_eve and not r.is_surge else 1
        x *= own if own is not None else lanes.get(r.lane, 1.0)
        x = min(x, 0.55 * q50) if sunday else x
        assert got[key].q50 == pytest.approx(x, abs=1e-3)


def test_surges_are_learned_and_refused_where_they_are_few(both):
    first, _ = both
    surges = first.residuals.where("is_surge").count()
    assert surges >= forecaster.LEAST_SURGES
    assert forecaster.fit_surge(first.residuals, first.inputs, surges + 1) is None
    seen, last = first.residuals.where("fold < 4"), first.residuals.where("fold = 4").withColumn("q90", F.col("q50"))
    model = forecaster.fit_surge(seen, first.inputs, 20)
    names = model.stages[0].getInputCols()
    assert not set(names) & set(forecaster.FLAGS) and len(set(names)) == len(names)
    planted = seen.withColumn("y", F.when(F.col("is_surge"), F.col("q50") * 1.15).otherwise(F.col("y")))
    then = last.withColumn("y", F.when(F.col("is_surge"), F.col("q50") * 1.15).otherwise(F.col("y")))
    error = lambda d: d.where("is_surge").agg(F.avg(F.abs(F.col("y") - F.col("q50")))).first()[0]
    mended = forecaster.add_surge(then, forecaster.fit_surge(planted, first.inputs, 20))
    assert error(mended) < 0.5 * error(then)
    assert mended.where("not is_surge and surge_added != 0").count() == 0
    unchanged = forecaster.add_surge(last, None).agg(F.sum("surge_added"), F.count_if("is_surge")).first()
    assert tuple(unchanged) == (0.0, 0)


def test_a_saved_forecaster_predicts_the_same(spark, history, both, tmp_path):
    first, _ = both
    forecaster.save(first, f"{tmp_path}/f")
    again = forecaster.load(spark, f"{tmp_path}/f")
    past = history.drop("b")
    frame = forecaster.next_days(past, 1, 2)
    assert rows_of(forecaster.predict_batch(again, past, frame)) == rows_of(forecaster.predict_batch(first, past, frame))


def test_bands_of_the_other_folds(both):
    first, _ = both
    assert first.bands.where("low > high").count() == 0 and first.bands.count() == 2
    assert {r.fold for r in first.residuals.select("fold").distinct().collect()} == {1, 2, 3, 4}


def test_shares_below_each_quantile_lie_near_it(spark):
    """Volumes of two levels with a known spread: half of the range above the level by level."""
    rows = [(f"L{i % 5}", START + datetime.timedelta(i // 5), float(i // 5 % 2), (1 + i // 5 % 2) * (1 + (i * 7919 % 1009) / 1009)) for i in range(2000)]
    x = spark.createDataFrame(rows, "lane string, date date, level double, scaled double").withColumns({"y": F.col("scaled"), "scale_factor": F.lit(1.0), "is_weekend": F.lit(0)}).cache()
    alphas = [0.5, 0.66, 0.8]
    last = START + datetime.timedelta(399)
    got = quantiles.sweep(x, ("level",), [(1, last - datetime.timedelta(99), last)], alphas, rounds=5, depth=2, step=0.5).cache()
    assert got.count() == 500 * len(alphas)
    below = {r.alpha: r.p for r in got.groupBy("alpha").agg(F.avg((F.col("y") <= F.col("q50")).cast("double")).alias("p")).collect()}
    assert all(abs(below[a] - a) < 0.05 for a in alphas), below
    means = {(r.alpha, r.level): r.q for r in got.join(x.select("lane", "date", "level"), ["lane", "date"]).groupBy("alpha", "level").agg(F.avg("q50").alias("q")).collect()}
    assert all(means[a, 1.0] > 1.5 * means[a, 0.0] for a in alphas) and means[0.5, 1.0] < means[0.66, 1.0] < means[0.8, 1.0]
