"""Calendar tables and features."""

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hubflow.adapters import HOLIDAYS


def years(spark: SparkSession, first: int, last: int) -> DataFrame:
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias("year"))


def holiday_days(spark: SparkSession, first: int, last: int) -> DataFrame:
    """day of each fixed national holiday; movable ones are further rows of such a table."""
    days = F.array(*(F.make_date("year", F.lit(m), F.lit(d)) for m, d in HOLIDAYS))
    return years(spark, first, last).select(F.explode(days).alias("day"))


def campaign_days(spark: SparkSession, first: int, last: int) -> DataFrame:
    """day and campaign: 14 February, 11 November, the second Sunday of May, the third of June, the last Friday of November."""
    date = lambda m, d: F.make_date("year", F.lit(m), F.lit(d))
    rows = {
        "valentine": date(2, 14),
        "eleven": date(11, 11),
        "mothers": F.date_add(F.next_day(date(4, 30), "SU"), 7),
        "fathers": F.date_add(F.next_day(date(5, 31), "SU"), 14),
        "friday": F.next_day(date(11, 23), "FR"),
    }
    return years(spark, first, last).select(F.inline(F.array(*(F.struct(F.lit(k).alias("campaign"), v.alias("day")) for k, v in rows.items()))))


def time_features(days: DataFrame) -> DataFrame:
    """Year to week, Monday 0 to Sunday 6, and the month and weekday on circles."""
    turn = lambda c, n: 2 * math.pi * c / n
    m, w = F.month("date"), F.weekday("date")
    return days.withColumns({
        "year": F.year("date"), "month": m, "day": F.dayofmonth("date"), "weekday": w, "quarter": F.quarter("date"), "week": F.weekofyear("date"), "is_weekend": (w >= 5).cast("int"),
        "month_sin": F.sin(turn(m, 12)), "month_cos": F.cos(turn(m, 12)), "weekday_sin": F.sin(turn(w, 7)), "weekday_cos": F.cos(turn(w, 7)),
    })


def payday_features(days: DataFrame) -> DataFrame:
    """Flags and decays around days on which wages are paid: the 15th (public) and the turn of the month (private)."""
    d, n = F.dayofmonth("date"), F.dayofmonth(F.last_day("date"))
    turn = lambda k: 2 * math.pi * k * d / n
    public = F.when(d >= 15, F.exp(-(d - 15) / F.lit(2.2))).otherwise(F.exp(-(15 - d) / F.lit(1.2)))
    private = F.when(d <= 3, F.exp(-(3 - d) / F.lit(1.5))).otherwise(F.exp(-(n - d) / F.lit(3.0)))
    return days.withColumns({
        "is_payday": (d.between(1, 5) | d.between(15, 20)).cast("int"), "payday_sin_k1": F.sin(turn(1)), "payday_cos_k1": F.cos(turn(1)), "payday_sin_k2": F.sin(turn(2)), "payday_cos_k2": F.cos(turn(2)),
        "public_decay": public, "private_decay": private, "route_weekday": F.concat_ws("_", "lane", F.weekday("date").cast("string")),
    })


def slot_hour(slot: str | Column) -> Column:
    return F.split_part(F.col(slot) if isinstance(slot, str) else slot, F.lit(":"), F.lit(1)).cast("int")


def slot_timestamp(day: str, slot: str) -> Column:
    """The slot's full hour; its minutes don't count."""
    return F.timestamp_seconds(F.unix_date(F.col(day)) * 86400 + slot_hour(slot) * 3600)


def logical_slot(hour: Column) -> Column:
    """The slot of a time given as text: mornings 09:00, from 13 on 17:00; 09:00 where the text has no hour."""
    return F.when(F.coalesce(hour.try_cast("int"), F.lit(0)) < 13, "09:00").otherwise("17:00")


def normalize_slot(slot: str) -> Column:
    """9:0 as 09:00; other texts as they are."""
    s = F.trim(F.col(slot))
    two = lambda i: F.lpad(F.split_part(s, F.lit(":"), F.lit(i)), 2, "0")
    return F.when(s.rlike(r"^\d{1,2}:\d{1,2}$"), F.concat_ws(":", two(1), two(2))).otherwise(s)
