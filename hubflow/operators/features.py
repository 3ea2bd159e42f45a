"""Window features of dense lane-day tables (lane, date, ...). All frames look back only and run inside a lane, so one shuffle on lane serves them all."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-5


def by_lane():
    return Window.partitionBy("lane").orderBy("date")


def back(n: int, to: int = 1):
    """The n rows before, without today."""
    return by_lane().rowsBetween(-n, -to)


def lags(days: DataFrame, value: str, steps: tuple[int, ...] = (1, 7, 14)) -> DataFrame:
    return days.withColumns({f"lag_{k}": F.lag(value, k).over(by_lane()) for k in steps})


def rolling(days: DataFrame, value: str, widths: tuple[int, ...] = (7, 14)) -> DataFrame:
    """Mean, deviation (0 of one row) and their ratio over the rows before."""
    out = {}
    for w in widths:
        mean, sd = F.avg(value).over(back(w)), F.coalesce(F.stddev_samp(value).over(back(w)), F.lit(0.0))
        out |= {f"rolling_mean_{w}": mean, f"rolling_std_{w}": sd, f"rolling_cov_{w}": sd / (mean + EPS)}
    return days.withColumns(out)


def same_weekday(days: DataFrame, value: str, n: int = 4) -> DataFrame:
    """Mean and deviation of the last n rows of the same weekday."""
    w = Window.partitionBy("lane", "weekday").orderBy("date").rowsBetween(-n, -1)
    return days.withColumn("weekday", F.weekday("date")).withColumns({"weekday_mean": F.avg(value).over(w), "weekday_std": F.coalesce(F.stddev_samp(value).over(w), F.lit(0.0))})


def ema_momentum(days: DataFrame, value: str, span: int = 3, rows: int = 60) -> DataFrame:
    """Bias-adjusted exponential mean of the rows before (weights under 2 ** -60 vanish), and mean of 3 over mean of 14."""
    keep = 1 - 2 / (span + 1)
    seen = F.collect_list(value).over(back(rows))
    top = F.aggregate(seen, F.lit(0.0), lambda s, v: s * keep + v)
    weight = F.aggregate(seen, F.lit(0.0), lambda s, v: s * keep + 1.0)
    ratio = F.avg(value).over(back(3)) / (F.avg(value).over(back(14)) + EPS)
    return days.withColumns({"ema": F.try_divide(top, weight), "momentum": F.coalesce(ratio, F.lit(1.0))})


def target_scale(days: DataFrame, value: str, width: int = 14) -> DataFrame:
    """Mean of the rows before, else the last known one, else the mean of all rows, at least 1; and the value by it."""
    overall = days.agg(F.avg(value).alias("overall"))
    d = days.withColumn("mean", F.avg(value).over(back(width))).withColumn("mean", F.last("mean", True).over(by_lane())).crossJoin(F.broadcast(overall))
    return d.withColumn("scale_factor", F.greatest(F.lit(1.0), F.coalesce("mean", "overall"))).withColumn("scaled", F.col(value) / F.col("scale_factor")).drop("mean", "overall")


def streak_backlog(days: DataFrame, flag: str, weight: str | None = None, alpha: float = 1.4, most: int = 4, prefix: str = "") -> DataFrame:
    """streak, accumulated, days_since, release of runs of flag (0 or 1).

    streak: the run's weights so far (days without weight), 0 while the flag is down. accumulated: while the flag is down,
    what the run before it came to. days_since: days since the flag went down, -1 while it is up. release:
    accumulated * exp(-days_since / alpha) for at most so many days, else 0. Islands by running sums of changes.
    """
    w = F.coalesce(F.col(weight), F.lit(0.0)) if weight else F.lit(1.0)
    change = F.lag(flag).over(by_lane()).isNull() | (F.lag(flag).over(by_lane()) != F.col(flag))
    d = days.withColumn("_change", change.cast("int")).withColumn("_run", F.sum("_change").over(by_lane()))
    run = Window.partitionBy("lane", "_run").orderBy("date")
    d = d.withColumn("_streak", F.when(F.col(flag) == 1, F.sum(w).over(run)).otherwise(0.0))
    d = d.withColumn("_before", F.coalesce(F.lag("_streak").over(by_lane()), F.lit(0.0)))
    up = F.col(flag) == 1
    d = d.withColumns({
        f"{prefix}streak": F.col("_streak"),
        f"{prefix}accumulated": F.when(up, 0.0).otherwise(F.first("_before").over(run)),
        f"{prefix}days_since": F.when(up, -1).otherwise(F.row_number().over(run)),
    })
    since = F.col(f"{prefix}days_since")
    release = F.when((since >= 1) & (since <= most), F.col(f"{prefix}accumulated") * F.exp(-since / F.lit(alpha))).otherwise(0.0)
    return d.withColumn(f"{prefix}release", release).drop("_change", "_run", "_streak", "_before")


def holiday_backlog(days: DataFrame, holidays: DataFrame, value: str, alpha: float = 1.4, most: int = 4, lead: int = 2) -> DataFrame:
    """is_holiday, is_holiday_eve, is_closed (holiday or Sunday); backlog of closed days by the usual volume of open ones: the median of the last 28 rows with at least 7 open, and its ratio to the mean of the last 14."""
    marked = days.join(F.broadcast(holidays.select(F.col("day").alias("date"), F.lit(1).alias("is_holiday")).distinct()), "date", "left")
    eves = F.broadcast(holidays.select(F.explode(F.sequence(F.lit(1), F.lit(lead))).alias("k"), "day").select(F.expr("date_sub(day, k)").alias("date"), F.lit(1).alias("is_holiday_eve")).distinct())
    d = marked.join(eves, "date", "left").na.fill(0, ["is_holiday", "is_holiday_eve"])
    d = d.withColumn("is_closed", ((F.col("is_holiday") == 1) | (F.weekday("date") == 6)).cast("int"))
    d = d.withColumn("_open", F.when(F.col("is_closed") == 0, F.col(value)))
    usual = F.when(F.count("_open").over(back(28)) >= 7, F.percentile("_open", 0.5).over(back(28)))
    d = d.withColumns({"_usual": usual, "_base": F.avg("_open").over(back(14))})
    d = d.withColumns({"_usual": F.last("_usual", True).over(by_lane()), "_base": F.last("_base", True).over(by_lane())})
    d = streak_backlog(d, "is_closed", "_usual", alpha, most, "backlog_")
    ratio = F.coalesce(F.col("backlog_accumulated") / (F.col("_base") + EPS), F.lit(0.0))
    since = F.col("backlog_days_since")
    index = F.when((since >= 1) & (since <= most), ratio * F.exp(-since / F.lit(alpha))).otherwise(0.0)
    return d.withColumns({"backlog_severity_ratio": ratio, "backlog_release_index": index}).drop("_open", "_usual", "_base")


def campaign_backlog(days: DataFrame, campaigns: DataFrame, value: str, alpha: float = 1.4, most: int = 4, lead: int = 3) -> DataFrame:
    """is_campaign_day, is_campaign_eve, and the backlog of eves by their volume, against the mean of the last 14 rows."""
    marked = days.join(F.broadcast(campaigns.select(F.col("day").alias("date"), F.lit(1).alias("is_campaign_day")).distinct()), "date", "left")
    eves = F.broadcast(campaigns.select(F.explode(F.sequence(F.lit(1), F.lit(lead))).alias("k"), "day").select(F.expr("date_sub(day, k)").alias("date"), F.lit(1).alias("is_campaign_eve")).distinct())
    d = marked.join(eves, "date", "left").na.fill(0, ["is_campaign_day", "is_campaign_eve"])
    d = streak_backlog(d.withColumn("_base", F.avg(value).over(back(14))), "is_campaign_eve", value, alpha, most, "campaign_")
    ratio = F.coalesce(F.col("campaign_accumulated") / (F.col("_base") + EPS), F.lit(0.0))
    since = F.col("campaign_days_since")
    index = F.when((since >= 1) & (since <= most), ratio * F.exp(-since / F.lit(alpha))).otherwise(0.0)
    return d.withColumns({"campaign_severity_ratio": ratio, "campaign_release_index": index}).drop("_base")


def campaign_lags(days: DataFrame) -> DataFrame:
    """Yesterday's flag and the one before, and yesterday's crossed with the weekday as text."""
    one, two = (F.coalesce(F.lag("is_campaign_day", k).over(by_lane()), F.lit(0)) for k in (1, 2))
    word = F.concat(F.when(one == 1, "CampaignLag1_day").otherwise("NoCampaignLag1_day"), F.weekday("date").cast("string"))
    return days.withColumns({"campaign_lag_1": one, "campaign_lag_2": two, "campaign_lag_weekday": word})


def post_event_flags(days: DataFrame) -> DataFrame:
    after = lambda c: ((F.lag(c).over(by_lane()) == 1) & (F.col(c) == 0)).cast("int")
    return days.withColumns({"is_post_holiday": F.coalesce(after("is_holiday"), F.lit(0)), "is_post_campaign": F.coalesce(after("is_campaign_day"), F.lit(0))})


def organic_backlog(days: DataFrame, value: str, alpha: float = 1.4, most: int = 4, slow: float = 0.5) -> DataFrame:
    """Activity against the mean of the last 14 rows, the deficit of slow days and its backlog."""
    activity = F.lag(value, 1).over(by_lane()) / (F.avg(value).over(back(14)) + EPS)
    d = days.withColumn("activity_ratio", F.coalesce(activity, F.lit(1.0)))
    d = d.withColumn("deficit", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("activity_ratio")))).withColumn("is_slow", (F.col("activity_ratio") < slow).cast("int"))
    d = streak_backlog(d, "is_slow", "deficit", alpha, most, "organic_")
    return d


def regime_shift(days: DataFrame, value: str, release: Column) -> DataFrame:
    mean3, mean14, sd14 = F.avg(value).over(back(3)), F.avg(value).over(back(14)), F.coalesce(F.stddev_samp(value).over(back(14)), F.lit(0.0))
    impact = release * F.lag(value, 1).over(by_lane()) / (mean14 + EPS)
    return days.withColumns({"backlog_scaled_impact": F.coalesce(impact, F.lit(0.0)), "demand_acceleration": F.coalesce((mean3 - mean14) / (sd14 + EPS), F.lit(0.0))})


def lane_codes(days: DataFrame) -> DataFrame:
    """A number of each lane in order of names, and crossed with the weekday. The window runs over distinct lanes only."""
    lanes = days.select("lane").distinct().withColumn("lane_code", F.dense_rank().over(Window.orderBy("lane")) - 1)
    return days.join(F.broadcast(lanes), "lane").withColumn("lane_weekday", F.col("lane_code") * 10 + F.weekday("date"))


def censored_demand(days: DataFrame, value: str, capacity: DataFrame, least: float = 50.0, near: float = 0.98, full: float = 0.9, lift: float = 1.05) -> DataFrame:
    """Days that seem cut off by capacity, and their volume lifted.

    A candidate is over least and near the highest of the 14 rows before. Where the hub's capacity is known it counts if
    the hub's day is nearly full; elsewhere if two of the last three rows of the weekday were candidates.
    """
    d = days.withColumn("_candidate", (F.col(value) > least) & (F.col(value) >= near * F.max(value).over(back(14)))).withColumn("_weekday", F.weekday("date"))
    weekday = Window.partitionBy("lane", "_weekday").orderBy("date").rowsBetween(-3, -1)
    d = d.withColumn("_often", F.coalesce(F.sum(F.col("_candidate").cast("int")).over(weekday), F.lit(0)) >= 2)
    hub_day = days.groupBy("source", "date").agg(F.sum(value).alias("_hub"))
    d = d.join(hub_day, ["source", "date"]).join(F.broadcast(capacity.select(F.col("hub").alias("source"), F.col("capacity").alias("_capacity")).dropDuplicates(["source"])), "source", "left")
    gate = F.when(F.col("_capacity").isNotNull(), F.col("_hub") >= full * F.col("_capacity")).otherwise(F.col("_often"))
    d = d.withColumn("is_censored", F.coalesce(F.col("_candidate") & gate, F.lit(False)).cast("int"))
    return d.withColumn("unconstrained", F.when(F.col("is_censored") == 1, F.col(value) * lift).otherwise(F.col(value))).drop("_candidate", "_weekday", "_often", "_hub", "_capacity")


def extreme_events(days: DataFrame, value: str) -> DataFrame:
    """Yesterday beyond the usual range of the week before, the share of such days so far in the lane, and how restless the week is."""
    lag1, mean7, sd7 = F.lag(value, 1).over(by_lane()), F.avg(value).over(back(7)), F.coalesce(F.stddev_samp(value).over(back(7)), F.lit(0.0))
    d = days.withColumns({"is_extreme": F.coalesce((lag1 > mean7 + 2 * sd7).cast("int"), F.lit(0)), "restless": F.coalesce(sd7 / (mean7 + EPS), F.lit(0.0))})
    return d.withColumn("extreme_share", F.coalesce(F.avg("is_extreme").over(by_lane().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))


def cross_group_stats(days: DataFrame, value: str, hub: str, flag: str) -> DataFrame:
    """Highest, mean and deviation of the hub's earlier days with the same flag, from sums by day so that no hub is one task's rows."""
    x = F.col(value)
    by = days.groupBy(hub, flag, "date").agg(F.max(x).alias("_m"), F.sum(x).alias("_s"), F.sum(x * x).alias("_q"), F.count(x).alias("_n"))
    w = Window.partitionBy(hub, flag).orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    n, s, q = (F.sum(c).over(w) for c in ("_n", "_s", "_q"))
    by = by.withColumns({"group_max": F.max("_m").over(w), "group_mean": s / n, "group_std": F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), (q - s * s / n) / (n - 1)))).otherwise(F.when(n == 1, 0.0))})
    return days.join(by.drop("_m", "_s", "_q", "_n"), [hub, flag, "date"])


def regret_weights(days: DataFrame, value: str, capacity: DataFrame, over: float = 3.0, under: float = 1.0) -> DataFrame:
    """Cost of missing the lane's capacity, by the root of its mean over the 14 calendar days before, scaled to [1, 5] over all rows."""
    gap = F.col(value) - F.col("capacity")
    d = days.join(F.broadcast(capacity), "lane").withColumn("regret", F.when(gap > 0, gap * over).otherwise(-gap * under))
    calendar = Window.partitionBy("lane").orderBy(F.unix_date("date")).rangeBetween(-14, -1)
    d = d.withColumn("mean", F.avg("regret").over(calendar)).withColumn("mean", F.coalesce(F.last("mean", True).over(by_lane()), F.lit(EPS)))
    d = d.withColumn("raw", F.col("regret") / F.sqrt(F.col("mean") + 1))
    ends = d.agg(F.min("raw").alias("low"), F.max("raw").alias("high"))
    return d.crossJoin(F.broadcast(ends)).withColumn("weight", 1 + 4 * F.coalesce(F.try_divide(F.col("raw") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0))).drop("mean", "raw", "low", "high")


def context_tail(days: DataFrame, n: int) -> DataFrame:
    last = F.row_number().over(Window.partitionBy("lane").orderBy(F.col("date").desc()))
    return days.withColumn("_back", last).where(F.col("_back") <= n).drop("_back")


def edge_fill(days: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls take the last value before them in the lane, else the first one after."""
    ahead = by_lane().rowsBetween(0, Window.unboundedFollowing)
    return days.withColumns({c: F.coalesce(F.last(c, True).over(by_lane()), F.first(c, True).over(ahead)) for c in columns})
