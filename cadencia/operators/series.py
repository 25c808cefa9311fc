"""Daily load and what follows from it, for all athletes in one pass.

Every window here is partitioned by user_id and ordered by the day's number, so that one shuffle and one sort serve all.
Days without a row are rest days: range windows over day numbers and closed forms count them as zeros without rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.load import inputs, load_detail, scores, training_load
from ..functions.stats import day_number, days, ewma, ewma_fold, so_far
from ..params import ATL_DAYS, CTL_DAYS


def score_sessions(activities: DataFrame, profiles: DataFrame) -> DataFrame:
    """Activities with load, load_source, load_confidence and load_detail. Sessions without a profile are scored by what needs none."""
    joined = activities.join(profiles, "user_id", "left")
    rows = joined.withColumns(inputs())
    rows = rows.withColumns({f"load_{name}": x for name, x in scores().items()}).withColumn("best", training_load())
    return rows.withColumns({"load": F.round(F.col("best.score") + 1e-9, 2), "load_source": F.col("best.source"), "load_confidence": F.col("best.confidence")}).withColumn("load_detail", load_detail()).drop("best", *inputs())


def daily_load(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("user_id", "day").agg(F.sum("load").alias("load"), F.count("*").alias("sessions"))


def numbered(daily: DataFrame) -> DataFrame:
    """With the day's number and its distance from the athlete's first."""
    rows = daily.withColumn("dayno", day_number(F.col("day")))
    return rows.withColumn("since", F.col("dayno") - F.min("dayno").over(Window.partitionBy("user_id").orderBy("dayno").rowsBetween(Window.unboundedPreceding, 0)))


def form_curve(daily: DataFrame, seed_ctl: Column | float = 0.0, seed_atl: Column | float = 0.0) -> DataFrame:
    """ctl, atl and tsb of each day with a row; tsb is the difference of the rounded values."""
    rows = numbered(daily)
    window = so_far()
    rows = rows.withColumns({"ctl": ewma(F.col("load"), F.col("since"), CTL_DAYS, window, seed_ctl), "atl": ewma(F.col("load"), F.col("since"), ATL_DAYS, window, seed_atl)})
    rows = rows.withColumns({c: F.round(F.col(c) + 1e-9, 2) for c in ("ctl", "atl")})
    return rows.withColumn("tsb", F.col("ctl") - F.col("atl"))


def dense(daily: DataFrame, last: Column | None = None) -> DataFrame:
    """A row for each day from the athlete's first to their last (or the given day), rest days as 0."""
    ends = daily.groupBy("user_id").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    calendar = ends.select("user_id", F.explode(F.sequence("a", F.greatest(last, F.col("a")) if last is not None else F.col("b"))).alias("day"))
    return calendar.join(daily, ["user_id", "day"], "left").fillna(0.0, ["load"])


def zone_of(ratio: Column) -> Column:
    return F.when(ratio.isNull(), "unknown").when(ratio < 0.80, "undertraining").when(ratio <= 1.30, "sweet_spot").when(ratio <= 1.50, "elevated").otherwise("danger")


def workload(daily: DataFrame) -> DataFrame:
    """The rolling ratios of each day: acwr, monotony, strain, weekly ramp and days of history."""
    rows = numbered(daily)
    week, month, before = days(-6, 0), days(-27, 0), days(-13, -7)
    load = F.col("load")
    rows = rows.withColumns(
        {
            "week_load": F.sum(load).over(week),
            "week_squares": F.sum(load * load).over(week),
            "month_load": F.sum(load).over(month),
            "previous_load": F.coalesce(F.sum(load).over(before), F.lit(0.0)),
            "observed_days": F.count(load).over(month),
            "dense_days": F.least(F.col("since") + 1, F.lit(28)),
        }
    )
    acute, chronic = F.col("week_load") / 7, F.col("month_load") / 28
    # of seven days, the ones without a row as zeros; a variance that is only rounding counts as flat
    variance = (F.col("week_squares") - F.col("week_load") * F.col("week_load") / 7) / 6
    sd = F.when(variance > 1e-9 * (F.col("week_squares") + 1e-9), F.sqrt(variance))
    monotony = acute / sd
    return rows.withColumns(
        {
            "acwr": F.when(chronic > 0, F.round(acute / chronic + 1e-9, 3)),
            "acute_daily": F.round(acute + 1e-9, 2),
            "chronic_daily": F.round(chronic + 1e-9, 2),
            "monotony": F.round(monotony + 1e-9, 3),
            "strain": F.round(F.col("week_load") * monotony + 1e-9, 1),
            "ramp_pct": F.when(F.col("previous_load") > 0, F.round(100 * (F.col("week_load") - F.col("previous_load")) / F.col("previous_load") + 1e-9, 1)),
        }
    ).withColumns({"acwr_zone": zone_of(F.col("acwr")), "acwr_reliable": (F.col("dense_days") >= 28) & F.col("acwr").isNotNull()})


def acwr_ewma(daily: DataFrame) -> DataFrame:
    """The exponentially weighted ratio: both means run over the 28 dense days of the window, from its mean."""
    rows = numbered(daily)
    pairs = F.collect_list(F.struct("dayno", "load")).over(days(-27, 0))
    rows = rows.withColumn("pairs", pairs)
    # 28 values, 0 where a day has no row
    values = F.transform(F.sequence(F.col("dayno") - 27, F.col("dayno")), lambda d: F.coalesce(F.get(F.filter("pairs", lambda p: p.dayno == d), F.lit(0)).load, F.lit(0.0)))
    rows = rows.withColumn("values", values)
    mean = F.aggregate("values", F.lit(0.0), lambda a, x: a + x) / 28
    rows = rows.withColumn("seed", mean).withColumns({"acute": ewma_fold(F.col("values"), 7.0, F.col("seed")), "chronic": ewma_fold(F.col("values"), 28.0, F.col("seed"))})
    return rows.withColumn("acwr", F.when(F.col("chronic") > 0, F.round(F.col("acute") / F.col("chronic") + 1e-9, 3))).drop("pairs", "values")


def normalised_power(samples: DataFrame, by: str, order: list[str], value: str = "value", window: int = 30) -> DataFrame:
    """The fourth root of the mean fourth power of the rolling means; null where there are fewer samples than a window."""
    rolling = Window.partitionBy(by).orderBy(*order).rowsBetween(-(window - 1), 0)
    n = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    rows = samples.select(by, F.when(n >= window, F.avg(value).over(rolling)).alias("mean"))
    fourth = F.avg(F.pow("mean", F.lit(4.0)))
    return rows.groupBy(by).agg(F.count("*").alias("samples"), F.pow(fourth, F.lit(0.25)).alias("normalized_power"))
