"""Training load of a session on one scale: 100 is an hour at threshold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import CONFIDENCE, DEFAULT_HR_REST, LTHR_SHARE, PRECEDENCE, RPE_CALIBRATION, TANAKA
from .stats import clamp, half_even, present


def effective_hr_max(hr_max: Column, age: Column) -> Column:
    return F.coalesce(F.nullif(hr_max, F.lit(0)), half_even(F.lit(TANAKA[0]) - F.lit(TANAKA[1]) * F.nullif(age, F.lit(0))))


def effective_hr_rest(hr_rest: Column) -> Column:
    return F.coalesce(F.nullif(hr_rest, F.lit(0)), F.lit(DEFAULT_HR_REST))


def effective_lthr(lthr: Column, hr_max: Column) -> Column:
    return F.coalesce(F.nullif(lthr, F.lit(0)), half_even(hr_max * F.lit(LTHR_SHARE)))


def trimp(minutes: Column, hr: Column, hr_rest: Column, hr_max: Column, sex: Column) -> Column:
    """Null where hr_max doesn't exceed hr_rest; an unspecified sex gets the mean of both forms."""
    reserve = clamp((hr - hr_rest) / F.nullif(hr_max - hr_rest, F.lit(0)), 0.0, 1.0)
    male, female = 0.64 * F.exp(1.92 * reserve), 0.86 * F.exp(1.67 * reserve)
    factor = F.when(sex == "male", male).when(sex == "female", female).otherwise((male + female) / 2)
    return F.when(hr_max > hr_rest, F.when(minutes <= 0, 0.0).otherwise(minutes * reserve * factor))


def not_negative(x: Column) -> Column:
    """0 for what isn't positive: a session of no length has no load."""
    return F.when(x <= 0, 0.0).otherwise(x)


def power_load(seconds: Column, power: Column, threshold: Column) -> Column:
    intensity = present(power) / present(threshold)
    return 100 * (not_negative(seconds) / 3600) * intensity * intensity


def hr_load(minutes: Column, hr: Column, hr_rest: Column, hr_max: Column, lthr: Column, sex: Column) -> Column:
    reference = trimp(F.lit(60.0), lthr, hr_rest, hr_max, sex)
    return F.when(reference > 0, 100 * trimp(minutes, present(hr), hr_rest, hr_max, sex) / reference)


def pace_load(seconds: Column, pace: Column, threshold: Column, power: int) -> Column:
    factor = present(threshold) / present(pace)
    out = 100 * (not_negative(seconds) / 3600)
    for _ in range(power):
        out = out * factor
    return out


def rpe_load(minutes: Column, rpe: Column) -> Column:
    """An effort outside 1 to 10 scores nothing (null), unless the session has no length, which scores 0."""
    return F.when((minutes <= 0) & present(rpe).isNotNull(), 0.0).when(rpe.between(1, 10), minutes * rpe * F.lit(RPE_CALIBRATION))


def inputs(c=F.col) -> dict[str, Column]:
    """What the scores are made of, as columns of their own, so that each is computed once."""
    active = F.coalesce(F.nullif(c("moving_time_s"), F.lit(0)), c("duration_s"))
    return {
        "in_hr_max": effective_hr_max(c("hr_max"), c("age")),
        "in_hr_rest": effective_hr_rest(c("hr_rest")),
        "in_lthr": effective_lthr(c("lthr"), effective_hr_max(c("hr_max"), c("age"))),
        "in_active_s": active,
        "in_speed": present(c("distance_m")) / active,
        "in_power": F.coalesce(present(c("normalized_power")), present(c("avg_power"))),
        "in_threshold": F.when(c("sport") == "bike", c("ftp_watts")).when(c("sport") == "run", c("run_threshold_power_w")),
    }


def scores(c=F.col) -> dict[str, Column]:
    """The score of each source, null where it isn't usable, over the columns of an activity, its profile and inputs()."""
    minutes = c("duration_s") / 60
    swim = pace_load(c("in_active_s"), 100 / c("in_speed"), c("css_s_per_100m"), 3)
    return {
        "power": power_load(c("in_active_s"), c("in_power"), c("in_threshold")),
        "heart_rate": hr_load(minutes, c("avg_hr"), c("in_hr_rest"), c("in_hr_max"), c("in_lthr"), c("sex")),
        "pace": F.when(c("sport") == "swim", swim).otherwise(pace_load(c("in_active_s"), 1000 / c("in_speed"), c("threshold_pace_s_per_km"), 2)),
        "rpe": rpe_load(minutes, c("rpe")),
    }


def training_load(c=F.col) -> Column:
    """(score, source, confidence) over the columns load_<source>: the first usable source of the sport's list."""
    entry = lambda s: F.when(c(f"load_{s}").isNotNull(), F.struct(c(f"load_{s}").alias("score"), F.lit(s).alias("source"), F.lit(CONFIDENCE[s]).alias("confidence")))
    first = lambda order: F.coalesce(*(entry(s) for s in order))
    by_list: dict[tuple, list[str]] = {}
    for sport, order in PRECEDENCE.items():
        by_list.setdefault(order, []).append(sport)
    best = first(PRECEDENCE["other"])
    for order, sports in by_list.items():
        if order != PRECEDENCE["other"]:
            best = F.when(c("sport").isin(*sports), first(order)).otherwise(best)
    best = F.coalesce(best, F.struct(F.lit(0.0).alias("score"), F.lit("none").alias("source"), F.lit(CONFIDENCE["none"]).alias("confidence")))
    return best


def load_detail(c=F.col) -> Column:
    """What the score was made of, by name, over load_source and inputs(): empty without a source."""
    entries = lambda **x: F.map_from_arrays(F.array(*(F.lit(k) for k in x)), F.array(*(v.cast("double") for v in x.values())))
    r = lambda x, n: F.round(x + 1e-9, n)
    power = entries(intensity_factor=r(c("in_power") / c("in_threshold"), 3), power_used_w=r(c("in_power"), 1))
    swim, land = entries(pace_s_per_100m=r(100 / c("in_speed"), 1)), entries(pace_s_per_km=r(1000 / c("in_speed"), 1))
    by_source = F.when(c("load_source") == "power", power).when(c("load_source") == "heart_rate", entries(avg_hr=r(c("avg_hr"), 1)))
    by_source = by_source.when((c("load_source") == "pace") & (c("sport") == "swim"), swim).when(c("load_source") == "pace", land)
    return by_source.when(c("load_source") == "rpe", entries(rpe=c("rpe"))).otherwise(F.create_map().cast("map<string,double>"))
