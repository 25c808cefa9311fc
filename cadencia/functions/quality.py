"""Quality and trust of an activity: each rule gives a flag with what it costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import HOLD_BELOW, MAX_DURATION_S, MAX_POWER_W, MAX_SPEED_M_S
from .stats import present


def flags(c=F.col) -> Column:
    """The flags (code, severity, quality_penalty, trust_penalty) in the rules' order.

    Null bounds never flag. Expects the normalised activity's columns, laps, and max_plausible_speed_m_s,
    max_plausible_power_w, max_plausible_duration_s and hr_max_bound.
    """
    d, dist = c("duration_s"), present(c("distance_m"))
    derived = F.when(d > 0, dist / F.nullif(d, F.lit(0.0)))
    speed = F.coalesce(derived, c("avg_speed_m_s"))
    ceiling = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in MAX_SPEED_M_S.items() for x in kv)), c("sport")), F.lit(33.0))
    power, avg, peak = c("avg_power_w"), c("avg_hr"), c("max_hr")
    beyond = lambda x, bound: x > present(c(bound))
    lap_total = F.aggregate(c("laps"), F.lit(0.0), lambda a, x: a + F.coalesce(x.duration_s, F.lit(0.0)))
    sensor = F.coalesce(avg, power, c("avg_speed_m_s"), c("distance_m")).isNotNull()
    moving = c("moving_duration_s")
    # code, severity, quality penalty, trust penalty, condition
    rules = (
        ("duration_non_positive", "critical", 1.0, 1.0, d <= 0),
        ("duration_implausible", "critical", 0.5, 0.6, d > MAX_DURATION_S),
        ("duration_beyond_history", "warning", 0.0, 0.3, (d > 0) & (d <= MAX_DURATION_S) & beyond(d, "max_plausible_duration_s")),
        ("duration_too_short_to_analyse", "info", 0.4, 0.0, (d > 0) & (d < 60)),
        ("speed_physically_impossible", "critical", 0.6, 1.0, speed > ceiling),
        ("speed_beyond_athlete_history", "warning", 0.0, 0.5, (speed <= ceiling) & beyond(speed, "max_plausible_speed_m_s")),
        ("power_physically_impossible", "critical", 0.6, 1.0, power > MAX_POWER_W),
        ("power_beyond_athlete_history", "warning", 0.0, 0.5, (power <= MAX_POWER_W) & beyond(power, "max_plausible_power_w")),
        ("normalised_power_below_average", "warning", 0.3, 0.0, c("normalised_power_w") < power * 0.98),
        ("hr_average_exceeds_max", "warning", 0.4, 0.0, avg > peak),
        ("hr_above_known_max", "info", 0.2, 0.0, peak > F.nullif(c("hr_max_bound"), F.lit(0)) * 1.08),
        ("hr_flatline", "warning", 0.5, 0.3, (peak >= avg) & (peak - avg < 2) & (d > 900) & c("sport").isin("run", "bike", "swim")),
        ("distance_duration_speed_mismatch", "warning", 0.3, 0.4, (derived > 0) & (F.abs(present(c("avg_speed_m_s")) - derived) / derived > 0.25)),
        ("moving_time_exceeds_elapsed", "warning", 0.3, 0.0, present(moving) > d * 1.01),
        ("lap_total_exceeds_duration", "info", 0.15, 0.0, lap_total > d * 1.05),
        ("elevation_gain_implausible", "info", 0.2, 0.0, present(c("elevation_gain_m")) / F.when(dist > 0, dist) > 0.45),
        ("manually_entered", "info", 0.25, 0.35, c("is_manual")),
        ("no_sensor_channels", "warning", 0.5, 0.2, ~sensor & ~c("is_manual")),
    )
    flag = lambda code, severity, q, t, condition: F.when(condition, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(q).alias("quality_penalty"), F.lit(t).alias("trust_penalty")))
    return F.filter(F.array(*(flag(*r) for r in rules)), lambda f: f.isNotNull())


def score(found: Column, penalty: str) -> Column:
    total = F.aggregate(found, F.lit(0.0), lambda a, f: a + f[penalty])
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - total)) + 1e-9, 4)


def held(trust: Column) -> Column:
    return trust < HOLD_BELOW
