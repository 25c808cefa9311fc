"""Checks of rows before they are stored and of requests before they are taken. A missing value passes each check."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ranges that the store accepts, both ends included; None is no bound.
RANGES: dict[str, dict[str, tuple[float | None, float | None]]] = {
    "profile": {
        "height_cm": (80, 260),
        "weight_kg": (25, 350),
        "training_age_years": (0, None),
        "injuries_last_12m": (0, 50),
        "hr_max": (100, 240),
        "hr_rest": (25, 120),
        "lthr": (80, 230),
        "ftp_watts": (30, 800),
        "run_threshold_power_w": (50, 800),
        "threshold_pace_s_per_km": (120, 900),
        "css_s_per_100m": (40, 300),
        "vo2max": (15, 100),
    },
    "activity": {
        "distance_m": (0, None),
        "avg_hr": (20, 250),
        "max_hr": (20, 250),
        "avg_power": (0, None),
        "normalized_power": (0, None),
        "max_power": (0, None),
        "avg_cadence": (0, None),
        "total_strokes": (0, None),
        "rpe": (1, 10),
        "trust_score": (0, 1),
    },
    "wellness": {
        "resting_hr": (25, 140),
        "sleep_total_min": (0, 1200),
        "sleep_deep_min": (0, None),
        "sleep_rem_min": (0, None),
        "sleep_light_min": (0, None),
        "sleep_awake_min": (0, None),
        "sleep_efficiency_pct": (0, 100),
        "body_weight_kg": (25, 350),
        "spo2_pct": (50, 100),
        "soreness": (1, 5),
        "mood": (1, 5),
        "stress": (1, 5),
        "fatigue": (1, 5),
    },
    "goal": {"priority": (1, 3)},
    "personal_best": {},
}
# Ranges whose ends are left out.
OPEN_RANGES: dict[str, dict[str, tuple[float | None, float | None]]] = {
    "activity": {"duration_s": (0, 604800), "moving_time_s": (0, None), "pool_length_m": (0, None)},
    "wellness": {"hrv_rmssd_ms": (0, 400)},
    "goal": {"target_distance_m": (0, None), "target_value": (0, None)},
    "personal_best": {"distance_m": (0, None), "time_s": (0, None)},
}
# Levels, where a threshold may come from, the fastest plausible speeds in m/s, the longest distance and time, and ages.
LEVELS = ("beginner", "intermediate", "advanced")
THRESHOLD_SOURCES = ("tested", "estimated", "self_reported", "provider")
FASTEST = {"run": 13.0, "bike": 30.0, "swim": 3.0, "other": 30.0}
MOST_REQUESTED = 1_000_000
YOUNGEST, OLDEST = 13, 110


def within(value: Column, low: float | None, high: float | None, open_ends: bool = False) -> Column:
    ok = F.lit(True)
    if low is not None:
        ok = ok & ((value > low) if open_ends else (value >= low))
    if high is not None:
        ok = ok & ((value < high) if open_ends else (value <= high))
    return ok


def range_checks(kind: str, columns: list[str]) -> dict[str, Column]:
    """Code: check, for those of the kind's columns that there are."""
    out = {name: within(F.col(name), *ends) for name, ends in RANGES[kind].items() if name in columns}
    return out | {name: within(F.col(name), *ends, open_ends=True) for name, ends in OPEN_RANGES.get(kind, {}).items() if name in columns}


def profile_checks(columns: list[str], today: Column | None = None) -> dict[str, Column]:
    """Of a stored profile or an update of one: ranges, level, sources of thresholds, age and the order of heart rates."""
    c, out = F.col, range_checks("profile", columns)
    if "level" in columns:
        out["level"] = c("level").isin(*LEVELS)
    if "threshold_sources" in columns:
        out["threshold_sources"] = F.forall(F.map_values("threshold_sources"), lambda x: x.isin(*THRESHOLD_SOURCES))
    if "birth_date" in columns:
        age = F.datediff(F.current_date() if today is None else today, c("birth_date")) / 365.25
        out["birth_date"] = age.between(YOUNGEST, OLDEST)
    if {"hr_max", "hr_rest"} <= set(columns):
        out["hr_order"] = c("hr_max") > c("hr_rest")
    return out


def activity_checks(columns: list[str]) -> dict[str, Column]:
    c, out = F.col, range_checks("activity", columns)
    if "duration_s" in columns:
        out["duration_missing"] = c("duration_s").isNotNull()
    if {"max_hr", "avg_hr"} <= set(columns):
        out["hr_order"] = c("max_hr") >= c("avg_hr")
    if {"moving_time_s", "duration_s"} <= set(columns):
        out["moving_order"] = c("moving_time_s") <= c("duration_s")
    return out


def wellness_checks(columns: list[str]) -> dict[str, Column]:
    out = range_checks("wellness", columns)
    if {"sleep_deep_min", "sleep_total_min"} <= set(columns):
        out["sleep_order"] = F.col("sleep_deep_min") <= F.col("sleep_total_min")
    return out


def goal_checks(columns: list[str]) -> dict[str, Column]:
    """A race time needs a target and a day."""
    c, out = F.col, range_checks("goal", columns)
    out["target_distance_m"] = within(c("target_distance_m"), 0, None, open_ends=True) & (c("target_distance_m") <= MOST_REQUESTED)
    out["race_time"] = (c("goal_type") != "race_time") | (c("target_value").isNotNull() & c("race_date").isNotNull())
    return out


def personal_best_checks(today: Column | None = None) -> dict[str, Column]:
    """Not in the future, and not faster than is possible."""
    c = F.col
    out = {n: (c(n) > 0) & (c(n) <= MOST_REQUESTED) for n in ("distance_m", "time_s")}
    out["achieved_on"] = c("achieved_on") <= (F.current_date() if today is None else today)
    fastest = F.create_map(*(F.lit(x) for kv in FASTEST.items() for x in kv))
    out["sport"] = c("sport").isin(*FASTEST)
    out["speed"] = c("distance_m") / F.nullif(c("time_s"), F.lit(0)) <= F.try_element_at(fastest, c("sport"))
    return out


def failed(checks: dict[str, Column]) -> Column:
    """The codes of the checks that a row fails, in order of the codes."""
    return F.filter(F.array(*(F.when(~checks[name], name) for name in sorted(checks))), lambda x: x.isNotNull())
