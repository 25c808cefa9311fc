"""Periodised plans as rows: a request becomes weeks, a week becomes sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import clamp, half_even
from ..params import LOAD_PER_HOUR, RAMP_CAP_PCT, RECOVERY_EVERY, RECOVERY_SHARE, SESSION_NOTES, STARTING_LOAD, TAPER_SHARES


def lookup(values: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def weeks(requests: DataFrame) -> DataFrame:
    """week, phase, is_recovery and load (unrounded) of each request's weeks.

    Expects id, weeks, sessions_per_week, level, current_ctl, has_race. The load grows by the level's cap in each week
    that is neither the first, a recovery week nor a taper: a running count instead of a loop.
    """
    c = F.col
    rows = requests.withColumns(
        {
            "taper": F.when(c("weeks") >= 8, 2).when(c("weeks") >= 4, 1).otherwise(0),
            "peak": F.when(c("weeks") >= 12, 2).when(c("weeks") >= 6, 1).otherwise(0),
            "ramp": lookup(RAMP_CAP_PCT, c("level")) / 100,
            "base_load": F.greatest(c("current_ctl") * 7, lookup(STARTING_LOAD, c("level"))),
            "week": F.explode(F.sequence(F.lit(0), c("weeks") - 1)),
        }
    )
    rest = c("weeks") - c("taper") - c("peak")
    base_weeks = F.greatest(F.lit(0), half_even(rest * F.lit(0.45)))
    racing = F.when(c("week") < base_weeks, "base").when(c("week") < rest, "build").when(c("week") < c("weeks") - c("taper"), "peak").otherwise("taper")
    steady = F.when(c("week") < F.greatest(F.lit(1), F.floor(c("weeks") / 3)), "base").otherwise("build")
    rows = rows.withColumn("plain", F.when(c("has_race"), racing).otherwise(steady))
    rows = rows.withColumn("is_recovery", ((c("week") + 1) % RECOVERY_EVERY == 0) & c("plain").isin("base", "build"))
    grows = (c("week") > 0) & ~c("is_recovery") & (c("plain") != "taper")
    steps = F.sum(grows.cast("int")).over(Window.partitionBy("id").orderBy("week").rowsBetween(Window.unboundedPreceding, 0))
    # the load never falls before the taper, so the peak is the latest
    rows = rows.withColumn("progress", c("base_load") * F.pow(1 + c("ramp"), steps))
    share = F.when(c("week") - (c("weeks") - c("taper")) <= 0, TAPER_SHARES[0]).otherwise(TAPER_SHARES[1])
    return rows.withColumns({"phase": F.when(c("is_recovery"), "recovery").otherwise(c("plain")), "load": F.when(c("plain") == "taper", c("progress") * share).when(c("is_recovery"), c("progress") * RECOVERY_SHARE).otherwise(c("progress"))})


def _slot(intensity: str, is_key: bool, share: float) -> Column:
    return F.struct(F.lit(intensity).alias("intensity"), F.lit(is_key).alias("is_key"), F.lit(share).alias("share"))


def template(phase: Column, n: Column) -> Column:
    """The sessions of a week as (intensity, is_key, share): quality first, then the long one, then easy ones."""
    easy = lambda k: F.when(k > 0, F.array_repeat(_slot("easy", False, 1.0), k.cast("int"))).otherwise(F.array_repeat(_slot("easy", False, 1.0), 0))
    kinds = F.when(phase == "base", F.array(_slot("tempo", True, 1.4))).when(phase == "build", F.array(_slot("threshold", True, 1.5), _slot("tempo", True, 1.3))).otherwise(F.array(_slot("vo2max", True, 1.6), _slot("threshold", True, 1.4)))
    quality = F.slice(kinds, F.lit(1), F.greatest(F.lit(1), n - 1))
    long = F.when(n >= 3, F.array(_slot("easy", True, 2.0))).otherwise(F.array_repeat(_slot("easy", True, 2.0), 0))
    usual = F.concat(quality, long, easy(n - F.size(quality) - F.size(long)))
    return F.when(phase == "recovery", F.array_repeat(_slot("recovery", False, 1.0), n.cast("int"))).when(phase == "taper", F.concat(F.array(_slot("threshold", True, 1.2)), easy(n - 1))).otherwise(usual)


def sessions(plan: DataFrame) -> DataFrame:
    """slot, day_offset, intensity, is_key, target_load, duration_min, sport, title and notes of each session of each week."""
    rows = plan.withColumn("slots", template(F.col("phase"), F.col("sessions_per_week")))
    rows = rows.withColumn("shares", F.aggregate("slots", F.lit(0.0), lambda a, s: a + s.share)).withColumn("n", F.size("slots"))
    rows = rows.select("*", F.posexplode("slots").alias("slot", "s")).drop("slots")
    c = F.col
    load = c("load") * c("s.share") / c("shares")
    day = F.when(c("n") >= 7, c("slot") % 7).otherwise(F.least(F.lit(6), half_even(c("slot") * F.lit(7.0) / c("n"))))
    others = c("secondary_sports")
    sport = F.when((F.size(others) == 0) | (c("slot") % 2 == 0), c("primary_sport")).otherwise(F.get(others, (F.floor(c("slot") / 2) % F.greatest(F.size(others), F.lit(1))).cast("int")))
    rows = rows.withColumns({"day_offset": (c("week") * 7 + day).cast("int"), "intensity": c("s.intensity"), "is_key": c("s.is_key"), "target_load": F.round(load + 1e-9, 1), "duration_min": F.greatest(F.lit(20), half_even(60 * load / lookup(LOAD_PER_HOUR, c("s.intensity")))), "sport": sport})
    label = lookup({"recovery": "Recovery", "easy": "Aerobic", "tempo": "Tempo", "threshold": "Threshold", "vo2max": "VO2max intervals"}, c("intensity"))
    prefix = F.when(c("is_key") & (c("intensity") != "easy"), "Key ").when(c("is_key"), "Long ").otherwise("")
    return rows.withColumns({"title": F.concat(prefix, F.initcap("sport"), F.lit(" "), label), "notes": lookup(SESSION_NOTES, c("intensity"))}).drop("s")


def weekly_compliance(rows: DataFrame) -> DataFrame:
    """Done load as a share of the planned, between 0 and 2; 0 where nothing was planned."""
    share = F.round(clamp(F.col("load") / F.nullif(F.col("planned"), F.lit(0)), 0.0, 2.0) + 1e-9, 3)
    return rows.withColumn("compliance", F.when(F.col("planned") > 0, share).otherwise(0.0))


def match_sessions(planned: DataFrame, done: DataFrame) -> DataFrame:
    """The best done session of each planned one: same athlete, day and sport, duration within 30 % or load within 40 %."""
    c = F.col
    near = (F.abs(c("duration_s") - c("planned_s")) <= 0.3 * c("planned_s")) | (F.abs(c("load") - c("planned_load")) <= 0.4 * c("planned_load"))
    pairs = planned.join(done, ["user_id", "day", "sport"]).filter(near).withColumn("off", F.abs(c("duration_s") - c("planned_s")) / c("planned_s"))
    return pairs.groupBy("planned_id").agg(F.min(F.struct("off", "activity_id", "load")).alias("b")).select("planned_id", "b.activity_id", "b.load")
