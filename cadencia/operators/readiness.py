"""Explained composites: readiness, injury risk and the adaptation of today's session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import NUDGE, clamp, day_number, days, present, smallest_worthwhile_change, z_score
from ..params import BASELINE_DAYS, BASELINE_POINTS, DEEP_REM_TARGET, LEAST_DATA_QUALITY, LOAD_PER_HOUR, READINESS_BANDS, READINESS_TOP, READINESS_WEIGHTS, RISK_BANDS, RISK_CAP, RISK_COEFFICIENTS, RISK_INTERCEPT, RISK_TOP, SESSION_NOTES, SLEEP_NEED_MIN
from .series import form_curve, workload


def score_from_z(z: Column, higher_is_better: bool = True) -> Column:
    return 50 + 50 * clamp((z if higher_is_better else -z) / 2, -1.0, 1.0)


def band(value: Column, bands: tuple, top: str) -> Column:
    out = F.when(value < bands[0][0], bands[0][1])
    for limit, name in bands[1:]:
        out = out.when(value < limit, name)
    return out.otherwise(top)


def with_baselines(wellness: DataFrame) -> DataFrame:
    """Each day's wellness with the statistics of the 28 days before it and of the last weeks."""
    rows = wellness.withColumn("dayno", day_number(F.col("day")))
    rows = rows.withColumns({"raw": present(F.col("hrv_rmssd_ms")), "log": F.when(F.col("hrv_rmssd_ms") > 0, F.ln("hrv_rmssd_ms")), "rhr": present(F.col("resting_hr")), "sleep_h": present(F.col("sleep_total_min")) / 60})
    before = days(-BASELINE_DAYS, -1)
    stats = {}
    for c in ("raw", "log", "rhr"):
        stats |= {f"{c}_mean": F.avg(c).over(before), f"{c}_sd": F.stddev_samp(c).over(before), f"{c}_n": F.count(c).over(before)}
    week, earlier = days(-6, 0), days(-34, -7)
    stats |= {"week_sleep_h": F.avg("sleep_h").over(week), "rhr_week": F.avg("rhr").over(week), "rhr_week_n": F.count("rhr").over(week)}
    stats |= {"rhr_early": F.avg("rhr").over(earlier), "rhr_early_sd": F.stddev_samp("rhr").over(earlier), "rhr_early_n": F.count("rhr").over(earlier)}
    rows = rows.withColumns(stats)
    low = (F.col("log_n") >= BASELINE_POINTS) & (z_score(F.col("log"), F.col("log_mean"), F.col("log_sd"), F.col("log_n")) < -1.0)
    return rows.withColumn("low_hrv", F.when(low, 1).otherwise(0)).withColumn("low_hrv_days", F.sum("low_hrv").over(days(-13, 0)))


def components(c=F.col) -> dict[str, Column]:
    """The score of each component, null where there is too little to tell, over wellness, form and workload columns."""
    z = lambda x: z_score(c(x), c(f"{x}_mean"), c(f"{x}_sd"), c(f"{x}_n"))
    off = 100 * (c("raw") - c("raw_mean")) / F.nullif(c("raw_mean"), F.lit(0.0))
    swc = smallest_worthwhile_change(c("raw_mean"), F.coalesce(c("raw_sd"), F.lit(0.0)))
    hrv = F.when(c("log").isNotNull() & (c("log_n") >= BASELINE_POINTS), F.when(F.abs(off) < swc, 50.0).otherwise(score_from_z(z("log"))))
    rhr = F.when(c("resting_hr").isNotNull() & (c("rhr_n") >= BASELINE_POINTS), score_from_z(z_score(c("resting_hr"), c("rhr_mean"), c("rhr_sd"), c("rhr_n")), higher_is_better=False))
    total = present(c("sleep_total_min"))
    some = c("sleep_deep_min").isNotNull() | c("sleep_rem_min").isNotNull()
    restored = (F.coalesce(c("sleep_deep_min"), F.lit(0.0)) + F.coalesce(c("sleep_rem_min"), F.lit(0.0))) / total
    sleep = mean_of(clamp(100 * total / SLEEP_NEED_MIN, 0.0, 100.0), clamp(c("sleep_efficiency_pct"), 0.0, 100.0), F.when(some, clamp(100 * restored / DEEP_REM_TARGET, 0.0, 100.0)))
    subjective = clamp(100 * (5 - hooper(c)) / 4, 0.0, 100.0)
    ratio = F.when(c("acwr_reliable"), c("acwr"))
    load = mean_of(
        clamp(100 * (c("tsb") + 30) / 35, 0.0, 100.0),
        F.when(ratio <= 1.30, 100.0).when(ratio.isNotNull(), clamp(100 - (ratio - 1.30) * 200, 0.0, 100.0)),
        F.when(c("monotony").isNotNull(), clamp(100 - F.greatest(F.lit(0.0), c("monotony") - 1.5) * 60, 0.0, 100.0)),
    )
    return {"hrv": hrv, "resting_hr": rhr, "sleep": sleep, "subjective": subjective, "training_load": F.when(c("tsb").isNotNull(), load)}


def mean_of(*parts: Column) -> Column:
    """Mean of those that aren't null; null if all are."""
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0.0)))
    n = sum((p.isNotNull().cast("int") for p in parts[1:]), parts[0].isNotNull().cast("int"))
    return total / F.nullif(n, F.lit(0))


def hooper(c=F.col) -> Column:
    return mean_of(*(c(x).cast("double") for x in ("soreness", "mood", "stress", "fatigue")))


def athlete_days(wellness: DataFrame, daily: DataFrame) -> DataFrame:
    """One row for each athlete and day with wellness or load, carrying all that the composites need."""
    # one sort by athlete and day serves the curve and the ratios
    load = workload(form_curve(daily)).select("user_id", "day", "load", "acwr", "acwr_reliable", "monotony", "ramp_pct", "ctl", "atl", "tsb")
    return with_baselines(wellness).join(load, ["user_id", "day"], "full")


def readiness(rows: DataFrame) -> DataFrame:
    """readiness, band, data_quality and drivers (by falling size of contribution, then in the components' order)."""
    each = components()
    rows = rows.withColumns({f"c_{name}": x for name, x in each.items()})
    known = sum((F.when(F.col(f"c_{n}").isNotNull(), w).otherwise(0.0) for n, w in READINESS_WEIGHTS.items()), F.lit(0.0))
    rows = rows.withColumn("known", known)
    weight = lambda n: F.lit(READINESS_WEIGHTS[n]) / F.col("known")
    total = sum((F.coalesce(F.when(F.col("known") > 0, weight(n) * F.col(f"c_{n}")), F.lit(0.0)) for n in READINESS_WEIGHTS), F.lit(0.0))
    rows = rows.withColumn("total", F.when(F.col("known") > 0, total).otherwise(50.0))
    driver = lambda i, n: F.when(
        F.col(f"c_{n}").isNotNull(),
        F.struct(F.lit(i).alias("place"), F.lit(n).alias("name"), F.round(F.col(f"c_{n}") + 1e-9, 1).alias("score"), F.round(weight(n), 3).alias("weight"), F.round(weight(n) * (F.col(f"c_{n}") - 50) + 1e-9, 2).alias("contribution")),
    )
    drivers = F.filter(F.array(*(driver(i, n) for i, n in enumerate(READINESS_WEIGHTS))), lambda d: d.isNotNull())
    return rows.withColumns(
        {
            "readiness": F.round(F.col("total") + 1e-9, 1),
            "band": band(F.col("total") + NUDGE, READINESS_BANDS, READINESS_TOP),
            "data_quality": F.round("known", 3),
            "drivers": by_size(drivers),
        }
    ).withColumn("refusal", F.when(F.col("data_quality") < LEAST_DATA_QUALITY, "insufficient_data"))


def by_size(drivers: Column) -> Column:
    """By falling size of the contribution; equal ones stay in order."""
    size = lambda d: F.abs(d.contribution)
    return F.array_sort(drivers, lambda a, b: F.when(size(a) > size(b), -1).when(size(a) < size(b), 1).otherwise(a.place - b.place))


def risk_features(c=F.col) -> dict[str, Column]:
    capped = lambda x: F.coalesce(clamp(x, 0.0, RISK_CAP), F.lit(0.0))
    above = lambda x, limit: F.when(x.isNotNull(), F.greatest(F.lit(0.0), x - limit))
    raised = F.when((c("rhr_week_n") >= 3) & (c("rhr_early_n") >= 7), z_score(c("rhr_week"), c("rhr_early"), c("rhr_early_sd"), c("rhr_early_n")))
    return {
        "acwr_excess": capped(above(F.when(c("acwr_reliable"), c("acwr")), 1.30) / 0.20),
        "ramp_excess": capped(above(c("ramp_pct"), 10.0) / 10),
        "monotony_excess": capped(above(c("monotony"), 1.80) / 0.50),
        "sleep_debt_h": capped(SLEEP_NEED_MIN / 60 - c("week_sleep_h")),
        "hrv_suppression": capped(c("low_hrv_days") / 7),
        "resting_hr_elevation": capped(raised),
        "prior_injury": F.when(c("injuries_last_12m") >= 1, 1.0).otherwise(0.0),
        "low_chronic_load": capped((30 - c("ctl")) / 30),
        "training_age": F.coalesce(clamp(c("training_age_years") / 5, 0.0, 1.0), F.lit(0.0)),
        "age_over_40": capped((F.nullif(c("age"), F.lit(0)) - 40) / 10.0),
    }


def logistic_risk(features: dict[str, Column]) -> Column:
    """The probability that the shipped model gives: logistic in the features."""
    return 1 / (1 + F.exp(-sum((F.lit(RISK_COEFFICIENTS[n]) * features[n] for n in RISK_COEFFICIENTS), F.lit(RISK_INTERCEPT))))


def injury_risk(rows: DataFrame, profiles: DataFrame, predict: Callable[[dict[str, Column]], Column] = logistic_risk) -> DataFrame:
    """risk, risk_band and risk_drivers; contributions are log-odds and add up to the logit with the intercept. Another model
    takes the place of the shipped one as `predict`, from the features by name to a probability; the drivers stay its."""
    rows = rows.join(profiles.select("user_id", "age", "injuries_last_12m", "training_age_years"), "user_id", "left")
    rows = rows.withColumns({f"f_{n}": x for n, x in risk_features().items()})
    term = lambda n: F.lit(RISK_COEFFICIENTS[n]) * F.col(f"f_{n}")
    driver = lambda i, n: F.when(F.abs(term(n)) > 1e-9, F.struct(F.lit(i).alias("place"), F.lit(n).alias("name"), F.round(F.col(f"f_{n}") + 1e-9, 3).alias("value"), F.round(term(n) + 1e-9, 4).alias("contribution")))
    drivers = F.filter(F.array(*(driver(i, n) for i, n in enumerate(RISK_COEFFICIENTS))), lambda d: d.isNotNull())
    rows = rows.withColumn("p", predict({n: F.col(f"f_{n}") for n in RISK_COEFFICIENTS}))
    return rows.withColumns({"risk": F.round(F.col("p") + 1e-9, 4), "risk_band": band(F.col("p"), RISK_BANDS, RISK_TOP), "risk_drivers": by_size(drivers)})


def adapt_today(rows: DataFrame) -> DataFrame:
    """action, new_intensity, new_duration_min, new_load, new_notes and reason for each planned session, by the day's readiness and risk.

    Expects intensity (null: no session), is_key, duration_min, target_load, readiness, band, data_quality, drivers (the
    largest first) and risk_band.
    """
    c = F.col
    per_hour = F.create_map(*(F.lit(x) for kv in LOAD_PER_HOUR.items() for x in kv))
    lower = F.create_map(*(F.lit(x) for x in ("vo2max", "threshold", "threshold", "tempo", "tempo", "easy", "easy", "easy", "recovery", "recovery")))
    down = F.element_at(lower, c("intensity"))
    thin = c("readiness").isNull() | c("data_quality").isNull() | (c("data_quality") < LEAST_DATA_QUALITY)
    hard = c("is_key") & (c("intensity") != "easy")
    capped = (c("risk_band") == RISK_TOP) & c("intensity").isin("vo2max", "threshold")
    case = lambda none, keep, rest, easy, intensity, volume, cap: F.when(c("intensity").isNull(), none).when(thin, keep).when(c("readiness") < 25, rest).when(c("readiness") < 50, easy).when((c("readiness") < 70) & hard, intensity).when(c("readiness") < 70, volume).when(F.coalesce(capped, F.lit(False)), cap).otherwise(keep)
    lit = F.lit
    minutes = lambda share: F.greatest(F.lit(20), F.floor(c("duration_min") * share).cast("int"))
    to = lambda name: F.round(c("target_load") * F.element_at(per_hour, name) / F.element_at(per_hour, c("intensity")) + 1e-9, 1)
    null = F.lit(None)
    top = F.coalesce(F.get("drivers", F.lit(0)).getField("name"), lit("recovery data"))
    score = F.concat(lit("Readiness "), F.bround("readiness", 0).cast("int").cast("string"), lit("/100"))
    say = lambda *x: F.concat(*(lit(y) if isinstance(y, str) else y for y in x))
    thin_or_green = F.when(thin, lit("Not enough recovery data this morning to adjust — keeping the plan as written.")).otherwise(say(score, " (", c("band"), "). Go as planned."))
    reasons = (
        lit("No session scheduled today."),
        thin_or_green,
        say(score, " (", c("band"), "), driven by ", top, ". Full rest today."),
        say(score, ", limited by ", top, ". Aerobic only today; the quality work moves."),
        say(score, ", held back by ", top, ". One intensity band down."),
        say(score, ", held back by ", top, ". Volume trimmed 20%."),
        lit("Recovery looks fine, but your recent load pattern is in the elevated-risk band — capping today's intensity as a precaution."),
    )
    note = lambda x: F.try_element_at(F.create_map(*(lit(y) for kv in SESSION_NOTES.items() for y in kv)), x)
    same = note(c("intensity"))
    return rows.withColumns(
        {
            "reason": case(*reasons),
            "new_notes": case(null, same, null, note(lit("easy")), note(down), same, note(lit("tempo"))),
            "action": case(lit("rest"), lit("as_planned"), lit("rest"), lit("easy_only"), lit("reduce_intensity"), lit("reduce_volume"), lit("reduce_intensity")),
            "new_intensity": case(null, c("intensity"), null, lit("easy"), down, c("intensity"), lit("tempo")),
            "new_duration_min": case(null, c("duration_min"), null, minutes(0.6), minutes(0.9), minutes(0.8), minutes(0.85)),
            "new_load": case(null, c("target_load"), null, F.round(c("target_load") * 0.5 + 1e-9, 1), to(down), F.round(c("target_load") * 0.8 + 1e-9, 1), to(lit("tempo"))),
        }
    )
