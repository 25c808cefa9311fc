"""Load, form, ratios, baselines, readiness and risk of every athlete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import load as fl
from ..functions.stats import day_number, days
from ..operators import readiness as ro
from ..operators import series as so
from ..sources.bridge import activities, profiles, table, wellness
from . import sql

SPARK: dict = {}
ORACLE: dict[str, str] = {}


def register(oracle: str | None = None):
    def add(f):
        SPARK[f.__name__] = f
        if oracle is not None:
            ORACLE[f.__name__] = oracle
        return f

    return add


def sessions(spark: SparkSession, d: str) -> DataFrame:
    return so.score_sessions(activities(spark, d), profiles(spark, d).drop("group_id"))


def daily(spark: SparkSession, d: str) -> DataFrame:
    return so.daily_load(sessions(spark, d))


@register(sql.query(*sql.LOADS, select="SELECT user_id, e AS activity_id, day, sport, load, source AS load_source, CASE source WHEN 'power' THEN 0.95 WHEN 'pace' THEN 0.8 WHEN 'heart_rate' THEN 0.75 WHEN 'rpe' THEN 0.45 ELSE 0 END::DOUBLE AS load_confidence FROM sessions"))
def session_load(spark, d):
    return sessions(spark, d).select("user_id", "activity_id", "day", "sport", "load", "load_source", "load_confidence")


@register(sql.query(*sql.LOADS, select="SELECT sport, source AS load_source, count(*) AS sessions, round(sum(load), 2) AS total_load FROM sessions GROUP BY ALL"))
def load_source_mix(spark, d):
    return sessions(spark, d).groupBy("sport", "load_source").agg(F.count("*").alias("sessions"), F.round(F.sum("load"), 2).alias("total_load"))


@register(sql.query(*sql.LOADS, select="SELECT user_id, day, round(load, 2) AS load, sessions FROM daily"))
def daily_load(spark, d):
    return daily(spark, d).select("user_id", "day", F.round("load", 2).alias("load"), "sessions")


@register(sql.query(*sql.LOADS, select=f"SELECT e AS activity_id, CASE WHEN avg_hr IS NOT NULL THEN round({sql.trimp('d / 60.0::DOUBLE', 'avg_hr')} + 1e-9, 3) END AS trimp, round(l_rpe + 1e-9, 3) AS rpe_load, round(l_power + 1e-9, 3) AS power_load, round(l_pace + 1e-9, 3) AS pace_load, round(l_hr + 1e-9, 3) AS hr_load, round(pw / thr, 3) AS intensity_factor FROM scored WHERE hm > rest"))
def load_by_source(spark, d):
    rows = activities(spark, d).join(profiles(spark, d).drop("group_id"), "user_id", "left")
    hr_max, rest = fl.effective_hr_max(F.col("hr_max"), F.col("age")), fl.effective_hr_rest(F.col("hr_rest"))
    # the activity's own maximum gives way to the athlete's
    rows = rows.withColumns({"hm": hr_max, "rest": rest} | fl.inputs())
    each = fl.scores()
    r = lambda c: F.round(c + 1e-9, 3)
    power = F.coalesce(F.col("normalized_power"), F.col("avg_power"))
    threshold = F.when(F.col("sport") == "bike", F.col("ftp_watts")).when(F.col("sport") == "run", F.col("run_threshold_power_w"))
    return rows.filter("hm > rest").select(
        "activity_id",
        r(fl.trimp(F.col("duration_s") / 60, F.col("avg_hr"), F.col("rest"), F.col("hm"), F.col("sex"))).alias("trimp"),
        r(each["rpe"]).alias("rpe_load"),
        r(each["power"]).alias("power_load"),
        r(each["pace"]).alias("pace_load"),
        r(each["heart_rate"]).alias("hr_load"),
        F.round(power / threshold, 3).alias("intensity_factor"),
    )


@register(sql.query(*sql.CURVE, select="SELECT user_id, day, round(load, 2) AS load, ctl, atl, round(tsb, 2) AS tsb FROM form"))
def form_curve(spark, d):
    return so.form_curve(daily(spark, d)).select("user_id", "day", F.round("load", 2).alias("load"), "ctl", "atl", F.round("tsb", 2).alias("tsb"))


@register(sql.query(*sql.CURVE, select="SELECT user_id, day, round((1 - exp(-1.0::DOUBLE / 42)) * exp(-since / 42.0::DOUBLE) * sum(load * exp(since / 42.0::DOUBLE)) OVER (PARTITION BY user_id ORDER BY n) + 40 * exp(-(since + 1) / 42.0::DOUBLE) + 1e-9, 2) AS ctl, round((1 - exp(-1.0::DOUBLE / 7)) * exp(-since / 7.0::DOUBLE) * sum(load * exp(since / 7.0::DOUBLE)) OVER (PARTITION BY user_id ORDER BY n) + 55 * exp(-(since + 1) / 7.0::DOUBLE) + 1e-9, 2) AS atl FROM numbered"))
def form_resumed(spark, d):
    """From stored state: ctl 40 and atl 55 on the eve of the first day."""
    return so.form_curve(daily(spark, d), 40.0, 55.0).select("user_id", "day", "ctl", "atl")


@register(sql.query(*sql.RATIOS, select="SELECT user_id, DATE '1970-01-01' + CAST(n AS INT) AS day, round(load, 2) AS load FROM dense WHERE n >= (SELECT min(n) FROM numbered x WHERE x.user_id = dense.user_id)"))
def load_dense(spark, d):
    return so.dense(daily(spark, d)).select("user_id", "day", F.round("load", 2).alias("load"))


RATIO_COLUMNS = ["user_id", "day", "acwr", "acwr_zone", "acwr_reliable", "observed_days", "dense_days"]


@register(sql.query(*sql.RATIOS, select="SELECT user_id, day, acwr, acwr_zone, acwr_reliable, observed AS observed_days, CAST(dense_days AS INT) AS dense_days FROM workload"))
def acwr_rolling(spark, d):
    return so.workload(daily(spark, d)).select(*RATIO_COLUMNS)


@register(sql.query(*sql.RATIOS, select="""SELECT user_id, day, CASE WHEN chronic > 0 THEN round(acute / chronic + 1e-9, 3) END AS acwr FROM (
  SELECT x.user_id, x.day, exp(-4) * list_avg(v) + (1 - exp(-1.0::DOUBLE / 7)) * list_sum([v[i] * exp(-(28 - i) / 7.0::DOUBLE) FOR i IN range(1, 29)]) AS acute,
    exp(-1) * list_avg(v) + (1 - exp(-1.0::DOUBLE / 28)) * list_sum([v[i] * exp(-(28 - i) / 28.0::DOUBLE) FOR i IN range(1, 29)]) AS chronic
  FROM numbered x JOIN (SELECT user_id, n, list(load) OVER (PARTITION BY user_id ORDER BY n ROWS 27 PRECEDING) AS v FROM dense) y ON x.user_id = y.user_id AND x.n = y.n)"""))
def acwr_ewma(spark, d):
    return so.acwr_ewma(daily(spark, d)).select("user_id", "day", "acwr")


@register(sql.query(*sql.RATIOS, select="SELECT user_id, day, monotony, strain, ramp_pct, round(week, 2) AS week_load, round(month, 2) AS month_load FROM workload"))
def monotony_strain_ramp(spark, d):
    return so.workload(daily(spark, d)).select("user_id", "day", "monotony", "strain", "ramp_pct", F.round("week_load", 2).alias("week_load"), F.round("month_load", 2).alias("month_load"))


@register("""WITH w AS (SELECT user_id, value, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 29 PRECEDING) AS m, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)
SELECT user_id, count(*) AS samples, round(power(avg(CASE WHEN i >= 30 THEN power(m, 4) END), 0.25), 3) AS normalized_power FROM w GROUP BY user_id""")
def normalised_power(spark, d):
    rows = so.normalised_power(table(spark, d, "events"), "user_id", ["ts", "event_id"])
    return rows.withColumn("normalized_power", F.round("normalized_power", 3))


@register(sql.query(*sql.CURVE, select="SELECT user_id, day, round(sum(load) OVER w, 2) AS rolling_sum, round(avg(load) OVER w, 4) AS rolling_mean FROM numbered WINDOW w AS (PARTITION BY user_id ORDER BY n ROWS 6 PRECEDING)"))
def rolling_load(spark, d):
    rows = daily(spark, d).withColumn("dayno", day_number(F.col("day")))
    w = Window.partitionBy("user_id").orderBy("dayno").rowsBetween(-6, 0)
    return rows.select("user_id", "day", F.round(F.sum("load").over(w), 2).alias("rolling_sum"), F.round(F.avg("load").over(w), 4).alias("rolling_mean"))


@register("""WITH m AS (SELECT user_id, value, median(value) OVER (PARTITION BY user_id) AS med FROM events)
SELECT user_id, count(*) AS n, round(avg(value) + 1e-9, 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS sd, round(median(value), 6) AS median, round(1.4826 * median(abs(value - med)), 6) AS mad,
  round(CASE WHEN avg(value) = 0 THEN 0 ELSE 100 * coalesce(stddev_samp(value), 0) / abs(avg(value)) END, 6) AS cv_pct, round(CASE WHEN avg(value) = 0 THEN 0 ELSE 50 * coalesce(stddev_samp(value), 0) / abs(avg(value)) END, 6) AS swc_pct,
  round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.9), 6) AS p90 FROM m GROUP BY user_id""")
def baseline_stats(spark, d):
    from ..functions.stats import coefficient_of_variation, sd_or_zero

    rows = table(spark, d, "events").select("user_id", "value")
    mid = rows.groupBy("user_id").agg(F.median("value").alias("med"))
    mean, sd = F.avg("value"), sd_or_zero(F.col("value"))
    cv = coefficient_of_variation(mean, sd)
    r = lambda c, name: F.round(c, 6).alias(name)
    # a row for each athlete: small beside the events, but never broadcast by hand
    return rows.join(mid, "user_id").groupBy("user_id").agg(
        F.count("*").alias("n"), r(mean + 1e-9, "mean"), r(sd, "sd"), r(F.median("value"), "median"), r(1.4826 * F.median(F.abs(F.col("value") - F.col("med"))), "mad"), r(cv, "cv_pct"), r(0.5 * cv, "swc_pct"), r(F.percentile("value", 0.1), "p10"), r(F.percentile("value", 0.9), "p90")
    )


@register(sql.query(*sql.CURVE, select="SELECT user_id, day, CASE WHEN count(load) OVER b >= 2 AND stddev_samp(load) OVER b > 1e-9 THEN round((load - avg(load) OVER b) / (stddev_samp(load) OVER b), 4) END AS z FROM numbered WINDOW b AS (PARTITION BY user_id ORDER BY n RANGE BETWEEN 28 PRECEDING AND 1 PRECEDING)"))
def load_z_scores(spark, d):
    from ..functions.stats import z_score

    b = days(-28, -1)
    rows = daily(spark, d).withColumn("dayno", day_number(F.col("day")))
    x = F.col("load")
    return rows.select("user_id", "day", F.round(z_score(x, F.avg(x).over(b), F.stddev_samp(x).over(b), F.count(x).over(b)), 4).alias("z"))


@register("""WITH m AS (SELECT user_id, median(value) AS med FROM events GROUP BY user_id),
s AS (SELECT e.user_id, med, 1.4826 * median(abs(value - med)) AS mad FROM events e JOIN m ON e.user_id = m.user_id GROUP BY ALL)
SELECT event_id, CASE WHEN mad > 1e-9 THEN round((value - med) / mad, 6) END AS robust_z FROM events e JOIN s ON e.user_id = s.user_id""")
def robust_z_scores(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "value")
    mid = rows.groupBy("user_id").agg(F.median("value").alias("med"))
    spread = rows.join(mid, "user_id").groupBy("user_id", "med").agg((1.4826 * F.median(F.abs(F.col("value") - F.col("med")))).alias("mad"))
    return rows.join(spread, "user_id").select("event_id", F.when(F.col("mad") > 1e-9, F.round((F.col("value") - F.col("med")) / F.col("mad"), 6)).alias("robust_z"))


def ready_rows(spark, d):
    return ro.readiness(ro.athlete_days(wellness(spark, d), daily(spark, d)))


@register(sql.query(*sql.READY, select="SELECT user_id, day, readiness, band, data_quality, CASE WHEN data_quality < 0.35 THEN 'insufficient_data' END AS refusal, round(c1 + 1e-9, 1) AS hrv_score, round(c2 + 1e-9, 1) AS resting_hr_score, round(c3 + 1e-9, 1) AS sleep_score, round(c4 + 1e-9, 1) AS subjective_score, round(c5 + 1e-9, 1) AS load_score FROM ready"))
def readiness(spark, d):
    s = lambda n, name: F.round(F.col(f"c_{n}") + 1e-9, 1).alias(name)
    return ready_rows(spark, d).select("user_id", "day", "readiness", "band", "data_quality", "refusal", s("hrv", "hrv_score"), s("resting_hr", "resting_hr_score"), s("sleep", "sleep_score"), s("subjective", "subjective_score"), s("training_load", "load_score"))


@register(sql.query(*sql.READY, select="""SELECT user_id, day, name, round(c + 1e-9, 1) AS score, round(w / q, 3) AS weight, round(w / q * (c - 50) + 1e-9, 2) AS contribution
FROM (SELECT user_id, day, q, unnest(['hrv', 'resting_hr', 'sleep', 'subjective', 'training_load']) AS name, unnest([c1, c2, c3, c4, c5]) AS c, unnest([0.30, 0.15, 0.25, 0.10, 0.20]::DOUBLE[]) AS w FROM ready) WHERE c IS NOT NULL"""))
def readiness_drivers(spark, d):
    return ready_rows(spark, d).select("user_id", "day", F.inline_outer("drivers")).filter("name IS NOT NULL").drop("place")


def risk_rows(spark, d):
    return ro.injury_risk(ready_rows(spark, d), profiles(spark, d))


@register(sql.query(*sql.RISKS, select="SELECT user_id, day, risk, risk_band FROM risk"))
def injury_risk(spark, d):
    return risk_rows(spark, d).select("user_id", "day", "risk", "risk_band")


@register(sql.query(*sql.RISKS, select="""SELECT user_id, day, name, round(v + 1e-9, 3) AS value, round(w * v + 1e-9, 4) AS contribution FROM (
  SELECT user_id, day, unnest(f) AS v, unnest(['acwr_excess', 'ramp_excess', 'monotony_excess', 'sleep_debt_h', 'hrv_suppression', 'resting_hr_elevation', 'prior_injury', 'low_chronic_load', 'training_age', 'age_over_40']) AS name,
    unnest([0.45, 0.30, 0.25, 0.35, 0.30, 0.20, 0.85, 0.55, -0.40, 0.15]::DOUBLE[]) AS w FROM risk) WHERE abs(w * v) > 1e-9"""))
def risk_drivers(spark, d):
    return risk_rows(spark, d).select("user_id", "day", F.inline_outer("risk_drivers")).filter("name IS NOT NULL").drop("place")


_PLANNED = """planned AS (
  SELECT *, CASE WHEN m = 0 THEN NULL ELSE ['vo2max', 'threshold', 'tempo', 'easy', 'recovery'][1 + m % 5] END AS intensity, m % 2 = 0 AS is_key, 30 + m * 7 % 60 AS dur, 40.0::DOUBLE + m * 11 % 90 AS tl
  FROM (SELECT *, (user_id * 3 + date_diff('day', DATE '2024-01-01', day)) % 11 AS m FROM risk)
), costs AS (SELECT *, CASE intensity WHEN 'recovery' THEN 36 WHEN 'easy' THEN 49 WHEN 'tempo' THEN 72 WHEN 'threshold' THEN 96 WHEN 'vo2max' THEN 117 END::DOUBLE AS ph FROM planned
), gated AS (SELECT *, CASE WHEN intensity IS NULL THEN 'none' WHEN data_quality < 0.35 THEN 'keep' WHEN readiness < 25 THEN 'rest' WHEN readiness < 50 THEN 'easy'
    WHEN readiness < 70 AND is_key AND intensity <> 'easy' THEN 'down' WHEN readiness < 70 THEN 'volume' WHEN risk_band = 'very_high' AND intensity IN ('vo2max', 'threshold') THEN 'cap' ELSE 'keep' END AS g,
    CASE intensity WHEN 'vo2max' THEN 'threshold' WHEN 'threshold' THEN 'tempo' WHEN 'tempo' THEN 'easy' ELSE intensity END AS lower,
    CASE intensity WHEN 'vo2max' THEN 96 WHEN 'threshold' THEN 72 WHEN 'tempo' THEN 49 ELSE ph END::DOUBLE AS lower_ph FROM costs)"""


@register(sql.query(*sql.RISKS, _PLANNED, select="""SELECT user_id, day,
  CASE g WHEN 'none' THEN 'rest' WHEN 'keep' THEN 'as_planned' WHEN 'rest' THEN 'rest' WHEN 'easy' THEN 'easy_only' WHEN 'volume' THEN 'reduce_volume' ELSE 'reduce_intensity' END AS action,
  CASE g WHEN 'keep' THEN intensity WHEN 'easy' THEN 'easy' WHEN 'down' THEN lower WHEN 'volume' THEN intensity WHEN 'cap' THEN 'tempo' END AS new_intensity,
  CASE g WHEN 'keep' THEN dur WHEN 'easy' THEN greatest(20, floor(dur * 0.6::DOUBLE)) WHEN 'down' THEN greatest(20, floor(dur * 0.9::DOUBLE)) WHEN 'volume' THEN greatest(20, floor(dur * 0.8::DOUBLE)) WHEN 'cap' THEN greatest(20, floor(dur * 0.85::DOUBLE)) END::BIGINT AS new_duration_min,
  CASE g WHEN 'keep' THEN tl WHEN 'easy' THEN round(tl * 0.5 + 1e-9, 1) WHEN 'down' THEN round(tl * lower_ph / ph + 1e-9, 1) WHEN 'volume' THEN round(tl * 0.8::DOUBLE + 1e-9, 1) WHEN 'cap' THEN round(tl * 72 / ph + 1e-9, 1) END AS new_load FROM gated"""))
def adapt_today(spark, d):
    return ro.adapt_today(planned_rows(spark, d)).select("user_id", "day", "action", "new_intensity", F.col("new_duration_min").cast("bigint").alias("new_duration_min"), "new_load")


def planned_rows(spark, d) -> DataFrame:
    """A planned session, or none, for each athlete and day with readiness and risk."""
    m = (F.col("user_id") * 3 + F.datediff("day", F.lit("2024-01-01").cast("date"))) % 11
    kinds = F.array(*(F.lit(x) for x in ("vo2max", "threshold", "tempo", "easy", "recovery")))
    rows = risk_rows(spark, d).withColumn("m", m)
    m = F.col("m")
    return rows.withColumns({"intensity": F.when(m != 0, F.get(kinds, (m % 5).cast("int"))), "is_key": m % 2 == 0, "duration_min": (30 + m * 7 % 60).cast("int"), "target_load": (40 + m * 11 % 90).cast("double")})
