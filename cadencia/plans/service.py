"""What the service around the engine asks: checks of rows and requests, redaction, queues, outcomes, challenges and use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import load as fl
from ..functions import validation as fv
from ..operators import readiness as ro
from ..operators import relational as rel
from ..sources import provider as pv
from ..sources import sinks
from ..sources.bridge import profiles, table
from . import sql, training

SPARK: dict = {}
ORACLE: dict[str, str] = {}


def register(oracle: str | None = None):
    def add(f):
        SPARK[f.__name__] = f
        if oracle is not None:
            ORACLE[f.__name__] = oracle
        return f

    return add


def text(c):
    return c.cast("string")


def pick(key, *values):
    """values[key % n]."""
    return F.get(F.array(*(F.lit(v) for v in values)), (key % len(values)).cast("int"))


# Keys of a log line, and those of them that must not show.
_HIDDEN = "user_email athlete_email HRV heart_rate resting_hr_7d sleep_score weight_kg readiness injury_note display_name account_number auth_token Session_Id destination_ref".split()
_SHOWN = "token_family_id refresh_token_id user_id ACTOR_USER_ID subject_user_id request_id status".split()
_KEYS = ", ".join(f"'{x}'" for x in (*_HIDDEN, *_SHOWN))


@register(f"SELECT event_id, key, CASE WHEN key IN ({', '.join(repr(x) for x in _HIDDEN)}) THEN '[redacted]' ELSE 'v' || event_id END AS value FROM events, (SELECT unnest([{_KEYS}]) AS key)")
def redaction(spark, d):
    value = F.concat(F.lit("v"), text(F.col("event_id")))
    line = F.create_map(*(x for k in (*_HIDDEN, *_SHOWN) for x in (F.lit(k), value)))
    return table(spark, d, "events").select("event_id", F.explode(rel.redacted(line)).alias("key", "value"))


@register("""SELECT event_id, key, CASE key WHEN 'session_id' THEN '[redacted]' WHEN 'profile' THEN '{"weight_kg":"[redacted]","level":"l' || event_id % 3 || '"}' ELSE '{"user_id":"u' || user_id || '","phone_no":"[redacted]"}' END AS value FROM events, (SELECT unnest(['profile', 'session_id', 'actor']) AS key)""")
def redaction_nested(spark, d):
    """One level of nesting is scrubbed too."""
    e, u = text(F.col("event_id")), F.concat(F.lit("u"), text(F.col("user_id")))
    inner = lambda *x: F.create_map(*(F.lit(y) if isinstance(y, str) else y for y in x))
    level = F.concat(F.lit("l"), text(F.col("event_id") % 3))
    line = F.create_map(F.lit("profile"), inner("weight_kg", e, "level", level), F.lit("session_id"), inner("a", e), F.lit("actor"), inner("user_id", u, "phone_no", e))
    return table(spark, d, "events").select("event_id", F.explode(rel.redacted_nested(line)).alias("key", "value"))


def codes(checks):
    return F.array_join(fv.failed(checks), ",").alias("failed")


def _codes(*cases: tuple[str, str]) -> str:
    """SQL of the codes whose condition fails, in order."""
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {bad} THEN '{code}' END" for code, bad in cases) + "], lambda x: x IS NOT NULL), ',') AS failed"


@register(
    "SELECT event_id, "
    + _codes(
        ("avg_hr", "avg_hr NOT BETWEEN 20 AND 250"), ("avg_power", "avg_power < 0"), ("distance_m", "distance_m < 0"), ("duration_missing", "duration_s IS NULL"), ("duration_s", "duration_s <= 0 OR duration_s >= 604800"),
        ("hr_order", "max_hr < avg_hr"), ("max_hr", "max_hr NOT BETWEEN 20 AND 250"), ("moving_order", "moving_time_s > duration_s"), ("moving_time_s", "moving_time_s <= 0"), ("pool_length_m", "pool_length_m <= 0"),
        ("rpe", "rpe NOT BETWEEN 1 AND 10"), ("total_strokes", "total_strokes < 0"), ("trust_score", "trust_score > 1"),
    )
    + """ FROM (SELECT event_id, CASE WHEN event_id % 17 <> 0 THEN event_id * 977 % 700000 - 5 END AS duration_s, event_id * 31 % 700000 - 3 AS moving_time_s, event_id % 2000 - 10 AS distance_m, 10 + event_id % 260 AS avg_hr, 15 + event_id * 7 % 260 AS max_hr,
  event_id % 50 - 2 AS avg_power, event_id % 12 AS rpe, (event_id % 13) / 10.0::DOUBLE AS trust_score, CASE WHEN event_id % 3 = 0 THEN event_id % 4 - 1 END AS pool_length_m, event_id % 9 - 1 AS total_strokes FROM events)"""
)
def activity_checks(spark, d):
    e = F.col("event_id")
    rows = table(spark, d, "events").select(
        e, F.when(e % 17 != 0, e * 977 % 700000 - 5).alias("duration_s"), (e * 31 % 700000 - 3).alias("moving_time_s"), (e % 2000 - 10).alias("distance_m"), (10 + e % 260).alias("avg_hr"), (15 + e * 7 % 260).alias("max_hr"),
        (e % 50 - 2).alias("avg_power"), (e % 12).alias("rpe"), (e % 13 / 10.0).alias("trust_score"), F.when(e % 3 == 0, e % 4 - 1).alias("pool_length_m"), (e % 9 - 1).alias("total_strokes"),
    )
    return rows.select("event_id", codes(fv.activity_checks(rows.columns)))


@register(
    "SELECT event_id, "
    + _codes(
        ("body_weight_kg", "kg NOT BETWEEN 25 AND 350"), ("hrv_rmssd_ms", "hrv <= 0 OR hrv >= 400"), ("resting_hr", "rhr NOT BETWEEN 25 AND 140"), ("sleep_deep_min", "deep < 0"), ("sleep_efficiency_pct", "eff NOT BETWEEN 0 AND 100"),
        ("sleep_order", "deep > total"), ("sleep_total_min", "total NOT BETWEEN 0 AND 1200"), ("soreness", "soreness NOT BETWEEN 1 AND 5"), ("spo2_pct", "spo2 NOT BETWEEN 50 AND 100"),
    )
    + " FROM (SELECT event_id, event_id % 450 - 5 AS hrv, 20 + event_id % 130 AS rhr, event_id * 7 % 1300 - 20 AS total, event_id * 3 % 700 - 4 AS deep, event_id % 120 - 5 AS eff, 45 + event_id % 60 AS spo2, event_id % 7 AS soreness, 20 + event_id % 340 AS kg FROM events)"
)
def wellness_checks(spark, d):
    e = F.col("event_id")
    rows = table(spark, d, "events").select(
        e, (e % 450 - 5).alias("hrv_rmssd_ms"), (20 + e % 130).alias("resting_hr"), (e * 7 % 1300 - 20).alias("sleep_total_min"), (e * 3 % 700 - 4).alias("sleep_deep_min"), (e % 120 - 5).alias("sleep_efficiency_pct"),
        (45 + e % 60).alias("spo2_pct"), (e % 7).alias("soreness"), (20 + e % 340).alias("body_weight_kg"),
    )
    return rows.select("event_id", codes(fv.wellness_checks(rows.columns)))


@register(
    "SELECT user_id, "
    + _codes(
        ("birth_date", "date_diff('day', born, DATE '2024-01-30') / 365.25::DOUBLE NOT BETWEEN 13 AND 110"), ("ftp_watts", "ftp NOT BETWEEN 30 AND 800"), ("height_cm", "cm NOT BETWEEN 80 AND 260"), ("hr_max", "hm NOT BETWEEN 100 AND 240"),
        ("hr_order", "hm <= hr"), ("hr_rest", "hr NOT BETWEEN 25 AND 120"), ("level", "level = 'elite'"), ("lthr", "lthr NOT BETWEEN 80 AND 230"), ("threshold_sources", "source = 'guess'"), ("vo2max", "vo2 NOT BETWEEN 15 AND 100"), ("weight_kg", "kg NOT BETWEEN 25 AND 350"),
    )
    + """ FROM (SELECT c_custkey AS user_id, DATE '1910-01-01' + CAST(c_custkey * 37 % 42000 AS INT) AS born, 70 + c_custkey % 200 AS cm, 20 + c_custkey % 340 AS kg, 90 + c_custkey % 160 AS hm, 20 + c_custkey * 3 % 110 AS hr, 70 + c_custkey % 170 AS lthr,
  20 + c_custkey * 7 % 800 AS ftp, 10 + c_custkey % 95 AS vo2, ['beginner', 'intermediate', 'advanced', 'elite'][1 + c_custkey % 4] AS level, ['tested', 'estimated', 'guess'][1 + c_custkey % 3] AS source FROM customer)"""
)
def profile_checks(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(
        k.alias("user_id"), F.date_add(F.lit("1910-01-01").cast("date"), (k * 37 % 42000).cast("int")).alias("birth_date"), (70 + k % 200).alias("height_cm"), (20 + k % 340).alias("weight_kg"), (90 + k % 160).alias("hr_max"),
        (20 + k * 3 % 110).alias("hr_rest"), (70 + k % 170).alias("lthr"), (20 + k * 7 % 800).alias("ftp_watts"), (10 + k % 95).alias("vo2max"), pick(k, "beginner", "intermediate", "advanced", "elite").alias("level"),
        F.create_map(F.lit("ftp_watts"), pick(k, "tested", "estimated", "guess")).alias("threshold_sources"),
    )
    return rows.select("user_id", codes(fv.profile_checks(rows.columns, F.lit("2024-01-30").cast("date"))))


@register(
    "SELECT goal_id, "
    + _codes(("priority", "priority NOT BETWEEN 1 AND 3"), ("race_time", "kind = 'race_time' AND (value IS NULL OR race IS NULL)"), ("target_distance_m", "dist <= 0 OR dist > 1000000"), ("target_value", "value <= 0"))
    + " FROM (SELECT o_orderkey AS goal_id, CASE WHEN o_orderkey % 2 = 0 THEN 'race_time' ELSE 'distance' END AS kind, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 50 - 1 END AS value, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS race, o_orderkey * 1009 % 1200000 - 100 AS dist, o_orderkey % 5 AS priority FROM orders)"
)
def goal_checks(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(
        k.alias("goal_id"), F.when(k % 2 == 0, "race_time").otherwise("distance").alias("goal_type"), F.when(k % 3 != 0, k % 50 - 1).alias("target_value"), F.when(k % 5 != 0, F.to_date("o_orderdate")).alias("race_date"),
        (k * 1009 % 1200000 - 100).alias("target_distance_m"), (k % 5).alias("priority"),
    )
    return rows.select("goal_id", codes(fv.goal_checks(rows.columns)))


@register(
    "SELECT best_id, "
    + _codes(("achieved_on", "done > DATE '1998-01-01'"), ("distance_m", "dist <= 0 OR dist > 1000000"), ("speed", "dist / t::DOUBLE > CASE sport WHEN 'run' THEN 13 WHEN 'bike' THEN 30 WHEN 'swim' THEN 3 WHEN 'other' THEN 30 END"), ("sport", "sport = 'yoga'"), ("time_s", "t <= 0 OR t > 1000000"))
    + " FROM (SELECT o_orderkey AS best_id, ['run', 'bike', 'swim', 'other', 'yoga'][1 + o_orderkey % 5] AS sport, o_orderkey * 13 % 60000 - 20 AS dist, 1 + o_orderkey * 7 % 9000 AS t, o_orderdate::DATE AS done FROM orders)"
)
def personal_best_checks(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k.alias("best_id"), pick(k, "run", "bike", "swim", "other", "yoga").alias("sport"), (k * 13 % 60000 - 20).alias("distance_m"), (1 + k * 7 % 9000).alias("time_s"), F.to_date("o_orderdate").alias("achieved_on"))
    return rows.select("best_id", codes(fv.personal_best_checks(F.lit("1998-01-01").cast("date"))))


@register("""SELECT event_id, unnest(list_filter([CASE WHEN event_id % 2 <> 0 THEN 'pending_events' END, CASE WHEN event_id % 3 = 1 THEN 'active_plans' END, CASE WHEN event_id % 4 = 0 AND event_id % 5 <> 0 THEN 'unscored_activities' END,
  CASE WHEN event_id % 6 = 0 THEN 'unverified_streams' END, CASE WHEN event_id % 2 = 1 THEN 'pending_review' END, CASE WHEN event_id % 5 < 3 THEN 'due_renewals' END, CASE WHEN event_id % 7 = 0 THEN 'unverified_webhooks' END,
  CASE WHEN event_id % 8 <> 0 AND event_id % 9 <> 0 THEN 'live_entitlements' END, CASE WHEN event_id % 10 = 0 THEN 'open_fraud' END], lambda x: x IS NOT NULL)) AS queue FROM events""")
def work_queues(spark, d):
    """All nine, in one pass."""
    e, ts = F.col("event_id"), F.col("ts")
    rows = table(spark, d, "events").select(
        e, F.when(e % 2 == 0, ts).alias("processed_at"), pick(e, "draft", "active", "done").alias("plan_status"), F.when(e % 4 != 0, 0.5).alias("trust_score"), F.when(e % 5 == 0, ts).alias("deleted_at"),
        F.when(e % 6 != 0, ts).alias("checksum_verified_at"), pick(e, "open", "pending_review").alias("resolution"), pick(e, "trialing", "active", "grace", "lapsed", "canceled").alias("subscription_status"),
        (e % 7 != 0).alias("signature_verified"), F.when(e % 8 == 0, ts).alias("revoked_at"), F.when(e % 9 != 0, ts).alias("expires_at"), F.when(e % 10 != 0, ts).alias("resolved_at"),
    )
    return rows.select("event_id", F.explode(rel.queues_of()).alias("queue"))


@register("""WITH g AS (SELECT n_nationkey AS group_id, ['public', 'org_only', 'private'][1 + n_nationkey % 3] AS visibility, n_regionkey AS org_id, n_nationkey * 5 AS owner FROM nation)
SELECT group_id FROM g WHERE visibility = 'public' OR owner = 7 OR (visibility = 'org_only' AND org_id = 2) OR EXISTS (SELECT 1 FROM customer WHERE c_nationkey = group_id AND c_custkey IN (7, 8) AND c_custkey % 8 <> 0)""")
def visible_groups(spark, d):
    """Groups that are public, one's own, one's organisation's, or that one is a member of and hasn't left."""
    k = F.col("n_nationkey")
    groups = table(spark, d, "nation").select(k.alias("group_id"), pick(k, "public", "org_only", "private").alias("visibility"), F.col("n_regionkey").alias("org_id"), (k * 5).alias("owner"))
    members = table(spark, d, "customer").filter("c_custkey IN (7, 8)").select(F.col("c_nationkey").alias("group_id"), F.when(F.col("c_custkey") % 8 == 0, F.lit("2024-01-01")).alias("left_at"))
    mine = members.filter("left_at IS NULL").select("group_id").distinct().withColumn("member", F.lit(True))
    seen = (F.col("visibility") == "public") | (F.col("owner") == 7) | ((F.col("visibility") == "org_only") & (F.col("org_id") == 2)) | F.coalesce("member", F.lit(False))
    return groups.join(mine, "group_id", "left").filter(seen).select("group_id")


@register("""SELECT c_custkey AS id, (DATE '2024-01-30' - CAST(c_custkey % 20 AS INT) + i::INT)::DATE AS window_start, (DATE '2024-01-30' - CAST(c_custkey % 20 AS INT) + i::INT + 1)::DATE AS window_end, 'activity_summary' AS task, 'backfill' AS priority
FROM (SELECT c_custkey, unnest(range(c_custkey % 20)) AS i FROM customer)""")
def backfill_days(spark, d):
    """A history import in windows of one day each."""
    until = F.lit("2024-01-30").cast("date")
    imports = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), until.alias("until"), F.date_sub(until, (F.col("c_custkey") % 20).cast("int")).alias("since"))
    return pv.backfill_days(imports).select("id", "window_start", "window_end", "task", "priority")


@register("""SELECT user_id, count(*) FILTER (s = 'done') AS done, count(*) FILTER (s IN ('pending', 'running')) AS "open", count(*) FILTER (s = 'failed' AND a < 3) AS to_retry, count(*) FILTER (s = 'failed' AND a >= 3) AS given_up, CAST(sum(a) AS BIGINT) AS attempts
FROM (SELECT o_custkey AS user_id, ['pending', 'running', 'done', 'failed'][1 + o_orderkey % 4] AS s, o_orderkey % 5 AS a FROM orders) GROUP BY user_id""")
def import_progress(spark, d):
    k = F.col("o_orderkey")
    chunks = table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), k.alias("chunk"), pick(k, "pending", "running", "done", "failed").alias("status"), (k % 5).alias("attempts"))
    return sinks.import_progress(chunks, ["user_id"])


@register("""SELECT best_id, sport, distance_m FROM (SELECT o_orderkey AS best_id, ['run', 'bike', 'swim'][1 + o_orderkey % 3] AS sport, (1 + o_orderkey % 5) * 1000 AS distance_m FROM orders WHERE o_custkey = 7) WHERE sport IN ('run', 'bike') ORDER BY sport, distance_m, best_id""")
def personal_best_list(spark, d):
    """One athlete's bests in two sports, by sport and distance."""
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").filter("o_custkey = 7").select(k.alias("best_id"), pick(k, "run", "bike", "swim").alias("sport"), ((1 + k % 5) * 1000).alias("distance_m"))
    return rows.filter("sport IN ('run', 'bike')").orderBy("sport", "distance_m", "best_id")


@register("""SELECT event_id * 7919 % 5000 AS device_id, count(DISTINCT user_id) AS users, count(*) AS sessions FROM events GROUP BY 1 HAVING count(DISTINCT user_id) > 1""")
def fraud_shared_devices(spark, d):
    """Devices that several accounts use."""
    rows = table(spark, d, "events").select("user_id", (F.col("event_id") * 7919 % 5000).alias("device_id"))
    return rel.shared_devices(rows)


@register("""SELECT event_id, CASE WHEN p > 0 THEN round(1000.0::DOUBLE / p + 1e-9, 6) END AS speed_m_s, CASE WHEN p > 0 THEN round(p::DOUBLE + 1e-9, 6) END AS pace_s_per_km FROM (SELECT event_id, event_id % 400 - 5 AS p FROM events)""")
def pace_and_speed(spark, d):
    rows = table(spark, d, "events").select("event_id", pv.pace_to_speed(F.col("event_id") % 400 - 5).alias("speed_m_s"))
    return rows.select("event_id", F.round(F.col("speed_m_s") + 1e-9, 6).alias("speed_m_s"), F.round(pv.speed_to_pace(F.col("speed_m_s")) + 1e-9, 6).alias("pace_s_per_km"))


@register("""WITH x AS (SELECT event_id, 1704067200000 + event_id * 1000 AS ms, 28672 + (event_id % 5000) % 4096 AS ver, ((event_id % 100000) * 7919 * 10000000019) % 4611686018427387904 AS r FROM events),
h AS (SELECT *, format('{:012x}', ms) || format('{:04x}', ver) || format('{:x}', 8 + r // 1152921504606846976) || substr(format('{:016x}', r), 2, 15) AS h FROM x)
SELECT event_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS uuid, ms FROM h""")
def uuid_ids(spark, d):
    """Time-ordered ids made from a time, a counter and a random number, and the time read back."""
    e = F.col("event_id")
    uuid = rel.uuid7(F.lit(1704067200000) + e * 1000, e % 5000, e % 100000 * 7919 * F.lit(10000000019))
    return table(spark, d, "events").select("event_id", uuid.alias("uuid")).withColumn("ms", rel.uuid7_milliseconds(F.col("uuid")))


_OUTCOMES = """predictions AS (SELECT o_orderkey AS prediction_id, o_custkey AS user_id, ['race_time', 'ctl'][1 + o_orderkey % 2] AS metric, 'v' || o_orderkey % 3 AS version, o_totalprice::DOUBLE * ((90 + o_orderkey % 21) / 100.0::DOUBLE) AS predicted FROM orders),
outcomes AS (SELECT p.*, abs(o_totalprice::DOUBLE - predicted) AS err, o_totalprice::DOUBLE AS actual, o_totalprice::DOUBLE BETWEEN predicted * 0.95::DOUBLE AND predicted * 1.05::DOUBLE AS hit FROM predictions p JOIN orders ON o_orderkey = prediction_id WHERE o_orderkey % 4 <> 0)"""


def outcome_rows(spark, d) -> DataFrame:
    """Predictions with the outcomes that are there, three of four."""
    k, price = F.col("o_orderkey"), F.col("o_totalprice").cast("double")
    orders = table(spark, d, "orders")
    made = orders.select(k.alias("prediction_id"), F.col("o_custkey").alias("user_id"), pick(k, "race_time", "ctl").alias("metric"), F.concat(F.lit("v"), text(k % 3)).alias("version"), (price * ((90 + k % 21) / 100.0)).alias("predicted_value"))
    made = made.withColumns({"interval_low": F.col("predicted_value") * 0.95, "interval_high": F.col("predicted_value") * 1.05})
    return rel.outcomes(made, orders.filter(k % 4 != 0).select(k.alias("prediction_id"), price.alias("actual_value")))


@register(f"WITH {_OUTCOMES} SELECT prediction_id, round(err + 1e-9, 3) AS absolute_error, round(100 * err / abs(actual) + 1e-9, 4) AS percent_error, hit AS within_interval FROM outcomes")
def prediction_outcomes(spark, d):
    return outcome_rows(spark, d).select("prediction_id", F.round(F.col("absolute_error") + 1e-9, 3).alias("absolute_error"), F.round(F.col("percent_error") + 1e-9, 4).alias("percent_error"), "within_interval")


@register(f"WITH {_OUTCOMES} SELECT metric, version, count(*) AS n, round(avg(err), 2) AS mae, round(avg(hit::INT), 6) AS coverage FROM outcomes GROUP BY ALL")
def prediction_accuracy(spark, d):
    return rel.accuracy(outcome_rows(spark, d), ["metric", "version"])


@register(f"""WITH {_OUTCOMES}, v AS (SELECT DISTINCT user_id, CAST(('0x' || substr(md5('exp1:' || user_id), 1, 8))::UBIGINT % 3 AS INT) AS variant FROM (SELECT user_id FROM outcomes UNION SELECT user_id FROM events)),
a AS (SELECT variant, count(*) AS n, round(avg(err), 2) AS mae, round(avg(hit::INT), 6) AS coverage FROM outcomes o JOIN v ON o.user_id = v.user_id GROUP BY variant),
f AS (SELECT variant, round(avg(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END), 6) AS thumbs_up FROM events e JOIN v ON e.user_id = v.user_id WHERE event_type IN ('click', 'view') GROUP BY variant)
SELECT coalesce(a.variant, f.variant) AS variant, n, mae, coverage, thumbs_up FROM a FULL JOIN f ON a.variant = f.variant""")
def variant_comparison(spark, d):
    """Error, calibration and feedback of each variant of an experiment; an athlete's variant is a digest's."""
    own = rel.variant(F.col("user_id"), "exp1", 3).alias("variant")
    made = rel.accuracy(outcome_rows(spark, d).select(own, "absolute_error", "within_interval"), ["variant"])
    said = table(spark, d, "events").filter("event_type IN ('click', 'view')").select(own, (F.col("event_type") == "click").cast("int").alias("up"))
    return made.join(said.groupBy("variant").agg(F.round(F.avg("up"), 6).alias("thumbs_up")), "variant", "full").select("variant", "n", "mae", "coverage", "thumbs_up")


@register(sql.query(*sql.LOADS, select="""SELECT m.*, streak_days FROM (SELECT user_id, round(sum(dist), 3) AS distance, sum(d) AS duration, round(sum(gain), 3) AS elevation, round(sum(load), 2) AS load, count(*) AS session_count, max(d) AS best_duration, round(max(dist), 3) AS best_distance, round(max(load), 2) AS best_load FROM sessions WHERE user_id % 13 <> 0 GROUP BY user_id) m
JOIN (SELECT user_id, max(n) AS streak_days FROM (SELECT user_id, count(*) AS n FROM (SELECT user_id, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INT) AS g FROM daily) GROUP BY user_id, g) GROUP BY user_id) s ON m.user_id = s.user_id"""))
def challenge_metrics(spark, d):
    """Every metric that a challenge may be about, summed and at its best, without the disqualified."""
    rows = training.sessions(spark, d).filter("user_id % 13 <> 0")
    return rel.challenge_metrics(rows).select(
        "user_id", F.round("distance", 3).alias("distance"), "duration", F.round("elevation", 3).alias("elevation"), F.round("load", 2).alias("load"), "session_count", "best_duration", F.round("best_distance", 3).alias("best_distance"), F.round("best_load", 2).alias("best_load"), "streak_days"
    )


@register("""SELECT conv_id % 50 AS user_id, date_trunc('month', DATE '2024-01-01' + CAST(conv_id % 120 AS INT))::DATE AS month, role, count(*) AS messages, CAST(sum(ceil(length(coalesce(text, '')) / 4.0)) AS BIGINT) AS tokens, CAST(sum(ceil(length(coalesce(text, '')) / 4.0) * CASE role WHEN 'assistant' THEN 15 ELSE 3 END) AS BIGINT) AS cost_micro FROM conversations GROUP BY ALL""")
def ai_usage(spark, d):
    """Messages, tokens and cost by user and month."""
    tokens = F.ceil(F.length(F.coalesce("text", F.lit(""))) / 4)
    price = F.when(F.col("role") == "assistant", 15).otherwise(3)
    month = F.to_date(F.date_trunc("month", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 120).cast("int"))))
    return table(spark, d, "conversations").groupBy((F.col("conv_id") % 50).alias("user_id"), month.alias("month"), "role").agg(F.count("*").alias("messages"), F.sum(tokens).cast("bigint").alias("tokens"), F.sum(tokens * price).cast("bigint").alias("cost_micro"))


@register(sql.query(*sql.LOADS, select="""SELECT e AS activity_id, key, value FROM (SELECT e, unnest(CASE source WHEN 'power' THEN ['intensity_factor', 'power_used_w'] WHEN 'heart_rate' THEN ['avg_hr'] WHEN 'pace' THEN [CASE sport WHEN 'swim' THEN 'pace_s_per_100m' ELSE 'pace_s_per_km' END] WHEN 'rpe' THEN ['rpe'] END) AS key,
  unnest(CASE source WHEN 'power' THEN [round(pw / thr + 1e-9, 3), round(pw + 1e-9, 1)] WHEN 'heart_rate' THEN [round(avg_hr + 1e-9, 1)] WHEN 'pace' THEN [round(CASE sport WHEN 'swim' THEN 100 ELSE 1000 END * act / dist + 1e-9, 1)] WHEN 'rpe' THEN [rpe] END) AS value FROM sessions)"""))
def load_details(spark, d):
    """What each session's score was made of."""
    return training.sessions(spark, d).select("activity_id", F.explode_outer("load_detail").alias("key", "value")).filter("key IS NOT NULL")


@register("""SELECT event_id, round(CASE WHEN m <= 0 AND rpe <> 0 THEN 0 WHEN rpe BETWEEN 1 AND 10 THEN m * rpe * (100.0::DOUBLE / 420) END + 1e-9, 6) AS rpe_load, round(100 * (greatest(m, 0) * 60 / 3600.0::DOUBLE) * power(nullif(w, 0) / 250.0::DOUBLE, 2) + 1e-9, 6) AS power_load
FROM (SELECT event_id, event_id % 50 - 5 AS m, event_id % 13 AS rpe, event_id % 300 AS w FROM events)""")
def load_checks(spark, d):
    """Loads of sessions of no length, and of efforts out of range."""
    e = F.col("event_id")
    r = lambda c: F.round(c + 1e-9, 6)
    minutes = e % 50 - 5
    return table(spark, d, "events").select(e, r(fl.rpe_load(minutes, e % 13)).alias("rpe_load"), r(fl.power_load(minutes * 60, e % 300, F.lit(250.0))).alias("power_load"))


@register(sql.query(*sql.RISKS, select="SELECT user_id, day, round(least(1, 0.02::DOUBLE * list_sum(f)) + 1e-9, 4) AS risk FROM risk"))
def injury_risk_other_model(spark, d):
    """The same features under another model."""
    other = lambda f: F.least(F.lit(1.0), F.lit(0.02) * sum(f.values(), F.lit(0.0)))
    return ro.injury_risk(training.ready_rows(spark, d), profiles(spark, d), other).select("user_id", "day", "risk")


_REASONS = """driven AS (SELECT *, coalesce(list_sort(list_filter([{a: -abs(round(0.30::DOUBLE / q * (c1 - 50) + 1e-9, 2)), i: 1, n: 'hrv'}, {a: -abs(round(0.15::DOUBLE / q * (c2 - 50) + 1e-9, 2)), i: 2, n: 'resting_hr'}, {a: -abs(round(0.25::DOUBLE / q * (c3 - 50) + 1e-9, 2)), i: 3, n: 'sleep'},
  {a: -abs(round(0.10::DOUBLE / q * (c4 - 50) + 1e-9, 2)), i: 4, n: 'subjective'}, {a: -abs(round(0.20::DOUBLE / q * (c5 - 50) + 1e-9, 2)), i: 5, n: 'training_load'}], lambda x: x.a IS NOT NULL))[1].n, 'recovery data') AS top, 'Readiness ' || CAST(round_even(readiness, 0) AS INT) || '/100' AS said,
  CASE g WHEN 'keep' THEN intensity WHEN 'easy' THEN 'easy' WHEN 'down' THEN lower WHEN 'volume' THEN intensity WHEN 'cap' THEN 'tempo' END AS new_intensity FROM gated)"""


@register(sql.query(*sql.RISKS, training._PLANNED, _REASONS, select="""SELECT user_id, day, CASE g WHEN 'none' THEN 'No session scheduled today.' WHEN 'keep' THEN CASE WHEN data_quality < 0.35 THEN 'Not enough recovery data this morning to adjust — keeping the plan as written.' ELSE said || ' (' || band || '). Go as planned.' END
  WHEN 'rest' THEN said || ' (' || band || '), driven by ' || top || '. Full rest today.' WHEN 'easy' THEN said || ', limited by ' || top || '. Aerobic only today; the quality work moves.' WHEN 'down' THEN said || ', held back by ' || top || '. One intensity band down.'
  WHEN 'volume' THEN said || ', held back by ' || top || '. Volume trimmed 20%.' ELSE 'Recovery looks fine, but your recent load pattern is in the elevated-risk band — capping today''s intensity as a precaution.' END AS reason,
  CASE new_intensity WHEN 'recovery' THEN 'Zone 1 only. If it does not feel easy, stop.' WHEN 'easy' THEN 'Zone 2. Conversational the whole way.' WHEN 'tempo' THEN 'Zone 3 blocks with full warm-up and cool-down.' WHEN 'threshold' THEN 'Zone 4 intervals. Hold the pace, do not race it.' WHEN 'vo2max' THEN 'Zone 5 intervals with full recoveries between reps.' END AS new_notes FROM driven"""))
def adapt_reasons(spark, d):
    """Why today's session is as it is, with its largest driver, and the notes that go with it."""
    return ro.adapt_today(training.planned_rows(spark, d)).select("user_id", "day", "reason", "new_notes")


@register(sql.query(*sql.CURVE, select="""SELECT user_id, day, round(w7 - w28, 6) AS trend, round(w28 - before, 6) AS change_28 FROM (SELECT user_id, day, avg(load) OVER (PARTITION BY user_id ORDER BY n RANGE BETWEEN 6 PRECEDING AND CURRENT ROW) AS w7, avg(load) OVER (PARTITION BY user_id ORDER BY n RANGE BETWEEN 27 PRECEDING AND CURRENT ROW) AS w28,
  avg(load) OVER (PARTITION BY user_id ORDER BY n RANGE BETWEEN 55 PRECEDING AND 28 PRECEDING) AS before FROM numbered)"""))
def load_trend(spark, d):
    """The week against four weeks, and four weeks against the four before."""
    from ..functions.stats import day_number, days

    rows = training.daily(spark, d).withColumn("dayno", day_number(F.col("day")))
    mean = lambda a, b: F.avg("load").over(days(a, b))
    return rows.select("user_id", "day", F.round(mean(-6, 0) - mean(-27, 0), 6).alias("trend"), F.round(mean(-27, 0) - mean(-55, -28), 6).alias("change_28"))



