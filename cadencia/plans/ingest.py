"""Provider payloads to typed rows, their quality and trust, and the bookkeeping of imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quality as fq
from ..sources import provider as pv
from ..sources import synthetic
from ..sources.bridge import activities, table

SPARK: dict = {}
ORACLE: dict[str, str] = {}


def register(oracle: str | None = None):
    def add(f):
        SPARK[f.__name__] = f
        if oracle is not None:
            ORACLE[f.__name__] = oracle
        return f

    return add


def payloads(spark, d) -> DataFrame:
    return payloads_of(table(spark, d, "events"))


def payloads_of(events: DataFrame) -> DataFrame:
    """An event as a body: some lack an id, a duration or a valid form, some are lists, some begin before 2000."""
    e = F.col("event_id")
    s = lambda c: c.cast("string")
    name = F.get(F.array(*(F.lit(x) for x in ("RUNNING", " cycling ", "LAP_SWIMMING", "yoga", "surfing", "triathlon"))), (e % 6).cast("int"))
    epoch = F.when(e % 31 == 0, 900000000 + e).otherwise(1700000000 + e * 977)
    lap = lambda k: F.concat(F.lit('{"durationInSeconds":'), s((e * k) % 400 - 40), F.lit(',"averageHeartRateInBeatsPerMinute":'), s(100 + e * k % 200), F.lit("}"))
    body = F.concat(
        F.when(e % 17 == 0, '{"userId":"u').otherwise(F.concat(F.lit('{"summaryId":"s'), s(e), F.lit('","userId":"u'))), s(F.col("user_id")), F.lit('","activityType":"'), name,
        F.lit('","startTimeInSeconds":'), s(epoch), F.when(e % 4 == 0, "").otherwise(F.concat(F.lit(',"startTimeOffsetInSeconds":'), s((e % 25 - 12) * 3600))),
        F.lit(',"durationInSeconds":'), s(F.when(e % 19 == 0, 0).otherwise(20 + e * 37 % 5000)), F.lit(',"distanceInMeters":'), s(e * 53 % 30000), F.lit(',"averageHeartRateInBeatsPerMinute":'), s(90 + e % 200),
        F.lit(',"maxHeartRateInBeatsPerMinute":'), s(91 + e % 197), F.lit(',"averagePowerInWatts":'), s(e * 7 % 3200), F.lit(',"manual":'), F.when(e % 13 == 0, "true").otherwise("false"), F.lit(',"laps":['), lap(3), F.lit(","), lap(7), F.lit("]}"),
    )
    body = F.when(e % 23 == 0, F.substring(body, 1, 30)).when(e % 29 == 0, F.concat(F.lit("["), body, F.lit("]"))).otherwise(body)
    return events.select("event_id", "ts", body.alias("body"))


_NORMAL = """n AS (SELECT event_id AS e, user_id, 1700000000 + event_id * 977 AS epoch, (20 + event_id * 37 % 5000)::DOUBLE AS dur, nullif(event_id * 53 % 30000, 0)::DOUBLE AS dist,
  CASE WHEN 90 + event_id % 200 <= 260 THEN 90 + event_id % 200 END::DOUBLE AS hr, CASE WHEN 91 + event_id % 197 <= 260 THEN 91 + event_id % 197 END::DOUBLE AS mx,
  CASE WHEN event_id * 7 % 3200 BETWEEN 1 AND 3000 THEN event_id * 7 % 3200 END::DOUBLE AS pw, event_id % 13 = 0 AS manual, ['run', 'bike', 'swim', 'strength', 'other', 'multisport'][1 + event_id % 6] AS sport,
  CASE WHEN event_id % 4 = 0 THEN 0 ELSE (event_id % 25 - 12) * 3600 END AS off
  FROM events WHERE event_id % 17 <> 0 AND event_id % 19 <> 0 AND event_id % 23 <> 0 AND event_id % 31 <> 0),
laps AS (SELECT e, hr AS x, l.i AS lap_index, CASE WHEN l.d > 0 THEN l.d END::DOUBLE AS duration_s, CASE WHEN l.h <= 260 THEN l.h END::DOUBLE AS lap_hr
  FROM (SELECT e, hr, unnest([{'i': 1, 'd': e * 3 % 400 - 40, 'h': 100 + e * 3 % 200}, {'i': 2, 'd': e * 7 % 400 - 40, 'h': 100 + e * 7 % 200}]) AS l FROM n) WHERE l.d > 0)"""


@register(f"WITH {_NORMAL} SELECT 's' || e AS provider_activity_id, 'u' || user_id AS provider_user_id, sport, epoch AS start_epoch, (make_timestamp((epoch + off) * 1000000))::DATE AS local_date, dur AS duration_s, dist AS distance_m, round(coalesce(dist / dur, NULL), 6) AS avg_speed_m_s, hr AS avg_hr, mx AS max_hr, pw AS avg_power_w, manual AS is_manual FROM n")
def normalise_activity(spark, d):
    return normalised(pv.normalise_activities(payloads(spark, d)))


def normalised(rows: DataFrame) -> DataFrame:
    return rows.select("provider_activity_id", "provider_user_id", "sport", F.unix_seconds("start_time").alias("start_epoch"), "local_date", "duration_s", "distance_m", F.round("avg_speed_m_s", 6).alias("avg_speed_m_s"), "avg_hr", "max_hr", "avg_power_w", "is_manual")


@register(f"WITH {_NORMAL} SELECT 's' || e AS provider_activity_id, lap_index, duration_s, lap_hr AS avg_hr FROM laps")
def normalise_laps(spark, d):
    return pv.normalise_activities(payloads(spark, d)).select("provider_activity_id", F.inline_outer("laps")).filter("lap_index IS NOT NULL").select("provider_activity_id", "lap_index", "duration_s", "avg_hr")


def quality_rows(spark, d) -> DataFrame:
    """Normalised activities with bounds from the athlete's number."""
    u = F.substring("provider_user_id", 2, 20).cast("bigint")
    rows = pv.normalise_activities(payloads(spark, d)).withColumn("u", u)
    bound = lambda k, value: F.when(F.col("u") % k != 0, value).cast("double")
    rows = rows.withColumns({"max_plausible_speed_m_s": bound(3, F.lit(9.0)), "max_plausible_power_w": bound(4, F.lit(900)), "max_plausible_duration_s": bound(5, F.lit(4000)), "hr_max_bound": F.when(F.col("u") % 2 == 0, 180)})
    return rows.withColumn("flags", fq.flags())


_FLAGS = """sums AS (SELECT n.*, coalesce(s, 0) AS laps FROM n LEFT JOIN (SELECT e, sum(duration_s) AS s FROM laps GROUP BY e) l ON n.e = l.e),
v AS (SELECT *, dist / dur AS speed, CASE sport WHEN 'run' THEN 12.5 WHEN 'swim' THEN 3 WHEN 'strength' THEN 5 ELSE 33 END::DOUBLE AS cap FROM sums),
flagged AS (SELECT e, unnest([
  CASE WHEN user_id % 5 <> 0 AND dur > 4000 THEN ('duration_beyond_history', 0.0, 0.3) END,
  CASE WHEN dur < 60 THEN ('duration_too_short_to_analyse', 0.4, 0.0) END,
  CASE WHEN speed > cap THEN ('speed_physically_impossible', 0.6, 1.0) WHEN user_id % 3 <> 0 AND speed > 9 THEN ('speed_beyond_athlete_history', 0.0, 0.5) END,
  CASE WHEN pw > 2500 THEN ('power_physically_impossible', 0.6, 1.0) WHEN user_id % 4 <> 0 AND pw > 900 THEN ('power_beyond_athlete_history', 0.0, 0.5) END,
  CASE WHEN hr > mx THEN ('hr_average_exceeds_max', 0.4, 0.0) END,
  CASE WHEN user_id % 2 = 0 AND mx > 180 * 1.08 THEN ('hr_above_known_max', 0.2, 0.0) END,
  CASE WHEN mx >= hr AND mx - hr < 2 AND dur > 900 AND sport IN ('run', 'bike', 'swim') THEN ('hr_flatline', 0.5, 0.3) END,
  CASE WHEN laps > dur * 1.05 THEN ('lap_total_exceeds_duration', 0.15, 0.0) END,
  CASE WHEN manual THEN ('manually_entered', 0.25, 0.35) END,
  CASE WHEN hr IS NULL AND pw IS NULL AND dist IS NULL AND NOT manual THEN ('no_sensor_channels', 0.5, 0.2) END]) AS f FROM v)"""


@register(f"WITH {_NORMAL}, {_FLAGS} SELECT 's' || e AS provider_activity_id, f[1] AS code, f[2]::DOUBLE AS quality_penalty, f[3]::DOUBLE AS trust_penalty FROM flagged WHERE f IS NOT NULL")
def quality_flags(spark, d):
    return quality_rows(spark, d).select("provider_activity_id", F.inline_outer("flags")).filter("code IS NOT NULL").drop("severity")


@register(f"WITH {_NORMAL}, {_FLAGS} SELECT 's' || n.e AS provider_activity_id, greatest(0, round(1 - coalesce(q, 0) + 1e-9, 4)) AS data_quality, greatest(0, round(1 - coalesce(t, 0) + 1e-9, 4)) AS trust_score, greatest(0, round(1 - coalesce(t, 0) + 1e-9, 4)) < 0.6 AS held FROM n LEFT JOIN (SELECT e, sum(f[2]::DOUBLE) AS q, sum(f[3]::DOUBLE) AS t FROM flagged WHERE f IS NOT NULL GROUP BY e) x ON n.e = x.e")
def quality_scores(spark, d):
    rows = quality_rows(spark, d).withColumns({"data_quality": fq.score(F.col("flags"), "quality_penalty"), "trust_score": fq.score(F.col("flags"), "trust_penalty")})
    return rows.select("provider_activity_id", "data_quality", "trust_score", fq.held(F.col("trust_score")).alias("held"))


def wellness_payloads(spark, d) -> DataFrame:
    """Parts of days: an event gives HRV, or sleep, or resting heart rate and weight."""
    e = F.col("event_id")
    s = lambda c: c.cast("string")
    part = F.when(e % 3 == 0, F.concat(F.lit('"lastNightAvg":'), s(e % 450))).when(e % 3 == 1, F.concat(F.lit('"sleepTimeInSeconds":'), s(e * 11 % 30000), F.lit(',"overallSleepScore":{"value":'), s(e % 120), F.lit("}"))).otherwise(F.concat(F.lit('"restingHeartRateInBeatsPerMinute":'), s(e % 210), F.lit(',"weightInGrams":'), s(50000 + e % 40000)))
    day = F.when(e % 37 == 0, "not a day").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return table(spark, d, "events").select("event_id", F.concat(F.lit('{"userId":"u'), s(F.col("user_id")), F.lit('","calendarDate":"'), day, F.lit('",'), part, F.lit("}")).alias("body"))


@register("""WITH p AS (SELECT event_id AS e, 'u' || user_id AS u, ts::DATE AS day, CASE WHEN event_id % 3 = 0 AND event_id % 450 BETWEEN 1 AND 400 THEN event_id % 450 END::DOUBLE AS hrv,
  CASE WHEN event_id % 3 = 1 THEN nullif(event_id * 11 % 30000, 0) END::DOUBLE AS sleep, CASE WHEN event_id % 3 = 1 AND event_id % 120 BETWEEN 1 AND 100 THEN event_id % 120 END::DOUBLE AS score,
  CASE WHEN event_id % 3 = 2 AND event_id % 210 BETWEEN 1 AND 200 THEN event_id % 210 END::DOUBLE AS rhr, CASE WHEN event_id % 3 = 2 THEN (50000 + event_id % 40000) / 1000.0::DOUBLE END AS kg FROM events WHERE event_id % 37 <> 0)
SELECT u AS provider_user_id, day AS local_date, arg_max(hrv, e) FILTER (hrv IS NOT NULL) AS hrv_rmssd_ms, arg_max(sleep, e) FILTER (sleep IS NOT NULL) AS sleep_duration_s, arg_max(score, e) FILTER (score IS NOT NULL) AS sleep_score, arg_max(rhr, e) FILTER (rhr IS NOT NULL) AS resting_hr, round(arg_max(kg, e) FILTER (kg IS NOT NULL), 3) AS weight_kg FROM p GROUP BY ALL""")
def merge_partial_days(spark, d):
    parts = pv.normalise_wellness(wellness_payloads(spark, d))
    rows = pv.merge_days(parts, ["hrv_rmssd_ms", "sleep_duration_s", "sleep_score", "resting_hr", "weight_kg"], "event_id")
    return rows.withColumn("weight_kg", F.round("weight_kg", 3))


def webhooks(spark, d) -> DataFrame:
    """Batched webhook bodies: one for each ten events, several kinds in each."""
    e = F.col("event_id")
    s = lambda c: c.cast("string")
    item = lambda extra: F.concat(F.lit('{"userId":"'), F.when(e % 11 == 0, "").otherwise(F.concat(F.lit("u"), s(F.col("user_id")))), F.lit('"'), extra, F.lit(',"startTimeInSeconds":'), s(1700000000 + e * 977), F.lit("}"))
    ref = F.when(e % 7 == 0, "").otherwise(F.concat(F.lit(',"summaryId":"s'), s(e), F.lit('"')))
    body = F.concat(F.lit('{"activities":['), item(ref), F.lit('],"sleeps":['), item(F.lit("")), F.lit('],"unknown":['), item(F.lit("")), F.lit('],"deregistrations":['), F.when(e % 5 == 0, item(F.lit(""))).otherwise(""), F.lit("]}"))
    return table(spark, d, "events").select("event_id", F.when(e % 23 == 0, "oops").otherwise(body).alias("body"))


_SUBJECTS = """s AS (SELECT event_id, 'u' || user_id AS provider_user_id, 'activity' AS kind, CASE WHEN event_id % 7 <> 0 THEN 's' || event_id END AS provider_ref, 1700000000 + event_id * 977 AS epoch FROM events WHERE event_id % 11 <> 0 AND event_id % 23 <> 0
  UNION ALL SELECT event_id, 'u' || user_id, 'sleep', NULL, 1700000000 + event_id * 977 FROM events WHERE event_id % 11 <> 0 AND event_id % 23 <> 0
  UNION ALL SELECT event_id, 'u' || user_id, 'deregistration', NULL, 1700000000 + event_id * 977 FROM events WHERE event_id % 11 <> 0 AND event_id % 23 <> 0 AND event_id % 5 = 0)"""


@register(f"WITH {_SUBJECTS} SELECT event_id, provider_user_id, kind, provider_ref, epoch FROM s")
def event_subjects(spark, d):
    return pv.subjects(webhooks(spark, d)).select("event_id", "provider_user_id", "kind", "provider_ref", F.unix_seconds("occurred_at").alias("epoch"))


@register(f"""WITH {_SUBJECTS}, t AS (SELECT event_id, provider_user_id, unnest(['activity_summary', 'activity_details']) AS task, provider_ref AS ref, NULL::DATE AS window_start FROM s WHERE kind = 'activity' AND provider_ref IS NOT NULL
  UNION ALL SELECT event_id, provider_user_id, 'sleep', NULL, make_timestamp(epoch * 1000000)::DATE FROM s WHERE kind = 'sleep')
SELECT *, task || ':' || provider_user_id || ':' || coalesce(ref, '-') || ':' || coalesce(window_start::VARCHAR, '-') AS dedupe_key FROM t""")
def fetch_plan(spark, d):
    return pv.plan_fetches(pv.subjects(webhooks(spark, d))).select("event_id", "provider_user_id", "task", "ref", "window_start", "dedupe_key")


@register("""WITH i AS (SELECT c_custkey AS id, greatest(DATE '2024-01-30' - CAST(c_custkey % 1000 AS INT), DATE '2024-01-30' - 730) AS since FROM customer),
c AS (SELECT id, (since + 90 * unnest(range(0, CAST(ceil((DATE '2024-01-30' - since) / 90.0) AS INT)))::INT)::DATE AS window_start FROM i WHERE since < DATE '2024-01-30')
SELECT id, window_start, least(window_start + 90, DATE '2024-01-30')::DATE AS window_end, unnest(['activity_summary', 'dailies', 'sleep']) AS task FROM c""")
def backfill_chunks(spark, d):
    until = F.lit("2024-01-30").cast("date")
    imports = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), until.alias("until"), F.date_sub(until, (F.col("c_custkey") % 1000).cast("int")).alias("since"))
    return pv.backfill_chunks(imports).select("id", "window_start", "window_end", "task")


@register("""SELECT 'provider:' || CASE WHEN event_id % 3 = 0 THEN 'e' || (event_id // 2) ELSE 'sha256:' || sha256(user_id || '|' || (event_id // 4)) END AS event_key, min(event_id) AS first_event, count(*) AS deliveries FROM events GROUP BY 1""")
def ingest_dedupe(spark, d):
    """Deliveries by key; the first one stays."""
    e = F.col("event_id")
    rows = table(spark, d, "events").select(e, F.when(e % 3 == 0, F.concat(F.lit("e"), F.floor(e / 2).cast("string"))).alias("id"), F.concat_ws("|", F.col("user_id").cast("string"), F.floor(e / 4).cast("string")).alias("body"))
    return rows.groupBy(pv.event_key(F.col("id"), F.col("body")).alias("event_key")).agg(F.min("event_id").alias("first_event"), F.count("*").alias("deliveries"))


@register("""SELECT x.a AS duration_bucket, x.d AS day, x.s AS sport, count(*) AS sessions, count(DISTINCT user_id) AS users FROM (SELECT user_id, (900 + event_id * 37 % 6300) // 60 AS a, ts::DATE AS d, CASE event_type WHEN 'view' THEN 'run' WHEN 'click' THEN 'bike' WHEN 'purchase' THEN 'swim' WHEN 'signup' THEN 'strength' ELSE 'other' END AS s FROM events) x GROUP BY ALL HAVING count(DISTINCT user_id) > 1""")
def fraud_duplicates(spark, d):
    """The same session, to the minute, under several accounts."""
    rows = activities(spark, d).groupBy(F.floor(F.col("duration_s") / 60).alias("duration_bucket"), "day", "sport").agg(F.count("*").alias("sessions"), F.countDistinct("user_id").alias("users"))
    return rows.filter("users > 1")


@register("""SELECT event_id AS activity_id, c AS manual_in_day FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS c FROM events WHERE event_id % 13 = 0) WHERE c >= 2""")
def fraud_manual_bursts(spark, d):
    """Manual entries with others of the same athlete in the 24 hours before."""
    at = F.unix_micros(F.col("start_time").cast("timestamp"))
    rows = activities(spark, d).filter("is_manual").withColumn("at", at)
    n = F.count("*").over(Window.partitionBy("user_id").orderBy("at").rangeBetween(-86_400_000_000, 0))
    return rows.select("activity_id", n.alias("manual_in_day")).filter("manual_in_day >= 2")


@register("""SELECT event_id, (ts + INTERVAL 1 SECOND * ((event_id % 25 - 12) * 3600))::DATE AS local_date FROM events""")
def local_dates(spark, d):
    rows = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), ((F.col("event_id") % 25 - 12) * 3600).alias("offset"))
    return rows.select("event_id", pv.local_date(F.col("ts"), F.col("offset")).alias("local_date"))


@register("""WITH k AS (SELECT c_custkey AS id, DATE '2026-01-01' + unnest(range(60))::INT AS day FROM customer),
p AS (SELECT *, CASE dayofweek(day) WHEN 1 THEN 'run' WHEN 2 THEN 'bike' WHEN 3 THEN 'swim' WHEN 4 THEN 'run' WHEN 6 THEN 'strength' WHEN 0 THEN 'bike' END AS sport, CASE dayofweek(day) WHEN 1 THEN 3600 WHEN 2 THEN 4500 WHEN 3 THEN 2700 WHEN 4 THEN 3000 WHEN 6 THEN 2400 WHEN 0 THEN 9000 END::DOUBLE AS base, [1, 1.08, 1.16, 0.55]::DOUBLE[] AS cyc FROM k)
SELECT id, day, sport, round(base * cyc[1 + ((day - DATE '2026-01-01') // 7) % 4] * (1 + ((('0x' || substr(sha256('athlete-' || id || '|' || day || '|' || sport), 1, 16))::UBIGINT % 10000) / 10000.0::DOUBLE * 2 - 1) * 0.08::DOUBLE), 0) AS duration_s FROM p WHERE sport IS NOT NULL""")
def synthetic_activities(spark, d):
    """For every customer."""
    athletes = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    rows = synthetic.activities(athletes.withColumn("athlete", F.concat(F.lit("athlete-"), F.col("id").cast("string"))), "2026-01-01", 60)
    return rows.select("id", "day", "sport", F.round("duration_s", 0).alias("duration_s"))


@register("""WITH k AS (SELECT c_custkey AS id, DATE '2026-01-01' + unnest(range(60))::INT AS day FROM customer),
p AS (SELECT *, day - DATE '2026-01-01' AS o, ('0x' || substr(sha256('athlete-' || id || '|' || day || '|wellness'), 1, 16))::UBIGINT % 10000 AS s FROM k)
SELECT id, day, round(CASE WHEN o BETWEEN 40 AND 46 THEN 5.4 ELSE 7.6 END::DOUBLE * (1 + (s / 10000.0::DOUBLE * 2 - 1) * 0.06::DOUBLE), 4) AS sleep_h, round(CASE WHEN o BETWEEN 40 AND 46 THEN 44 ELSE 58 END::DOUBLE * (1 + ((s + 1) % 10000 / 10000.0::DOUBLE * 2 - 1) * 0.09::DOUBLE), 4) AS hrv FROM p WHERE o % 23 <> 0""")
def synthetic_wellness(spark, d):
    """For every customer."""
    athletes = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    rows = synthetic.wellness(athletes.withColumn("athlete", F.concat(F.lit("athlete-"), F.col("id").cast("string"))), "2026-01-01", 60)
    return rows.select("id", "day", F.round("sleep_h", 4).alias("sleep_h"), F.round("hrv", 4).alias("hrv"))


