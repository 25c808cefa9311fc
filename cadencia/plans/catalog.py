"""Lookups, lists and checks of the service's tables, and the numbers around imports and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import relational as rel
from ..sources import provider as pv
from ..sources import sinks, synthetic
from ..sources.bridge import activities, profiles, table
from . import sql
from .ingest import payloads

SPARK: dict = {}
ORACLE: dict[str, str] = {}


def register(oracle: str | None = None):
    def add(f):
        SPARK[f.__name__] = f
        if oracle is not None:
            ORACLE[f.__name__] = oracle
        return f

    return add


@register(sql.query(sql.PROFILES, select="SELECT user_id, sex, CAST(age AS INT) AS age, CAST(hr_max AS INT) AS hr_max, CAST(lthr AS INT) AS lthr, ftp AS ftp_watts, level FROM profiles WHERE user_id = 42"))
def profile_lookup(spark, d):
    return profiles(spark, d).filter("user_id = 42").select("user_id", "sex", "age", "hr_max", "lthr", "ftp_watts", "level")


def goals(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "active").otherwise("dropped")
    return table(spark, d, "orders").select(k.alias("goal_id"), F.col("o_custkey").alias("user_id"), status.alias("status"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.col("o_orderdate").alias("created_at"), F.when(k % 9 == 0, F.col("o_orderdate")).alias("deleted_at"))


@register("""SELECT o_orderkey AS goal_id, CAST(o_orderpriority[1] AS INT) AS priority, o_orderdate AS created_at FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'O' AND o_orderkey % 9 <> 0 ORDER BY 2, 3 DESC, 1""")
def goal_list(spark, d):
    rows = goals(spark, d).filter("user_id = 7 AND status = 'active' AND deleted_at IS NULL")
    return rows.select("goal_id", "priority", "created_at").orderBy("priority", F.desc("created_at"), "goal_id")


@register("""SELECT event_id AS family_id, user_id FROM events WHERE event_id % 5 <> 0 AND ts + INTERVAL 7 DAYS > TIMESTAMP '2024-01-20 12:00:00' AND event_id % 3 <> 0 AND event_id % 7 <> 0""")
def live_sessions(spark, d):
    """Families of tokens that are neither used, revoked, superseded nor expired."""
    e = F.col("event_id")
    rows = table(spark, d, "events").select(e.alias("family_id"), "user_id", F.when(e % 5 == 0, F.col("ts")).alias("used_at"), F.when(e % 3 == 0, F.col("ts")).alias("revoked_at"), F.when(e % 7 == 0, e + 1).alias("replaced_by"), (F.col("ts") + F.expr("INTERVAL 7 DAYS")).alias("expires_at"))
    live = rows.filter(F.col("used_at").isNull() & F.col("revoked_at").isNull() & F.col("replaced_by").isNull() & (F.col("expires_at") > F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")))
    return live.select("family_id", "user_id")


@register("""SELECT e.event_id AS token_id, c_name AS name FROM events e JOIN customer ON user_id = c_custkey WHERE c_custkey % 10 <> 0 AND event_id % 5 <> 0""")
def tokens_with_users(spark, d):
    users = table(spark, d, "customer").filter("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return table(spark, d, "events").filter("event_id % 5 <> 0").join(users, "user_id").select(F.col("event_id").alias("token_id"), "name")


@register("""SELECT DISTINCT b.c_custkey AS user_id FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey WHERE a.c_custkey = 7""")
def fellow_members(spark, d):
    """A semi join of the members with themselves."""
    members = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("group_id"))
    return members.join(members.filter("user_id = 7").select("group_id"), "group_id", "left_semi").select("user_id")


@register("""SELECT event_id, NOT list_has_any([event_type, CASE WHEN event_id % 4 = 0 THEN 'heart_rate' ELSE 'title' END], ['heart_rate', 'hrv', 'weight']) AS allowed, list_has_all(['view', 'click', 'title'], [event_type]) AS known FROM events""")
def share_guard(spark, d):
    """A public share must not hold health fields; its scopes must be known ones."""
    fields = F.array("event_type", F.when(F.col("event_id") % 4 == 0, "heart_rate").otherwise("title"))
    health = F.array(*(F.lit(x) for x in ("heart_rate", "hrv", "weight")))
    known = F.array(*(F.lit(x) for x in ("view", "click", "title")))
    return table(spark, d, "events").select("event_id", (~F.arrays_overlap(fields, health)).alias("allowed"), (F.size(F.array_except(F.array("event_type"), known)) == 0).alias("known"))


@register(sql.query(sql.PROFILES, select="SELECT user_id, CAST(coalesce(CASE WHEN user_id % 3 = 0 THEN 60 + user_id % 150 END, hr_max) AS INT) AS hr_max, CAST(coalesce(CASE WHEN user_id % 4 = 1 THEN 50 + user_id % 60 END, hr_rest) AS INT) AS hr_rest FROM profiles WHERE coalesce(CASE WHEN user_id % 3 = 0 THEN 60 + user_id % 150 END, hr_max) > coalesce(CASE WHEN user_id % 4 = 1 THEN 50 + user_id % 60 END, hr_rest)"))
def patched_profiles(spark, d):
    """Profiles after a patch, where the maximum stays above the resting rate."""
    u = F.col("user_id")
    stored = profiles(spark, d).select("user_id", "hr_max", "hr_rest")
    patch = stored.select("user_id", F.when(u % 3 == 0, 60 + u % 150).cast("int").alias("hr_max"), F.when(u % 4 == 1, 50 + u % 60).cast("int").alias("hr_rest"))
    return rel.upsert(stored, patch, ["user_id"]).filter("hr_max > hr_rest")


@register("""WITH s AS (SELECT o_custkey AS user_id, o_orderdate AS t, max(o_orderkey) AS snapshot FROM orders GROUP BY ALL), e AS (SELECT DISTINCT l_orderkey, l_linenumber, l_shipdate, o_custkey AS user_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_linenumber, l_shipdate, snapshot FROM e ASOF JOIN s ON e.user_id = s.user_id AND e.l_shipdate >= s.t""")
def twin_as_of(spark, d):
    """For every row of lineitem."""
    return snapshots(spark, d, table(spark, d, "lineitem"))


def snapshots(spark, d, items) -> DataFrame:
    """The latest snapshot of the athlete before each row: a union and the last one seen, no range join."""
    orders = table(spark, d, "orders")
    snaps = orders.select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("snapshot"))
    rows = items.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id")), "l_orderkey").select("user_id", F.col("l_shipdate").alias("at"), "l_orderkey", "l_linenumber")
    both = snaps.withColumn("kind", F.lit(0)).unionByName(rows.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy("user_id").orderBy("at", "kind", "snapshot").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("seen", F.last("snapshot", ignorenulls=True).over(w)).filter("kind = 1 AND seen IS NOT NULL")
    return seen.select("l_orderkey", "l_linenumber", F.col("at").alias("l_shipdate"), F.col("seen").alias("snapshot")).distinct()


@register("""SELECT c.conv_id % 3 AS prompt_version, count(DISTINCT c.conv_id) AS conversations, count(*) AS messages, CAST(sum(coalesce(l.quality, 0)) AS BIGINT) AS thumbs_up FROM conversations c LEFT JOIN labels l ON l.doc_id = c.conv_id GROUP BY 1""")
def prompt_regressions(spark, d):
    """Conversations with their messages and feedback, by prompt version."""
    feedback = table(spark, d, "labels").select(F.col("doc_id").alias("conv_id"), "quality")
    rows = table(spark, d, "conversations").select("conv_id").join(feedback, "conv_id", "left")
    return rows.groupBy((F.col("conv_id") % 3).alias("prompt_version")).agg(F.countDistinct("conv_id").alias("conversations"), F.count("*").alias("messages"), F.sum(F.coalesce("quality", F.lit(0))).cast("bigint").alias("thumbs_up"))


@register("""WITH e AS (SELECT event_id AS e, user_id, ['activity', 'sleep', 'hrv'][1 + event_id % 3] AS kind, ts + INTERVAL 1 HOUR * (event_id % 200) AS received_at FROM events) SELECT user_id, kind, max(received_at) AS synced_to, count(*) AS events FROM e GROUP BY ALL""")
def sync_high_water_marks(spark, d):
    e = F.col("event_id")
    kind = F.get(F.array(F.lit("activity"), F.lit("sleep"), F.lit("hrv")), (e % 3).cast("int"))
    rows = table(spark, d, "events").select("user_id", kind.alias("kind"), (F.col("ts") + F.make_dt_interval(hours=(e % 200).cast("int"))).alias("received_at"))
    return sinks.high_water_mark(rows)


@register("""WITH c AS (SELECT o_custkey AS user_id, o_orderkey AS chunk, o_orderstatus AS s FROM orders) SELECT user_id, chunk FROM c WHERE s <> 'F'""")
def pending_imports(spark, d):
    chunks = table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("chunk"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("open").alias("status"))
    return sinks.pending_chunks(chunks.select("user_id", "chunk"), chunks, ["user_id", "chunk"])


@register("""SELECT 's' || event_id AS provider_activity_id, CASE WHEN event_id % 2 = 0 THEN 'heartRate,power' ELSE 'heartRate' END AS channels, 2 AS samples,
  sha256('[{"heartRate":' || (100 + event_id % 60) || '},{"heartRate":' || (101 + event_id % 60) || '.5' || CASE WHEN event_id % 2 = 0 THEN ',"power":' || (event_id % 300) ELSE '' END || '}]') AS checksum FROM events WHERE event_id % 5 <> 0""")
def stream_blobs(spark, d):
    """Channels, number and digest of the samples of an activity, whatever the order of their keys and the blanks between; bodies without samples have none."""
    e = F.col("event_id")
    s = lambda c: c.cast("string")
    samples = F.concat(F.lit('[ {"heartRate" : '), s(100 + e % 60), F.lit("},{"), F.when(e % 2 == 0, F.concat(F.lit('"power": '), s(e % 300), F.lit(", "))).otherwise(""), F.lit('"heartRate":'), s(101 + e % 60), F.lit(".50}]"))
    body = F.concat(F.lit('{"summaryId":"s'), s(e), F.lit('","samples":'), F.when(e % 5 == 0, "[]").otherwise(samples), F.lit("}"))
    rows = table(spark, d, "events").select(F.concat(F.lit("s"), s(e)).alias("provider_activity_id"), pv.stream_blob(body).alias("blob")).filter("blob IS NOT NULL")
    return rows.select("provider_activity_id", F.array_join("blob.channels", ",").alias("channels"), "blob.samples", "blob.checksum")


@register("""WITH s AS (SELECT event_id AS activity_id, unnest(range(0, least(900 + event_id * 37 % 6300, 3600), 60)) AS offset_s FROM events) SELECT activity_id, count(*) AS samples, CAST(max(offset_s) AS BIGINT) AS last_offset FROM s GROUP BY 1""")
def synthetic_heart_rate(spark, d):
    """One sample a minute of the first hour, for every session."""
    rows = activities(spark, d).select("activity_id", F.col("duration_s").cast("double").alias("duration_s"), "avg_hr")
    return synthetic.heart_rate_stream(rows).groupBy("activity_id").agg(F.count("*").alias("samples"), F.max("offset_s").cast("bigint").alias("last_offset"))


@register("""SELECT event_id, 1704067200000 + event_id * 1000 AS ms, upper(substr(printf('%012x', 1704067200000 + event_id * 1000), 1, 12)) AS hex FROM events""")
def uuid_timestamps(spark, d):
    """The milliseconds in the first 48 bits of a time-ordered id."""
    ms = F.lit(1704067200000) + F.col("event_id") * 1000
    uuid = F.concat(F.lpad(F.lower(F.hex(ms)), 12, "0"), F.lit("7000800000000000"))
    dashed = F.concat_ws("-", F.substring(uuid, 1, 8), F.substring(uuid, 9, 4), F.substring(uuid, 13, 4), F.substring(uuid, 17, 4), F.substring(uuid, 21, 12))
    bits = F.substring(F.replace(dashed, F.lit("-"), F.lit("")), 1, 12)
    return table(spark, d, "events").select("event_id", F.conv(bits, 16, 10).cast("bigint").alias("ms"), F.upper(bits).alias("hex"))


@register("""SELECT c_custkey AS user_id, (DATE '2024-01-30' - (DATE '1950-01-01' + CAST(c_custkey * 37 % 20000 AS INT))) // 365 AS age, weekday FROM (SELECT *, (isodow(DATE '1950-01-01' + CAST(c_custkey * 37 % 20000 AS INT)) - 1) AS weekday FROM customer)""")
def ages(spark, d):
    born = F.date_add(F.lit("1950-01-01").cast("date"), (F.col("c_custkey") * 37 % 20000).cast("int"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.floor(F.datediff(F.lit("2024-01-30").cast("date"), born) / 365).alias("age"), F.weekday(born).cast("bigint").alias("weekday"))


@register("""SELECT c_custkey AS user_id, substr(sha256('{"balance":' || CAST(floor(c_acctbal) AS BIGINT) || ',"name":"' || c_name || '"}'), 1, 32) AS etag FROM customer""")
def etags(spark, d):
    """The first half of a digest of a canonical record."""
    record = F.to_json(F.struct(F.floor("c_acctbal").alias("balance"), F.col("c_name").alias("name")))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.substring(F.sha2(record, 256), 1, 32).alias("etag"))


@register("""WITH s AS (SELECT o_custkey AS user_id, o_orderkey % 4 AS rule, min(o_orderkey) AS first_event FROM orders GROUP BY ALL) SELECT * FROM s WHERE NOT (user_id % 2 = 0 AND rule = 1)""")
def reward_inserts(spark, d):
    """Reward events that aren't stored yet, one for each athlete and rule."""
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 4).alias("rule")).agg(F.min("o_orderkey").alias("first_event"))
    stored = rows.filter("user_id % 2 = 0 AND rule = 1").select("user_id", "rule")
    return rows.join(stored, ["user_id", "rule"], "left_anti")


@register("""SELECT lower(trim(x)) AS name, CASE lower(trim(x)) WHEN 'running' THEN 'run' WHEN 'cycling' THEN 'bike' WHEN 'lap_swimming' THEN 'swim' WHEN 'yoga' THEN 'strength' WHEN 'triathlon' THEN 'multisport' ELSE 'other' END AS sport, count(*) AS n FROM (SELECT ['RUNNING', ' cycling ', 'LAP_SWIMMING', 'yoga', 'surfing', 'triathlon'][1 + event_id % 6] AS x FROM events WHERE event_id % 23 <> 0) GROUP BY ALL""")
def sport_map(spark, d):
    name = F.get_json_object(F.when(F.col("body").startswith("["), F.expr("substring(body, 2, length(body) - 2)")).otherwise(F.col("body")), "$.activityType")
    rows = payloads(spark, d).filter("event_id % 23 <> 0").select(name.alias("x"))
    return rows.groupBy(F.lower(F.trim("x")).alias("name"), pv.map_sport(F.col("x")).alias("sport")).agg(F.count("*").alias("n"))


@register("""SELECT user_id, count(*) FILTER (event_type = 'error') AS failures, count(*) FILTER (event_type = 'error') >= 5 AS locked FROM events GROUP BY user_id""")
def lockouts(spark, d):
    failed = F.count(F.when(F.col("event_type") == "error", 1))
    return table(spark, d, "events").groupBy("user_id").agg(failed.alias("failures"), (failed >= 5).alias("locked"))


@register("""SELECT ts::DATE AS day, quantile_cont(cost, 0.5) AS p50, round(quantile_cont(cost, 0.95), 6) AS p95, CAST(max(cost) AS BIGINT) AS most FROM (SELECT ts, user_id, ts::DATE AS day, sum(event_id % 97) OVER (PARTITION BY user_id, ts::DATE) AS cost, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY event_id) AS r FROM events) WHERE r = 1 GROUP BY 1""")
def cost_spikes(spark, d):
    rows = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum(F.col("event_id") % 97).alias("cost"))
    return rows.groupBy("day").agg(F.percentile("cost", 0.5).alias("p50"), F.round(F.percentile("cost", 0.95), 6).alias("p95"), F.max("cost").alias("most"))
