"""The relational slice: access, feeds, ledgers, challenges, forecasts' accuracy and housekeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import relational as rel
from ..sources.bridge import activities, table
from . import sql
from .training import daily

SPARK: dict = {}
ORACLE: dict[str, str] = {}


def register(oracle: str | None = None):
    def add(f):
        SPARK[f.__name__] = f
        if oracle is not None:
            ORACLE[f.__name__] = oracle
        return f

    return add


AT = "2024-01-20 12:00:00"
VIEWER = 7


def lit_ts(x: str = AT):
    return F.lit(x).cast("timestamp_ntz")


def grants(spark, d) -> DataFrame:
    e = F.col("event_id")
    rows = table(spark, d, "events")
    scopes = F.array(F.when(e % 2 == 0, "activities").otherwise("wellness"), F.when(e % 3 == 0, "plans").otherwise("profile"))
    return rows.select(e.alias("grant_id"), F.col("user_id").alias("grantor"), (e % 20).alias("grantee"), scopes.alias("scopes"), (F.col("ts") + F.expr("INTERVAL 10 DAYS")).alias("expires_at"), F.when(e % 5 == 0, F.col("ts")).alias("revoked_at"), "ts")


_GRANTS = """grants AS (SELECT event_id AS grant_id, user_id AS grantor, event_id % 20 AS grantee, [CASE WHEN event_id % 2 = 0 THEN 'activities' ELSE 'wellness' END, CASE WHEN event_id % 3 = 0 THEN 'plans' ELSE 'profile' END] AS scopes, ts + INTERVAL 10 DAYS AS expires_at, CASE WHEN event_id % 5 = 0 THEN ts END AS revoked_at FROM events)"""


@register(f"SELECT event_id AS activity_id, user_id FROM events WHERE user_id = {VIEWER}")
def tenant_scope(spark, d):
    return rel.tenant_scope(activities(spark, d), VIEWER).select("activity_id", "user_id")


@register("SELECT event_id AS activity_id, user_id FROM events WHERE user_id = NULL")
def tenant_scope_without_principal(spark, d):
    return rel.tenant_scope(activities(spark, d), None).select("activity_id", "user_id")


@register(f"WITH {_GRANTS} SELECT event_id AS activity_id, user_id FROM events e WHERE EXISTS (SELECT 1 FROM grants g WHERE g.grantor = e.user_id AND grantee = {VIEWER} AND revoked_at IS NULL AND expires_at > TIMESTAMP '{AT}' AND list_contains(scopes, 'wellness'))")
def granted_activities(spark, d):
    return rel.granted_rows(activities(spark, d), grants(spark, d), VIEWER, "wellness", lit_ts()).select("activity_id", "user_id")


@register("SELECT user_id, event_type AS purpose, arg_max(event_id, (ts, event_id)) AS consent_id, max(ts) AS at FROM events GROUP BY ALL")
def latest_consent(spark, d):
    rows = table(spark, d, "events").select("user_id", F.col("event_type").alias("purpose"), F.col("ts").alias("at"), F.col("event_id").alias("consent_id"))
    return rel.latest_by(rows, ["user_id", "purpose"], ["at", "consent_id"])


@register(f"SELECT event_id AS activity_id, ts AS start_time FROM events WHERE (ts, event_id) < (TIMESTAMP '{AT}', 5000) ORDER BY ts DESC, event_id DESC LIMIT 50")
def feed_page(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("activity_id"), F.col("ts").alias("start_time"))
    return rel.keyset_page(rows, ["start_time", "activity_id"], (AT, 5000), 50)


@register("SELECT o_orderkey AS event_id, o_custkey AS user_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM events WHERE event_id = o_orderkey)")
def lost_events(spark, d):
    """Known to the map, but never received."""
    known = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("user_id"))
    return known.join(table(spark, d, "events").select("event_id"), "event_id", "left_anti")


@register("""WITH s AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 50 END AS weight, CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS name FROM customer WHERE c_custkey % 5 <> 0),
n AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 70 END AS weight, CASE WHEN c_custkey % 6 = 0 THEN 'new ' || c_name END AS name FROM customer WHERE c_custkey % 7 <> 0)
SELECT coalesce(s.user_id, n.user_id) AS user_id, coalesce(n.weight, s.weight) AS weight, coalesce(n.name, s.name) AS name FROM s FULL JOIN n ON s.user_id = n.user_id""")
def upsert_profiles(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer")
    stored = rows.filter(k % 5 != 0).select(k.alias("user_id"), F.when(k % 3 != 0, k % 50).alias("weight"), F.when(k % 4 != 0, F.col("c_name")).alias("name"))
    new = rows.filter(k % 7 != 0).select(k.alias("user_id"), F.when(k % 2 == 0, k % 70).alias("weight"), F.when(k % 6 == 0, F.concat(F.lit("new "), "c_name")).alias("name"))
    return rel.upsert(stored, new, ["user_id"])


@register("""WITH b AS (SELECT o_custkey AS user_id, o_orderkey % 5 AS dist, round(o_totalprice, 2) AS time_s, o_orderkey % 2 AS new, o_orderkey AS source FROM orders)
SELECT user_id, dist, min(time_s) AS time_s, arg_min(source, (time_s, new, source)) AS source FROM b GROUP BY ALL""")
def keep_faster_bests(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), (k % 5).alias("dist"), F.round("o_totalprice", 2).alias("time_s"), k.alias("source"))
    return rel.keep_faster(rows.filter("source % 2 = 0"), rows.filter("source % 2 = 1"), ["user_id", "dist"])


def entries(spark, d) -> DataFrame:
    """Lines of a ledger: cents of the price; returns are debits."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return table(spark, d, "lineitem").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id")), "l_orderkey").select(
        F.col("l_orderkey").alias("transaction_id"), F.pmod(F.col("user_id"), F.lit(97)).alias("wallet_id"), "user_id", F.when(F.col("l_linenumber") % 2 == 0, "redeemable").otherwise("withdrawable").alias("account"), F.lit("USD").alias("currency"),
        F.when(F.col("l_returnflag") == "R", "debit").otherwise("credit").alias("direction"), cents.alias("amount_minor"), F.to_date("l_shipdate").alias("day"), F.col("l_linenumber").alias("line"),
    )


_ENTRIES = """entries AS (SELECT l_orderkey AS transaction_id, o_custkey % 97 AS wallet_id, o_custkey AS user_id, CASE WHEN l_linenumber % 2 = 0 THEN 'redeemable' ELSE 'withdrawable' END AS account, 'USD' AS currency,
  CASE WHEN l_returnflag = 'R' THEN 'debit' ELSE 'credit' END AS direction, CAST(round(l_extendedprice * 100) AS BIGINT) AS amount_minor, CAST(l_shipdate AS DATE) AS day, l_linenumber AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@register(f"WITH {_ENTRIES} SELECT wallet_id, user_id, account, currency, CAST(sum(CASE WHEN direction = 'credit' THEN amount_minor ELSE -amount_minor END) AS BIGINT) AS balance_minor FROM entries GROUP BY ALL")
def wallet_balances(spark, d):
    return rel.wallet_balances(entries(spark, d))


@register(f"WITH {_ENTRIES} SELECT transaction_id, CAST(sum(CASE WHEN direction = 'credit' THEN amount_minor ELSE -amount_minor END) AS BIGINT) AS imbalance_minor FROM entries GROUP BY ALL HAVING sum(CASE WHEN direction = 'credit' THEN amount_minor ELSE -amount_minor END) <> 0")
def trial_balance(spark, d):
    return rel.unbalanced(entries(spark, d))


@register(f"WITH {_ENTRIES}, p AS (SELECT *, [5000, 7500, 3333][1 + transaction_id % 3] AS bps FROM entries WHERE direction = 'credit') SELECT transaction_id, line, amount_minor, amount_minor * bps // 10000 AS redeemable, amount_minor - amount_minor * bps // 10000 AS withdrawable FROM p")
def policy_split(spark, d):
    bps = F.get(F.array(F.lit(5000), F.lit(7500), F.lit(3333)), (F.col("transaction_id") % 3).cast("int"))
    a, b = rel.policy_split(F.col("amount_minor"), bps)
    return entries(spark, d).filter("direction = 'credit'").select("transaction_id", "line", "amount_minor", a.alias("redeemable"), b.alias("withdrawable"))


@register(f"WITH {_ENTRIES} SELECT user_id, CAST(sum(CASE WHEN direction = 'credit' THEN amount_minor ELSE -amount_minor END) FILTER (day < DATE '1998-01-01') AS BIGINT) AS snapshot, CAST(sum(CASE WHEN direction = 'credit' THEN amount_minor ELSE -amount_minor END) AS BIGINT) AS balance FROM entries GROUP BY user_id")
def balance_from_snapshot(spark, d):
    """A snapshot and the entries after it, full outer joined: a wallet may have either alone."""
    signed = F.when(F.col("direction") == "credit", F.col("amount_minor")).otherwise(-F.col("amount_minor"))
    rows = entries(spark, d).withColumn("signed", signed)
    old = rows.filter("day < DATE '1998-01-01'").groupBy("user_id").agg(F.sum("signed").alias("snapshot"))
    tail = rows.filter("day >= DATE '1998-01-01'").groupBy("user_id").agg(F.sum("signed").alias("tail"))
    return old.join(tail, "user_id", "full").select("user_id", "snapshot", (F.coalesce("snapshot", F.lit(0)) + F.coalesce("tail", F.lit(0))).alias("balance"))


_PROGRESS = """progress AS (SELECT c_nationkey AS group_id, user_id, round(sum(dist), 3) AS total_distance, max(d) AS best_duration, count(*) AS sessions, count(DISTINCT day) AS active_days FROM activities JOIN customer ON user_id = c_custkey WHERE user_id % 13 <> 0 GROUP BY ALL)"""


def progress(spark, d) -> DataFrame:
    members = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("group_id"))
    rows = activities(spark, d).filter("user_id % 13 <> 0").groupBy("user_id").agg(F.round(F.sum("distance_m"), 3).alias("total_distance"), F.max("duration_s").alias("best_duration"), F.count("*").alias("sessions"), F.countDistinct("day").alias("active_days"))
    return rows.join(members, "user_id")


@register(f"WITH {sql.ACTIVITIES}, {_PROGRESS} SELECT * FROM progress")
def challenge_progress(spark, d):
    return progress(spark, d).select("group_id", "user_id", "total_distance", "best_duration", "sessions", "active_days")


@register(f"WITH {sql.ACTIVITIES}, {_PROGRESS} SELECT group_id, user_id, sessions, rank() OVER (PARTITION BY group_id ORDER BY sessions DESC) AS rank, row_number() OVER (PARTITION BY group_id ORDER BY sessions DESC, user_id) AS place FROM progress")
def leaderboard(spark, d):
    return rel.ranked(progress(spark, d), "group_id", "sessions", "user_id").select("group_id", "user_id", "sessions", "rank", "place")


@register('WITH x AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events), i AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INT) AS g FROM x) SELECT user_id, min(day) AS start, max(day) AS "end", count(*) AS length FROM i GROUP BY user_id, g')
def streaks(spark, d):
    """Of all activities."""
    return rel.streaks(activities(spark, d).select("user_id", "day").distinct())


_VERSIONS = "versions AS (SELECT * FROM (VALUES (1, TIMESTAMP '1994-01-01', TIMESTAMP '1997-03-15', 5000), (2, TIMESTAMP '1997-03-15', TIMESTAMP '2000-01-01', 6000), (3, TIMESTAMP '2000-01-01', NULL, 7000)) v(version, active_from, active_to, bps))"


@register(f"WITH {_VERSIONS} SELECT o_orderkey, version, bps FROM orders JOIN versions ON o_orderdate >= active_from AND (active_to IS NULL OR o_orderdate < active_to)")
def policy_as_of(spark, d):
    rows = "(1, TIMESTAMP_NTZ '1994-01-01', TIMESTAMP_NTZ '1997-03-15', 5000), (2, TIMESTAMP_NTZ '1997-03-15', TIMESTAMP_NTZ '2000-01-01', 6000), (3, TIMESTAMP_NTZ '2000-01-01', NULL, 7000)"
    versions = spark.sql(f"SELECT * FROM VALUES {rows} AS v(version, active_from, active_to, bps)")
    return rel.as_of(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), versions, "o_orderdate").select("o_orderkey", "version", "bps")


@register("SELECT lang, source, count(*) AS replies, round(avg(l.quality), 6) AS helpful FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY ALL HAVING count(DISTINCT d.doc_id) >= 5")
def feedback_with_suppression(spark, d):
    """Feedback by variant; groups of fewer than five people aren't shown."""
    rows = table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels"), "doc_id")
    groups = rows.groupBy("lang", "source").agg(F.count("*").alias("replies"), F.round(F.avg("quality"), 6).alias("helpful"), F.countDistinct("doc_id").alias("people"))
    return rel.suppressed(groups, "people", 5).drop("people")


@register("SELECT event_id, ts < TIMESTAMP '2024-01-10' AS expired, CASE WHEN event_id % 4 = 0 THEN 'v1' ELSE 'v2' END <> 'v2' AS recompute FROM events WHERE ts < TIMESTAMP '2024-01-10' OR event_id % 4 = 0")
def retention_and_recompute(spark, d):
    """What retention drops and what an older engine computed."""
    old, stale = F.col("ts") < lit_ts("2024-01-10 00:00:00"), F.col("event_id") % 4 == 0
    return table(spark, d, "events").filter(old | stale).select("event_id", old.alias("expired"), stale.alias("recompute"))


@register("""WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS o, value FROM events), n AS (SELECT user_id, max(o) + 1 AS n FROM s GROUP BY user_id)
SELECT s.user_id, CAST(o // CAST(ceil(n / 20.0) AS BIGINT) AS BIGINT) AS bucket, round(avg(value), 6) AS value, count(*) AS n FROM s JOIN n ON s.user_id = n.user_id GROUP BY ALL""")
def downsample(spark, d):
    rows = table(spark, d, "events").select("user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("o"), "value")
    return rel.downsample(rows, "user_id", "o", "value", 20).withColumn("value", F.round("value", 6))


@register("""WITH e AS (SELECT o_custkey AS user_id, o_orderkey AS lot, o_orderdate AS at, CAST(floor(o_totalprice) AS BIGINT) AS points, coalesce(sum(CAST(floor(o_totalprice) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM orders),
u AS (SELECT o_custkey AS user_id, sum(o_orderkey % 100000) AS used FROM orders GROUP BY 1) SELECT lot, CAST(points - greatest(0, least(points, used - before)) AS BIGINT) AS "left" FROM e JOIN u ON e.user_id = u.user_id""")
def points_expiry(spark, d):
    rows = table(spark, d, "orders")
    earned = rows.select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("lot"), F.col("o_orderdate").alias("at"), F.floor("o_totalprice").alias("points"))
    spent = rows.select(F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 100000).alias("points"))
    return rel.fifo_expiry(earned, spent).select("lot", "left")


@register("""WITH t AS (SELECT p_partkey, list_distinct([substr('  ' || lower(p_name) || ' ', i, 3) FOR i IN range(1, length(p_name) + 2)]) AS g FROM part), q AS (SELECT list_distinct([substr('  smal ring ', i, 3) FOR i IN range(1, 11)]) AS g)
SELECT p_partkey, round(len(list_intersect(t.g, q.g)) / len(list_distinct(list_concat(t.g, q.g)))::DOUBLE, 6) AS similarity FROM t, q WHERE len(list_intersect(t.g, q.g)) / len(list_distinct(list_concat(t.g, q.g)))::DOUBLE >= 0.3""")
def name_search(spark, d):
    """Parts whose names are like 'smal ring'."""
    s = rel.trigram_similarity(F.col("p_name"), F.lit("smal ring"))
    return table(spark, d, "part").select("p_partkey", F.round(s, 6).alias("similarity")).filter(F.col("similarity") >= 0.3)


@register(sql.query(*sql.READY, select="SELECT count(*) FILTER (acwr > 1.5 OR monotony > 2) AS overreaching_days, round(avg(CASE WHEN band IN ('good', 'prime') THEN 1 ELSE 0 END), 6) AS good_share, CAST(count(*) AS BIGINT) AS days, level FROM ready r JOIN profiles p ON r.user_id = p.user_id GROUP BY level"))
def product_outcomes(spark, d):
    from ..sources.bridge import profiles
    from .training import ready_rows

    rows = ready_rows(spark, d).join(profiles(spark, d).select("user_id", "level"), "user_id")
    over = (F.col("acwr") > 1.5) | (F.col("monotony") > 2)
    return rows.groupBy("level").agg(F.count(F.when(over, 1)).alias("overreaching_days"), F.round(F.avg(F.col("band").isin("good", "prime").cast("int")), 6).alias("good_share"), F.count("*").alias("days"))


@register(sql.query(sql.WELLNESS, select="SELECT user_id, day, array_to_string([x FOR x IN [CASE WHEN hrv IS NULL THEN 'hrv' END, CASE WHEN rhr IS NULL THEN 'resting_hr' END, CASE WHEN sleep IS NULL THEN 'sleep' END] IF x IS NOT NULL], ',') AS missing FROM wellness WHERE hrv IS NULL OR rhr IS NULL OR sleep IS NULL"))
def data_gaps(spark, d):
    from ..sources.bridge import wellness

    gap = lambda c, name: F.when(F.col(c).isNull(), name)
    missing = F.concat_ws(",", gap("hrv_rmssd_ms", "hrv"), gap("resting_hr", "resting_hr"), gap("sleep_total_min", "sleep"))
    return wellness(spark, d).select("user_id", "day", missing.alias("missing")).filter("missing <> ''")


@register("""SELECT coalesce(a.k, b.k) AS k, coalesce(a.s, 'missing') AS ours, coalesce(b.s, 'missing') AS theirs FROM (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 3 <> 0) a FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN 'P' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 4 <> 0) b ON a.k = b.k WHERE a.s IS DISTINCT FROM b.s""")
def subscription_drift(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders")
    a = rows.filter(k % 3 != 0).select(k.alias("k"), F.col("o_orderstatus").alias("ours"))
    b = rows.filter(k % 4 != 0).select(k.alias("k"), F.when(k % 11 == 0, "P").otherwise(F.col("o_orderstatus")).alias("theirs"))
    return a.join(b, "k", "full").filter(~F.col("ours").eqNullSafe(F.col("theirs"))).fillna("missing", ["ours", "theirs"])
