"""Operators around the engine: tenant scope, merges, as-of lookups, ledgers, ranks and streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tenant_scope(rows: DataFrame, principal: int | str | None, owner: str = "user_id") -> DataFrame:
    """A principal's own rows; without a principal, none."""
    return rows.filter(F.col(owner) == F.lit(principal))


def live_grants(grants: DataFrame, scope: str, at: Column) -> DataFrame:
    """Grants in force at a time that carry the scope. Expects scopes, expires_at, revoked_at."""
    return grants.filter(F.col("revoked_at").isNull() & (F.col("expires_at") > at) & F.array_contains("scopes", scope))


def granted_rows(rows: DataFrame, grants: DataFrame, grantee: int | str | None, scope: str, at: Column, owner: str = "user_id") -> DataFrame:
    """Rows that others let the grantee see."""
    mine = live_grants(grants, scope, at).filter(F.col("grantee") == F.lit(grantee)).select(F.col("grantor").alias(owner))
    return rows.join(mine, owner, "left_semi")


def latest_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; order ends in a unique column, so ties can't occur."""
    return rows.groupBy(*keys).agg(F.max(F.struct(*order, *(c for c in rows.columns if c not in (*keys, *order)))).alias("r")).select(*keys, "r.*")


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows with the new ones' values where those are supplied (not null), and new keys added."""
    columns = [c for c in stored.columns if c not in keys]
    s, n = stored.alias("s"), new.alias("n")
    joined = s.join(n, keys, "full")
    return joined.select(*keys, *(F.coalesce(F.col(f"n.{c}"), F.col(f"s.{c}")).alias(c) for c in columns))


def keep_faster(stored: DataFrame, new: DataFrame, keys: list[str], time: str = "time_s") -> DataFrame:
    """Of stored and new rows the fastest of each key; a tie keeps the stored one."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    rest = [c for c in stored.columns if c not in (*keys, time)]
    return both.groupBy(*keys).agg(F.min(F.struct(time, "__new", *rest)).alias("r")).select(*keys, f"r.{time}", *(f"r.{c}" for c in rest))


def as_of(rows: DataFrame, versions: DataFrame, at: str, start: str = "active_from", end: str = "active_to") -> DataFrame:
    """Each row with the version in force at its time (an open end is null). The equi-join on the month keeps the range join
    from meeting every row with every version; a version has a row for each month that it shares with the rows' own times,
    whatever its span."""
    month = lambda c: F.date_trunc("month", c)
    span = rows.agg(F.min(at).alias("__low"), F.max(at).alias("__high"))  # one row
    first, last = month(F.greatest(start, "__low")), month(F.least(F.coalesce(end, "__high"), "__high"))
    months = F.when(first <= last, F.sequence(first, last, F.expr("INTERVAL 1 MONTH")))
    spans = versions.crossJoin(F.broadcast(span)).withColumn("__month", F.explode(months)).drop("__low", "__high")
    joined = rows.withColumn("__month", month(F.col(at))).join(spans, "__month")
    return joined.filter((F.col(at) >= F.col(start)) & (F.col(end).isNull() | (F.col(at) < F.col(end)))).drop("__month")


def keyset_page(rows: DataFrame, order: list[str], after: tuple | None, size: int) -> DataFrame:
    """The next page of a feed in falling order, from the last row's keys."""
    if after is not None:
        rows = rows.filter(F.struct(*order) < F.struct(*(F.lit(x).cast(rows.schema[c].dataType) for c, x in zip(order, after, strict=True))))
    return rows.orderBy(*(F.col(c).desc() for c in order)).limit(size)


def wallet_balances(entries: DataFrame) -> DataFrame:
    signed = F.when(F.col("direction") == "credit", F.col("amount_minor")).otherwise(-F.col("amount_minor"))
    return entries.groupBy("wallet_id", "user_id", "account", "currency").agg(F.sum(signed).alias("balance_minor"))


def unbalanced(entries: DataFrame) -> DataFrame:
    signed = F.when(F.col("direction") == "credit", F.col("amount_minor")).otherwise(-F.col("amount_minor"))
    return entries.groupBy("transaction_id").agg(F.sum(signed).alias("imbalance_minor")).filter("imbalance_minor <> 0")


def policy_split(amount: Column, redeemable_bps: Column) -> tuple[Column, Column]:
    """An amount by basis points; the remainder goes to the withdrawable side."""
    redeemable = F.floor(amount * redeemable_bps / 10000).cast("bigint")
    return redeemable, amount - redeemable


def streaks(days: DataFrame, by: str = "user_id", day: str = "day") -> DataFrame:
    """Runs of consecutive days: start, end and length. Expects one row for each day."""
    n = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    island = n - F.row_number().over(Window.partitionBy(by).orderBy(day))
    return days.withColumn("island", island).groupBy(by, "island").agg(F.min(day).alias("start"), F.max(day).alias("end"), F.count("*").alias("length")).drop("island")


#: Parts that rows of one score are numbered in.
TIE_PARTS = 1024


def ranked(rows: DataFrame, group: str, score: str, tie: str) -> DataFrame:
    """rank (ties share it) and place (ties in order of a unique whole number), highest score first.

    A group's rows are never sorted together, nor those of one score: they are counted by score and by part of the tie
    column's range, the counts are summed from the top, and only rows of one part are numbered among themselves.
    """
    low, high = rows.agg(F.min(tie), F.max(tie)).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // TIE_PARTS))
    rows = rows.withColumn("__part", F.floor((F.col(tie) - F.lit(low or 0)) / width))
    counts = rows.groupBy(group, score, "__part").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(group).orderBy(F.desc(score), "__part")
    above = F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(group, score, "__part", above.alias("__above"))
    counts = counts.withColumn("rank", F.min("__above").over(Window.partitionBy(group, score)) + 1)
    order = F.row_number().over(Window.partitionBy(group, score, "__part").orderBy(tie))
    return rows.join(counts, [group, score, "__part"]).withColumn("place", F.col("__above") + order).drop("__above", "__part")


def fifo_expiry(earned: DataFrame, spent: DataFrame, by: str = "user_id") -> DataFrame:
    """What is left of each lot when spending takes the oldest first. Expects lot, at, points; spent has points by user."""
    before = F.sum("points").over(Window.partitionBy(by).orderBy("at", "lot").rowsBetween(Window.unboundedPreceding, -1))
    used = spent.groupBy(by).agg(F.sum("points").alias("used"))
    rows = earned.withColumn("before", F.coalesce(before, F.lit(0))).join(used, by, "left")
    taken = F.greatest(F.lit(0), F.least(F.col("points"), F.coalesce("used", F.lit(0)) - F.col("before")))
    return rows.withColumn("left", F.col("points") - taken).drop("before", "used")


def downsample(samples: DataFrame, by: str, offset: str, value: str, most: int = 1000) -> DataFrame:
    """At most so many points of each series: means over equal buckets."""
    size = samples.groupBy(by).agg((F.max(offset) + 1).alias("__n"))
    rows = samples.join(size, by).withColumn("bucket", F.floor(F.col(offset) / F.ceil(F.col("__n") / most)))
    return rows.groupBy(by, "bucket").agg(F.avg(value).alias(value), F.count("*").alias("n"))


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a text, lower case, with blanks around it."""
    t = F.concat(F.lit("  "), F.lower(text), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda i: F.substring(t, i, F.lit(3))))


def trigram_similarity(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


# A key that holds one of these is sensitive, but for the keys that are allowed.
SENSITIVE = (
    "password",
    "secret",
    "token",
    "authorization",
    "api_key",
    "apikey",
    "private_key",
    "credential",
    "signature",
    "cookie",
    "session_id",
    "email",
    "phone",
    "display_name",
    "full_name",
    "first_name",
    "last_name",
    "birth_date",
    "date_of_birth",
    "address",
    "hrv",
    "rmssd",
    "resting_hr",
    "heart_rate",
    "avg_hr",
    "max_hr",
    "sleep",
    "weight",
    "height",
    "vo2max",
    "readiness",
    "injury",
    "iban",
    "account_number",
    "destination_ref",
)
ALLOWED = ("token_family_id", "refresh_token_id", "user_id", "subject_user_id", "actor_user_id")
REDACTED = "[redacted]"


def sensitive(key: Column) -> Column:
    return F.lower(key).rlike("|".join(SENSITIVE)) & ~F.lower(key).isin(*ALLOWED)


def redacted(record: Column) -> Column:
    """A map with the values of sensitive keys hidden."""
    return F.transform_values(record, lambda k, v: F.when(sensitive(k), F.lit(REDACTED)).otherwise(v))


def redacted_nested(records: Column) -> Column:
    """A map of maps: under a sensitive key all is hidden, else the inner sensitive values are, and the rest is given as JSON."""
    return F.transform_values(records, lambda k, v: F.when(sensitive(k), F.lit(REDACTED)).otherwise(F.to_json(redacted(v))))


# The work queues and what is in them.
QUEUES = {
    "pending_events": "processed_at IS NULL",
    "active_plans": "plan_status = 'active'",
    "unscored_activities": "trust_score IS NULL AND deleted_at IS NULL",
    "unverified_streams": "checksum_verified_at IS NULL",
    "pending_review": "resolution = 'pending_review'",
    "due_renewals": "subscription_status IN ('trialing', 'active', 'grace')",
    "unverified_webhooks": "signature_verified = false",
    "live_entitlements": "revoked_at IS NULL AND expires_at IS NOT NULL",
    "open_fraud": "resolved_at IS NULL",
}


def queues_of(names: tuple[str, ...] = tuple(QUEUES)) -> Column:
    """The work queues that a row is in, by the columns that they look at."""
    return F.filter(F.array(*(F.when(F.expr(QUEUES[name]), name) for name in names)), lambda x: x.isNotNull())


def outcomes(predictions: DataFrame, actuals: DataFrame, key: str = "prediction_id") -> DataFrame:
    """Predictions that came due, with absolute_error, percent_error and whether the actual value is within the interval."""
    c = F.col
    rows = predictions.join(actuals.select(key, "actual_value"), key)
    off = F.abs(c("actual_value") - c("predicted_value"))
    return rows.withColumns({"absolute_error": off, "percent_error": 100 * off / F.nullif(F.abs(c("actual_value")), F.lit(0)), "within_interval": c("actual_value").between(c("interval_low"), c("interval_high"))})


def accuracy(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mean absolute error and the share of actual values within the interval."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg("absolute_error"), 2).alias("mae"), F.round(F.avg(F.col("within_interval").cast("int")), 6).alias("coverage"))


def uuid7(milliseconds: Column, counter: Column, random: Column) -> Column:
    """A time-ordered id: 48 bits of time, version 7, 12 bits of a counter, the variant and 62 bits of a random number."""
    part = lambda x, digits: F.lpad(F.lower(F.hex(x)), digits, "0")
    ver = F.lit(0x7000).bitwiseOR(counter.cast("int").bitwiseAND(F.lit(0xFFF)))
    tail = part(random.bitwiseAND(F.lit((1 << 62) - 1)), 16)
    variant = F.lower(F.hex(F.shiftrightunsigned(random.bitwiseAND(F.lit((1 << 62) - 1)), 60) + 8))
    digits = F.concat(part(milliseconds, 12), part(ver, 4), variant, F.substring(tail, 2, 15))
    return F.concat_ws("-", F.substring(digits, 1, 8), F.substring(digits, 9, 4), F.substring(digits, 13, 4), F.substring(digits, 17, 4), F.substring(digits, 21, 12))


def uuid7_milliseconds(uuid: Column) -> Column:
    """The time of a time-ordered id; null for ids of other versions, whose first bits mean nothing."""
    digits = F.replace(uuid, F.lit("-"), F.lit(""))
    return F.when(F.substring(digits, 13, 1) == "7", F.conv(F.substring(digits, 1, 12), 16, 10).cast("bigint"))


def shared_devices(rows: DataFrame, device: str = "device_id", user: str = "user_id") -> DataFrame:
    """Devices that more than one account uses."""
    return rows.groupBy(device).agg(F.countDistinct(user).alias("users"), F.count("*").alias("sessions")).filter("users > 1")


def challenge_metrics(sessions: DataFrame) -> DataFrame:
    """Distance, duration, elevation, load, session_count, the best single session by three of them, and the longest streak of days."""
    totals = sessions.groupBy("user_id").agg(
        F.sum("distance_m").alias("distance"), F.sum("duration_s").alias("duration"), F.sum("elevation_gain_m").alias("elevation"), F.sum("load").alias("load"), F.count("*").alias("session_count"),
        F.max("duration_s").alias("best_duration"), F.max("distance_m").alias("best_distance"), F.max("load").alias("best_load"),
    )
    longest = streaks(sessions.select("user_id", "day").distinct()).groupBy("user_id").agg(F.max("length").alias("streak_days"))
    return totals.join(longest, "user_id")


def suppressed(groups: DataFrame, users: str, least: int) -> DataFrame:
    """Groups with at least so many distinct people."""
    return groups.filter(F.col(users) >= least)


def variant(user: Column, experiment: str, n: int) -> Column:
    """A sticky assignment from a digest, which any engine can repeat."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(experiment), user.cast("string"))), 1, 8), 16, 10).cast("bigint") % n).cast("int")
