"""Queries take every row of their tables."""

from datetime import timedelta

import __spark_entry__ as entry


def rows_of(spark, sf_dir, name):
    return {tuple(r) for r in entry.queries()[name](spark, sf_dir).collect()}


def read(spark, sf_dir, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns).collect()]


def test_equivalent_times_of_every_race(spark, sf_dir):
    rows = rows_of(spark, sf_dir, "equivalent_times")
    fitted = {r.user_id for r in entry.queries()["riegel_fit"](spark, sf_dir).collect()}
    races = {k for k, user in read(spark, sf_dir, "orders", "o_orderkey", "o_custkey") if user in fitted}
    assert {r[0] for r in rows} == races and len(rows) == 5 * len(races)


def test_plans_of_every_customer(spark, sf_dir):
    sf_dir = sf_dir.replace("0.001", "0.01")  # the smallest has few customers
    customers = {k for (k,) in read(spark, sf_dir, "customer", "c_custkey")}
    weeks = {(k, w) for k in customers for w in range(4 + k % 14)}
    for name in ("plan_weeks", "plan_sessions"):
        assert {r[:2] for r in rows_of(spark, sf_dir, name)} == weeks


def test_a_snapshot_for_every_row(spark, sf_dir):
    snaps, user = {}, {}
    for k, u, at in read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate"):
        snaps.setdefault(u, []).append((at, k))
        user[k] = u
    want = set()
    for k, n, at in read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate"):
        before = [s for s in snaps.get(user.get(k), []) if s[0] <= at]
        if before:
            want.add((k, n, at, max(before)[1]))
    assert rows_of(spark, sf_dir, "twin_as_of") == want


def test_streaks_of_all_activities(spark, sf_dir):
    days = {}
    for user, at in read(spark, sf_dir, "events", "user_id", "ts"):
        days.setdefault(user, set()).add(at.date())
    want = set()
    for user, some in days.items():
        for first in (x for x in some if x - timedelta(1) not in some):
            n = next(k for k in range(1, len(some) + 1) if first + timedelta(k) not in some)
            want.add((user, first, first + timedelta(n - 1), n))
    rows = entry.queries()["streaks"](spark, sf_dir).select("user_id", "start", "end", "length").collect()
    assert {tuple(r) for r in rows} == want


def test_synthetic_rows_of_every_athlete_and_session(spark, sf_dir):
    customers = {k for (k,) in read(spark, sf_dir, "customer", "c_custkey")}
    for name in ("synthetic_activities", "synthetic_wellness"):
        assert {r[0] for r in rows_of(spark, sf_dir, name)} == customers
    want = {(e, -(-min(900 + e * 37 % 6300, 3600) // 60)) for (e,) in read(spark, sf_dir, "events", "event_id")}
    assert {r[:2] for r in rows_of(spark, sf_dir, "synthetic_heart_rate")} == want
