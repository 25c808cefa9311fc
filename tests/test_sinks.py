"""Tables on disk and the plans that read them."""

import datetime as dt

from pyspark.sql import functions as F

from cadencia.operators import relational, series
from cadencia.sources import bridge, sinks

DAY = dt.date(2026, 1, 1)


def test_append_ignores_what_is_stored(spark, tmp_path):
    schema = "provider string, event_id long, body string"
    path = f"{tmp_path}/raw"
    sinks.append_new(spark.createDataFrame([("p", 1, "a"), ("p", 1, "again"), ("q", 1, "b")], schema), None, ["provider", "event_id"], path)
    sinks.append_new(spark.createDataFrame([("p", 1, "late"), ("p", 2, "c")], schema), spark.read.parquet(path), ["provider", "event_id"], path)
    rows = spark.read.parquet(path).collect()
    assert sorted((r.provider, r.event_id) for r in rows) == [("p", 1), ("p", 2), ("q", 1)]
    assert "late" not in {r.body for r in rows}


def test_recompute_overwrites_its_months_only(spark, tmp_path):
    path = f"{tmp_path}/metrics"
    rows = spark.createDataFrame([(1, DAY + dt.timedelta(20 * k), float(k)) for k in range(4)], "user_id long, day date, load double")
    sinks.overwrite_partitions(sinks.by_month(rows, "day"), path, "month")
    sinks.overwrite_partitions(sinks.by_month(rows.filter("day >= DATE'2026-02-01'").withColumn("load", F.lit(9.0)), "day"), path, "month")
    assert sorted(r.load for r in spark.read.parquet(path).collect()) == [0.0, 1.0, 9.0, 9.0]
    plan = spark.read.parquet(path).filter("month = '2026-01'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_retention_and_pending(spark):
    rows = spark.createDataFrame([(k, DAY + dt.timedelta(k)) for k in range(10)], "id long, day date")
    assert sinks.retained(rows, "day", "2026-01-10", 3).count() == 4
    done = rows.select("id", F.when(F.col("id") < 4, "done").otherwise("open").alias("status"))
    assert sinks.pending_chunks(rows, done, ["id"]).count() == 6


def test_one_sort_serves_all_windows_of_a_day(spark, sf_dir):
    daily = series.daily_load(series.score_sessions(bridge.activities(spark, sf_dir), bridge.profiles(spark, sf_dir).drop("group_id")))
    plan = series.workload(series.form_curve(daily))._jdf.queryExecution().executedPlan().toString()
    initial = plan[plan.index("Initial Plan") :] if "Initial Plan" in plan else plan
    assert initial.count("Exchange hashpartitioning") <= 2  # by athlete and day for the sums, by athlete for the windows
    assert "ArrowEval" not in plan and "BatchEvalPython" not in plan


def test_scan_reads_only_the_columns_it_needs(spark, sf_dir):
    rows = relational.tenant_scope(bridge.table(spark, sf_dir, "events"), 7).select("event_id")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in plan and "EqualTo(user_id,7)" in plan


def test_upsert_keeps_what_is_not_supplied(spark):
    schema = "user_id long, a int, b int"
    got = relational.upsert(spark.createDataFrame([(1, 1, 1), (2, 2, 2)], schema), spark.createDataFrame([(2, None, 9), (3, 3, None)], schema), ["user_id"])
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, 1), (2, 2, 9), (3, 3, None)]


def test_keep_faster_prefers_the_stored_one_on_a_tie(spark):
    schema = "user_id long, time_s double, source string"
    got = relational.keep_faster(spark.createDataFrame([(1, 10.0, "old"), (2, 10.0, "old")], schema), spark.createDataFrame([(1, 10.0, "new"), (2, 9.0, "new")], schema), ["user_id"])
    assert {r.user_id: r.source for r in got.collect()} == {1: "old", 2: "new"}


def test_versions_as_of(spark):
    t = dt.datetime
    versions = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP_NTZ'2025-01-10', TIMESTAMP_NTZ'2025-03-05'), (2, TIMESTAMP_NTZ'2025-03-05', CAST(NULL AS TIMESTAMP_NTZ)) AS v(version, active_from, active_to)")
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([t(2025, 1, 9), t(2025, 1, 10), t(2025, 3, 4, 23), t(2025, 3, 5), t(2060, 1, 1)])], "i int, at timestamp_ntz")
    assert {r.i: r.version for r in relational.as_of(rows, versions, "at").collect()} == {1: 1, 2: 1, 3: 2, 4: 2}


def test_fifo(spark):
    earned = spark.createDataFrame([(1, 1, 1, 10), (1, 2, 2, 5), (2, 3, 1, 7)], "user_id long, lot int, at int, points int")
    spent = spark.createDataFrame([(1, 6), (1, 6)], "user_id long, points int")
    assert {r.lot: r.left for r in relational.fifo_expiry(earned, spent).collect()} == {1: 0, 2: 3, 3: 7}
