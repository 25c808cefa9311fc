"""Checks, redaction, versions, ranks, readers and streams beyond what the queries' tables hold."""

import datetime as dt
import gzip
import json
import uuid

import pytest
from pyspark.sql import functions as F

from cadencia.functions import load, validation
from cadencia.operators import relational as rel
from cadencia.sources import provider, registry, sinks
from cadencia.streaming import jobs


def at(year, month=1, day=1):
    return dt.datetime(year, month, day)


def test_versions_of_any_span_and_age(spark):
    versions = spark.createDataFrame([(1, at(1800), at(1950)), (2, at(1950), at(2101)), (3, at(2101), None)], "version int, active_from timestamp_ntz, active_to timestamp_ntz")
    rows = spark.createDataFrame([(k, at(y)) for k, y in enumerate((1799, 1800, 1949, 1950, 2100, 2101, 2500))], "k int, at timestamp_ntz")
    assert sorted((r.k, r.version) for r in rel.as_of(rows, versions, "at").collect()) == [(1, 1), (2, 1), (3, 2), (4, 2), (5, 3), (6, 3)]
    assert rel.as_of(rows.limit(0), versions, "at").count() == 0


def test_rank_of_equal_scores(spark):
    rows = [("g", 5 if i % 3 else 7, i * 1000) for i in range(3000)] + [("h", 1, 4), ("h", 1, 5)]
    got = rel.ranked(spark.createDataFrame(rows, "g string, s int, id long"), "g", "s", "id").collect()
    for group in "gh":
        want = sorted((-s, i) for g, s, i in rows if g == group)
        places = {r.id: (r.rank, r.place) for r in got if r.g == group}
        assert places == {i: (1 + next(k for k, x in enumerate(want) if x[0] == s), k + 1) for k, (s, i) in enumerate(want[:50])} | {i: places[i] for _, i in want[50:]}
        assert [places[i][1] for _, i in want] == list(range(1, len(want) + 1))
    assert rel.ranked(spark.createDataFrame([], "g string, s int, id long"), "g", "s", "id").count() == 0


def test_missing_values_pass_each_check(spark):
    schema = "duration_s int, moving_time_s int, avg_hr double, max_hr double, rpe double"
    rows = spark.createDataFrame([(60, None, None, None, None), (None, 5, 300.0, 200.0, 0.5), (604800, 604801, None, None, 10.0)], schema)
    got = [r[0] for r in rows.select(validation.failed(validation.activity_checks(rows.columns))).collect()]
    assert got == [[], ["avg_hr", "duration_missing", "hr_order", "rpe"], ["duration_s", "moving_order"]]
    best = spark.createDataFrame([("swim", 400.0, 100.0, dt.date(2020, 1, 1)), ("run", 100.0, 0.0, dt.date(2020, 1, 1)), ("run", 100.0, 20.0, dt.date(2999, 1, 1))], "sport string, distance_m double, time_s double, achieved_on date")
    assert [r[0] for r in best.select(validation.failed(validation.personal_best_checks())).collect()] == [["speed"], ["time_s"], ["achieved_on"]]


def test_redaction(spark):
    row = spark.range(1).select(F.map_from_arrays(F.array(*(F.lit(k) for k in ("Athlete_Email", "user_id", "avg_hr_bpm", "path"))), F.array(*(F.lit(x) for x in "abcd"))).alias("m"))
    assert row.select(rel.redacted(F.col("m"))).first()[0] == {"Athlete_Email": "[redacted]", "user_id": "b", "avg_hr_bpm": "[redacted]", "path": "d"}


def test_ids_are_of_version_7_and_in_order(spark):
    rows = spark.range(50).select(rel.uuid7(F.lit(1700000000000) + F.floor(F.col("id") / 10), F.col("id") % 10, F.xxhash64("id")).alias("u"))
    ids = [uuid.UUID(r.u) for r in rows.withColumn("ms", rel.uuid7_milliseconds(F.col("u"))).collect()]
    assert {u.version for u in ids} == {7} and {u.variant for u in ids} == {uuid.RFC_4122}
    assert [u.int >> 64 for u in ids] == sorted(u.int >> 64 for u in ids)
    v4 = spark.createDataFrame([(str(uuid.uuid4()),)], "u string").select(rel.uuid7_milliseconds(F.col("u"))).first()[0]
    assert v4 is None


def test_digest_of_samples_is_of_canonical_json(spark):
    import hashlib

    samples = [{"b": 1, "a": 2.50}, {"c": "x", "a": -3, "d": None, "e": True}]
    body = '{"samples": ' + json.dumps(samples, indent=1) + "}"
    got = spark.createDataFrame([(body,), ('{"samples":[]}',), ("{}",), ("oops",)], "body string").select(provider.stream_blob(F.col("body")).alias("b")).collect()
    want = json.dumps(samples, separators=(",", ":"), sort_keys=True)
    assert got[0].b.content == want and got[0].b.checksum == hashlib.sha256(want.encode()).hexdigest() and got[0].b.channels == ["a", "b", "c", "d", "e"]
    assert [r.b for r in got[1:]] == [None, None, None]


def test_registry():
    found = registry.default_registry()
    assert found.names() == ("provider", "synthetic")
    assert found.supporting("wellness") == ("provider", "synthetic") and found.supporting("streams") == ("synthetic",) and found.supporting("x") == ()
    found.register(found.get("provider"))
    with pytest.raises(ValueError):
        found.register(registry.Reader("provider"))
    with pytest.raises(LookupError):
        found.get("nobody")
    with pytest.raises(LookupError):
        found.get("provider").read("streams", None)


def test_no_effort_out_of_range(spark):
    rows = spark.createDataFrame([(30.0, 5.0), (30.0, 11.0), (30.0, 0.5), (-1.0, 99.0), (0.0, None)], "m double, rpe double")
    got = [r[0] for r in rows.select(load.rpe_load(F.col("m"), F.col("rpe"))).collect()]
    assert got[0] == pytest.approx(30 * 5 / 4.2) and got[1:] == [None, None, 0.0, None]


def test_table_of_versions_takes_each_batch_once(spark, tmp_path):
    schema = spark.createDataFrame([], "id long, at int, v string").schema
    target = sinks.VersionedTable(spark, str(tmp_path), ["id"], ["at"], schema)
    assert target.read().count() == 0
    batch = lambda *rows: spark.createDataFrame(rows, schema)
    target.upsert(batch((1, 1, "a"), (2, 5, "b")), 0)
    target.upsert(batch((1, 2, "c"), (2, 4, "late")), 1)
    target.upsert(batch((1, 9, "again")), 1)  # a batch that runs again
    target.upsert(batch((3, 1, "d"), (2, 5, "tie")), 2)
    assert sorted(tuple(r) for r in target.read().collect()) == [(1, 2, "c"), (2, 5, "tie"), (3, 1, "d")]
    assert target.versions() == [1, 2]


def test_streams_of_gzipped_json_and_of_two_priorities(spark, tmp_path):
    (tmp_path / "in").mkdir()
    with gzip.open(tmp_path / "in" / "a.json.gz", "wt") as f:
        f.write('{"id": 1}\n{"id": 2}\noops\n')
    rows = jobs.json_stream(spark, str(tmp_path / "in"), "id long")
    jobs.write_once(rows, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted((r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=str) == [1, 2, None]
    spark.range(3).write.parquet(str(tmp_path / "live"))
    spark.range(2).write.parquet(str(tmp_path / "old"))
    live, old = jobs.prioritised(spark, str(tmp_path / "live"), str(tmp_path / "old"), "id long")
    for k, s in enumerate((live, old)):
        jobs.write_once(s, str(tmp_path / f"out{k}"), str(tmp_path / f"checkpoint{k}")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out0")).unionByName(spark.read.parquet(str(tmp_path / "out1")))
    assert sorted((r.priority, r.id) for r in found.collect()) == [("backfill", 0), ("backfill", 1), ("live", 0), ("live", 1), ("live", 2)]
