"""Payloads, quality flags, synthetic athletes and streams against batch."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from cadencia.functions import quality as fq
from cadencia.operators.series import form_curve
from cadencia.sources import provider, synthetic
from cadencia.streaming import jobs

GOOD = {"summaryId": "s1", "userId": "u1", "activityType": "RUNNING", "startTimeInSeconds": 1784529000, "startTimeOffsetInSeconds": 10800, "durationInSeconds": 2700, "distanceInMeters": 10000, "averageHeartRateInBeatsPerMinute": 148, "maxHeartRateInBeatsPerMinute": 172}


def bodies(spark, *items):
    return spark.createDataFrame([(i, x if isinstance(x, str) else json.dumps(x)) for i, x in enumerate(items)], "i int, body string")


def test_activities(spark):
    df = bodies(spark, GOOD, [GOOD, GOOD], GOOD | {"durationInSeconds": 0}, GOOD | {"summaryId": None}, GOOD | {"userId": ""}, GOOD | {"startTimeInSeconds": 900000000}, "{broken", "", "[]", GOOD | {"averageHeartRateInBeatsPerMinute": 300, "activityType": " lap_swimming ", "distanceInMeters": -1})
    got = {r.i: r for r in provider.normalise_activities(df).collect()}
    assert set(got) == {0, 1, 9}
    assert got[0].sport == "run" and got[0].local_date == dt.date(2026, 7, 20) and got[0].avg_speed_m_s == pytest.approx(10000 / 2700)
    assert (got[9].sport, got[9].avg_hr, got[9].distance_m, got[9].avg_speed_m_s) == ("swim", None, None, None)


def test_laps_keep_their_number(spark):
    df = bodies(spark, GOOD | {"laps": [{"durationInSeconds": 0}, {"durationInSeconds": 60, "averageHeartRateInBeatsPerMinute": 140}]})
    (lap,) = provider.normalise_activities(df).first().laps
    assert (lap.lap_index, lap.duration_s, lap.avg_hr) == (2, 60.0, 140.0)


def test_subjects_and_fetches(spark):
    body = {"activities": [{"userId": "u1", "summaryId": "s1"}, {"userId": "u1"}, {"summaryId": "x"}], "sleeps": [{"userId": "u2", "startTimeInSeconds": 1784529000}], "nonsense": [{"userId": "u3"}], "deregistrations": [{"userId": "u4"}]}
    found = provider.subjects(bodies(spark, body, "oops"))
    assert sorted((r.provider_user_id, r.kind) for r in found.collect()) == [("u1", "activity"), ("u1", "activity"), ("u2", "sleep"), ("u4", "deregistration")]
    assert sorted(r.task for r in provider.plan_fetches(found).collect()) == ["activity_details", "activity_summary", "sleep"]


def test_backfill(spark):
    rows = spark.createDataFrame([(1, dt.date(2020, 1, 1), dt.date(2026, 1, 1)), (2, dt.date(2025, 12, 1), dt.date(2026, 1, 1)), (3, dt.date(2026, 1, 1), dt.date(2026, 1, 1))], "id long, since date, until date")
    got = provider.backfill_chunks(rows, ("sleep",)).collect()
    first = sorted((r.window_start, r.window_end) for r in got if r.id == 1)
    assert len(first) == 9 and (first[-1][1] - first[0][0]).days == 730 and {r.id for r in got} == {1, 2}


def assess(spark, **change):
    base = {"sport": "run", "duration_s": 2700.0, "moving_duration_s": None, "distance_m": 10000.0, "avg_speed_m_s": 10000 / 2700, "avg_hr": 148.0, "max_hr": 172.0, "avg_power_w": None, "normalised_power_w": None, "elevation_gain_m": None, "is_manual": False, "laps": [], "max_plausible_speed_m_s": None, "max_plausible_power_w": None, "max_plausible_duration_s": None, "hr_max_bound": None} | change
    schema = "sport string, duration_s double, moving_duration_s double, distance_m double, avg_speed_m_s double, avg_hr double, max_hr double, avg_power_w double, normalised_power_w double, elevation_gain_m double, is_manual boolean, laps array<struct<duration_s:double>>, max_plausible_speed_m_s double, max_plausible_power_w double, max_plausible_duration_s double, hr_max_bound int"
    r = spark.createDataFrame([tuple(base.values())], schema).withColumn("flags", fq.flags()).withColumns({"q": fq.score(F.col("flags"), "quality_penalty"), "t": fq.score(F.col("flags"), "trust_penalty")}).withColumn("held", fq.held(F.col("t"))).first()
    return r.q, r.t, r.held, [f.code for f in r.flags]


def test_quality(spark):
    assert assess(spark) == (1.0, 1.0, False, [])
    assert assess(spark, is_manual=True)[:3] == (0.75, 0.65, False)
    assert assess(spark, is_manual=True, avg_speed_m_s=6.0)[2]
    assert assess(spark, avg_hr=175.0, max_hr=170.0, moving_duration_s=3000.0) == (0.3, 1.0, False, ["hr_average_exceeds_max", "moving_time_exceeds_elapsed"])
    assert assess(spark, distance_m=None, avg_speed_m_s=None, avg_hr=None, max_hr=None)[3] == ["no_sensor_channels"]
    assert assess(spark, duration_s=0.0)[:3] == (0.0, 0.0, True)
    assert assess(spark, max_hr=149.0)[3] == ["hr_flatline"]
    assert assess(spark, avg_power_w=2600.0, normalised_power_w=2000.0)[3] == ["power_physically_impossible", "normalised_power_below_average"]


def test_synthetic_athletes_rest_and_repeat(spark):
    who = spark.createDataFrame([("a",), ("b",)], "athlete string")
    rows = synthetic.activities(who, n=28).collect()
    assert len(rows) == 48 and {r.day.weekday() for r in rows} == {0, 1, 2, 3, 5, 6}
    again = synthetic.activities(who.filter("athlete = 'b'"), "2026-01-10", 5).collect()
    by = {(r.athlete, r.day): r.duration_s for r in rows}
    assert again and all(by[(r.athlete, r.day)] == r.duration_s for r in again)
    nights = synthetic.wellness(who, n=60).collect()
    assert all(r.sleep_h < 6 for r in nights if 40 <= r.since <= 46) and {0, 23, 46}.isdisjoint({r.since for r in nights})


def run_stream(query):
    query.processAllAvailable()
    query.awaitTermination(120)


def test_stream_of_loads_equals_batch(spark, tmp_path):
    rows = [(u, dt.date(2026, 1, 1) + dt.timedelta(k), float((k * 7 + u) % 90)) for u in (1, 2, 3) for k in range(0, 40) if (k + u) % 4]
    schema = "user_id long, day date, load double"
    for part in range(4):
        some = [r for r in rows if (r[1] - dt.date(2026, 1, 1)).days // 10 == part]
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = jobs.form_updates(jobs.file_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema))
    run_stream(jobs.write_once(stream, f"{tmp_path}/out", f"{tmp_path}/cp"))
    got = {(r.user_id, r.day): (r.ctl, r.atl) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r.user_id, r.day): (r.ctl, r.atl) for r in form_curve(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=0.011) for k in want)


def test_form_updates_over_frames_in_any_order(spark, tmp_path):
    rows = [(u, dt.date(2026, 1, 1) + dt.timedelta(days=(i * 7) % 40), float(20 + u * i)) for u in (1, 2) for i in range(40)]
    schema = "user_id bigint, day date, load double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "3")  # an athlete's days come in several frames, in the order of the file
    try:
        stream = jobs.form_updates(jobs.file_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema))
        run_stream(jobs.write_once(stream, f"{tmp_path}/out", f"{tmp_path}/cp"))
    finally:
        spark.conf.unset(key)
    got = {(r.user_id, r.day): (r.ctl, r.atl) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r.user_id, r.day): (r.ctl, r.atl) for r in form_curve(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=0.011) for k in want)


def test_stream_dedupes_and_coalesces(spark, tmp_path):
    t = dt.datetime(2026, 1, 1, 8)
    rows = [(f"k{i % 5}", 1 + i % 2, dt.date(2026, 1, 1 + i % 3), t + dt.timedelta(seconds=i * 7)) for i in range(20)]
    schema = "event_key string, user_id int, local_date date, received_at timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    events = jobs.file_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
    run_stream(jobs.write_once(jobs.deduplicated(events), f"{tmp_path}/once", f"{tmp_path}/cp1"))
    assert sorted(r.event_key for r in spark.read.parquet(f"{tmp_path}/once").collect()) == [f"k{i}" for i in range(5)]
    jobs_of = jobs.coalesced_recomputes(events)
    query = jobs_of.writeStream.format("memory").queryName("recomputes").outputMode("complete").trigger(availableNow=True).start()
    run_stream(query)
    got = {(r.user_id, r.window_start): (r.from_day, r.events) for r in spark.table("recomputes").collect()}
    batch = spark.createDataFrame(rows, schema).groupBy("user_id", F.window("received_at", "60 seconds").start.alias("w")).agg(F.min("local_date").alias("d"), F.count("*").alias("n"))
    assert got == {(r.user_id, r.w): (r.d, r.n) for r in batch.collect()}


def test_late_day_is_recomputed_from_the_earliest(spark):
    loads = spark.createDataFrame([(u, dt.date(2026, 1, 1) + dt.timedelta(k), 50.0) for u in (1, 2) for k in range(10)], "user_id long, day date, load double")
    changed = spark.createDataFrame([(1, dt.date(2026, 1, 4)), (1, dt.date(2026, 1, 7))], "user_id long, day date")
    got = jobs.recompute_from(loads, changed).collect()
    assert {r.user_id for r in got} == {1} and min(r.day for r in got) == dt.date(2026, 1, 4) and len(got) == 7
