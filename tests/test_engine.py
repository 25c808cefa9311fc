"""Hand-computed values, invariants and the sequential recurrences against the operators."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from cadencia.functions import efficiency as fe
from cadencia.functions import load as fl
from cadencia.functions import performance as fp
from cadencia.functions import stats as fs
from cadencia.functions import zones as fz
from cadencia.operators import plan, readiness, relational, series, trend
from cadencia.params import READINESS_WEIGHTS, RISK_COEFFICIENTS, RISK_INTERCEPT

REF = dt.date(2026, 6, 15)


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_trimp(spark):
    t = lambda sex: fl.trimp(F.lit(60.0), F.lit(150.0), F.lit(50), F.lit(200), F.lit(sex))
    r = one(spark, t("male"), t("female"), t("unspecified"), fl.trimp(F.lit(60.0), F.lit(150.0), F.lit(200), F.lit(200), F.lit("male")))
    assert r[0] == pytest.approx(92.074, abs=1e-3) and r[1] == pytest.approx(104.730, abs=1e-3)
    assert r[2] == pytest.approx((r[0] + r[1]) / 2) and r[3] is None


PROFILE = "user_id long, sex string, age int, hr_max int, hr_rest int, lthr int, ftp_watts double, run_threshold_power_w double, threshold_pace_s_per_km double, css_s_per_100m double"
ACTIVITY = "user_id long, activity_id long, sport string, duration_s int, moving_time_s int, distance_m double, avg_hr double, avg_power double, normalized_power double, rpe double"


def scored(spark, activities, profile=(1, "male", 35, 190, 50, 170, 250.0, None, 240.0, 95.0)):
    rows = series.score_sessions(spark.createDataFrame(activities, ACTIVITY), spark.createDataFrame([profile], PROFILE))
    return {r.activity_id: (r.load, r.load_source) for r in rows.collect()}


def test_one_threshold_hour_is_100_for_every_source(spark):
    got = scored(
        spark,
        [
            (1, 1, "bike", 3600, None, None, None, 250.0, None, None),
            (1, 2, "run", 3600, None, None, 170.0, None, None, None),
            (1, 3, "run", 3600, None, 15000.0, None, None, None, None),
            (1, 4, "swim", 3600, 3600, 3600 / 95 * 100, None, None, None, None),
            (1, 5, "other", 3600, None, None, None, None, None, 7.0),
            (1, 6, "bike", 3600, None, None, None, 200.0, None, None),
            (1, 7, "strength", 3600, None, None, 0.0, None, None, None),
            (2, 8, "run", 3600, None, None, 150.0, None, None, 7.0),
        ],
    )
    assert got == {1: (100.0, "power"), 2: (100.0, "heart_rate"), 3: (100.0, "pace"), 4: (100.0, "pace"), 5: (100.0, "rpe"), 6: (64.0, "power"), 7: (0.0, "none"), 8: (100.0, "rpe")}


def test_estimated_anchors_round_half_even(spark):
    r = one(spark, fl.effective_hr_max(F.lit(None).cast("int"), F.lit(45)), fl.effective_lthr(F.lit(None).cast("int"), F.lit(185)), fl.effective_hr_max(F.lit(0), F.lit(0)))
    assert tuple(r) == (176, 166, None)


def recurrence(loads, first, last, days, seed=0.0):
    out, y, alpha = {}, seed, 1 - math.exp(-1 / days)
    for k in range((last - first).days + 1):
        day = first + dt.timedelta(k)
        y += alpha * (loads.get(day, 0.0) - y)
        out[day] = y
    return out


def test_form_curve_is_the_daily_recurrence_over_gaps(spark):
    loads = {REF + dt.timedelta(k): 10.0 + k % 7 * 13 for k in (0, 1, 2, 9, 10, 40, 41, 100, 399)}
    got = series.form_curve(spark.createDataFrame([(1, d, x) for d, x in loads.items()], "user_id long, day date, load double"), 30.0, 20.0).collect()
    ctl, atl = (recurrence(loads, min(loads), max(loads), n, s) for n, s in ((42, 30.0), (7, 20.0)))
    for r in got:
        assert r.ctl == pytest.approx(ctl[r.day], abs=0.006) and r.atl == pytest.approx(atl[r.day], abs=0.006)
        assert r.tsb == pytest.approx(r.ctl - r.atl)


def daily(spark, loads):
    return spark.createDataFrame([(1, REF - dt.timedelta(k), float(x)) for k, x in loads.items()], "user_id long, day date, load double")


def last(rows):
    return rows.filter(F.col("day") == F.lit(REF)).first()


def test_workload(spark):
    constant = last(series.workload(daily(spark, dict.fromkeys(range(60), 50))))
    assert (constant.acwr, constant.acwr_zone, constant.acwr_reliable, constant.monotony, constant.ramp_pct) == (1.0, "sweet_spot", True, None, 0.0)
    spike = last(series.workload(daily(spark, {k: 120 if k < 7 else 20 for k in range(29)})))
    assert spike.acwr_zone == "danger"
    ramp = last(series.workload(daily(spark, {k: 110 if k < 7 else 100 for k in range(14)})))
    assert ramp.ramp_pct == 10.0 and not ramp.acwr_reliable
    assert last(series.workload(daily(spark, {0: 100, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0}))).monotony == 0.378
    assert last(series.acwr_ewma(daily(spark, dict.fromkeys(range(60), 50)))).acwr == 1.0


def test_normalised_power(spark):
    rows = [("flat", i, 200.0) for i in range(600)] + [("short", i, 300.0) for i in range(10)] + [("steps", i, 300.0 if i // 60 % 2 == 0 else 100.0) for i in range(1200)]
    got = {r.k: r.normalized_power for r in series.normalised_power(spark.createDataFrame(rows, "k string, i int, value double"), "k", ["i"]).collect()}
    assert got["flat"] == pytest.approx(200) and got["short"] is None and got["steps"] > 200


WELLNESS = "user_id long, day date, hrv_rmssd_ms double, resting_hr double, sleep_total_min double, sleep_deep_min double, sleep_rem_min double, sleep_efficiency_pct double, soreness int, mood int, stress int, fatigue int"


def steady(today):
    rows = []
    for k in range(40, 0, -1):
        w = k % 5 - 2
        sleep = 480.0 + 5 * w
        rows.append((1, REF - dt.timedelta(k), 60.0 + w, 50 + 0.5 * w, sleep, 0.22 * sleep, 0.24 * sleep, 92.0, 2, 2, 2, 2))
    return [*rows, (1, REF, *today)]


def ready(spark, today, loads=None):
    rows = readiness.athlete_days(spark.createDataFrame(steady(today), WELLNESS), daily(spark, loads or dict.fromkeys(range(60), 50)))
    return readiness.readiness(rows)


def test_readiness_drivers_rebuild_the_score(spark):
    good = last(ready(spark, (60.0, 50.0, 480.0, 105.0, 115.0, 92.0, 2, 2, 2, 2)))
    bad = last(ready(spark, (45.0, 58.0, 300.0, 30.0, 40.0, 70.0, 5, 5, 5, 5)))
    for r in (good, bad):
        assert r.data_quality == 1.0 and len(r.drivers) == 5
        assert sum(d.contribution for d in r.drivers) == pytest.approx(r.readiness - 50, abs=0.1)
        sizes = [abs(d.contribution) for d in r.drivers]
        assert sizes == sorted(sizes, reverse=True)
    assert bad.readiness < 40 < good.readiness
    assert sum(READINESS_WEIGHTS.values()) == pytest.approx(1)


def test_readiness_without_data_refuses(spark):
    rows = spark.createDataFrame([(1, REF, *[None] * 10)], WELLNESS)
    r = readiness.readiness(readiness.athlete_days(rows, daily(spark, {}).limit(0))).first()
    assert (r.readiness, r.data_quality, r.refusal, r.drivers) == (50.0, 0.0, "insufficient_data", [])


def test_risk_drivers_and_intercept_make_the_logit(spark):
    profile = spark.createDataFrame([(1, 50, 1, 2.0)], "user_id long, age int, injuries_last_12m int, training_age_years double")
    r = last(readiness.injury_risk(ready(spark, (45.0, 58.0, 300.0, 30.0, 40.0, 70.0, 5, 5, 5, 5), {k: 130 if k < 8 else 30 for k in range(57)}), profile))
    logit = RISK_INTERCEPT + sum(d.contribution for d in r.risk_drivers)
    assert r.risk == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-3)
    assert {d.name for d in r.risk_drivers} >= {"prior_injury", "age_over_40", "training_age", "acwr_excess"}
    assert 1 / (1 + math.exp(-RISK_INTERCEPT)) == pytest.approx(0.0691, abs=1e-4) and len(RISK_COEFFICIENTS) == 10


def test_adaptation_ladder(spark):
    rows = [("vo2max", True, 80.0, 1.0, "low"), ("threshold", True, 60.0, 1.0, "low"), ("easy", True, 60.0, 1.0, "low"), ("tempo", True, 40.0, 1.0, "low"), ("tempo", True, 20.0, 1.0, "low"), ("threshold", True, 90.0, 1.0, "very_high"), ("tempo", True, 10.0, 0.2, "low"), (None, None, 90.0, 1.0, "low")]
    df = spark.createDataFrame([(i, *r, 60, 90.0) for i, r in enumerate(rows)], "i int, intensity string, is_key boolean, readiness double, data_quality double, risk_band string, duration_min int, target_load double")
    drivers = F.when(F.col("i") != 3, F.array(F.struct(F.lit("hrv").alias("name"))))
    df = df.withColumns({"band": F.when(F.col("readiness") < 25, "compromised").otherwise("good"), "drivers": drivers})
    got = [(r.action, r.new_intensity, r.new_duration_min, r.new_load) for r in readiness.adapt_today(df).orderBy("i").collect()]
    assert got == [("as_planned", "vo2max", 60, 90.0), ("reduce_intensity", "tempo", 54, 67.5), ("reduce_volume", "easy", 48, 72.0), ("easy_only", "easy", 36, 45.0), ("rest", None, None, None), ("reduce_intensity", "tempo", 51, 67.5), ("as_planned", "tempo", 60, 90.0), ("rest", None, None, None)]
    said = {r.i: (r.reason, r.new_notes) for r in readiness.adapt_today(df).collect()}
    assert said[0] == ("Readiness 80/100 (good). Go as planned.", "Zone 5 intervals with full recoveries between reps.")
    assert said[1] == ("Readiness 60/100, held back by hrv. One intensity band down.", "Zone 3 blocks with full warm-up and cool-down.")
    assert said[3] == ("Readiness 40/100, limited by recovery data. Aerobic only today; the quality work moves.", "Zone 2. Conversational the whole way.")
    assert said[4] == ("Readiness 20/100 (compromised), driven by hrv. Full rest today.", None)
    assert said[6][0].startswith("Not enough recovery data") and said[7] == ("No session scheduled today.", None)


def test_zones(spark):
    power = fz.power_zones(F.lit(250.0))
    r = one(spark, F.get(power, F.lit(3)).low, F.get(power, F.lit(3)).high, fz.zone_of(F.lit(1000.0), power), fz.zone_of(F.lit(80.0), fz.hr_zones(F.lit(None).cast("int"), F.lit(190))), fz.zone_of(F.lit(170.0), fz.hr_zones(F.lit(170), F.lit(190))))
    assert (r[0], r[1], r[2], r[3], r[4]) == (227.5, 265.0, 7, None, 5)
    pace = fz.pace_zones(F.lit(240.0))
    assert tuple(one(spark, fz.zone_of(F.lit(400.0), pace), fz.zone_of(F.lit(200.0), pace))) == (1, 5)


def test_performance(spark):
    five = F.lit(5000.0)
    r = one(spark, fp.vdot(five, F.lit(1200.0)), fp.time_from_vdot(fp.vdot(five, F.lit(1200.0)), five), *fp.critical_speed(F.lit(1000.0), F.lit(200.0), F.lit(3000.0), F.lit(660.0)), fp.time_from_vdot(F.lit(1.0), F.lit(42195.0)))
    assert r[0] == pytest.approx(49.81, abs=0.005) and r[1] == pytest.approx(1200.0, abs=0.01)
    assert (r[2], r[3], r[4]) == (4.3478, 130.4, 43200.0)
    bests = [(1, d, 1200 * (d / 5000) ** 1.08) for d in (1500.0, 5000.0, 10000.0, 21097.5)] + [(2, 1500.0, 300.0), (2, 5000.0, 1200.0), (2, 42195.0, 30000.0), (3, 5000.0, 1200.0)]
    got = {r.user_id: (r.exponent, r.r2) for r in trend.riegel_fit(spark.createDataFrame(bests, "user_id long, dist double, t double")).collect()}
    assert got[1] == (1.08, 1.0) and 1.0 <= got[2][0] <= 1.2 and got[3] == (1.06, 0.0)
    assert tuple(one(spark, *fp.estimated_1rm(F.lit(100.0), F.lit(5)))) == (116.7, 112.5, 114.6, True)


def test_forecast_has_an_interval_and_needs_three_values(spark):
    rows = [(1, REF - dt.timedelta(7 * (9 - k)), 1250 - 2 * k + (-1) ** k * 0.5) for k in range(10)] + [(2, REF, 10.0), (2, REF - dt.timedelta(7), 11.0)]
    got = trend.progression_forecast(spark.createDataFrame(rows, "user_id long, day date, value double"), 28).collect()
    assert [r.user_id for r in got] == [1]
    assert got[0].low < got[0].value < got[0].high and got[0].value < 1232 and got[0].confidence > 0.9
    p = one(spark, fs.normal_below(F.lit(1.96), F.lit(0.0), F.lit(1.0)), fs.normal_below(F.lit(-1.0), F.lit(0.0), F.lit(1.0)), fs.normal_below(F.lit(1.0), F.lit(1.0), F.lit(0.0)))
    assert p[0] == pytest.approx(0.9750021, abs=2e-7) and p[1] == pytest.approx(0.1586553, abs=2e-7) and p[2] == 1.0


def test_decoupling_prefers_power(spark):
    half = lambda hr, power, speed: F.struct(F.lit(hr).alias("avg_hr"), F.lit(power).cast("double").alias("avg_power"), F.lit(speed).cast("double").alias("avg_speed_m_s"))
    r = one(spark, fe.decoupling_pct(half(140.0, 200.0, 3.0), half(150.0, 200.0, 3.0)), fe.decoupling_pct(half(0.0, 200.0, 3.0), half(150.0, 200.0, 3.0)))
    assert tuple(r) == (6.67, None)


REQUEST = "id long, weeks int, sessions_per_week int, level string, current_ctl double, has_race boolean, primary_sport string, secondary_sports array<string>"


def test_plan(spark):
    rows = spark.createDataFrame([(1, 12, 5, "intermediate", 60.0, True, "run", []), (2, 1, 1, "beginner", 0.0, False, "bike", ["swim", "run"]), (3, 8, 14, "advanced", 10.0, True, "swim", ["bike"])], REQUEST)
    weeks = plan.weeks(rows)
    one_plan = weeks.filter("id = 1").orderBy("week").collect()
    assert one_plan[0].load == 420.0 and [w.phase for w in one_plan] == ["base", "base", "base", "recovery", "build", "build", "build", "recovery", "peak", "peak", "taper", "taper"]
    grown = [w.load for w in one_plan if w.phase not in ("recovery", "taper")]
    assert all(b <= a * 1.08 + 1e-9 for a, b in zip(grown, grown[1:], strict=False))
    assert one_plan[-1].load == pytest.approx(0.5 * max(grown))
    sessions = plan.sessions(weeks).collect()
    assert len([s for s in sessions if s.id == 1]) == 60 and all(s.duration_min >= 20 for s in sessions)
    assert {s.day_offset for s in sessions if s.id == 1 and s.week == 0} == {0, 1, 3, 4, 6}
    assert {s.title for s in sessions if s.id == 1 and s.week == 0} == {"Key Run Tempo", "Long Run Aerobic", "Run Aerobic"}
    total = sum(s.target_load for s in sessions if s.id == 1 and s.week == 0)
    assert total == pytest.approx(420, abs=0.5)


def test_tenant_scope_and_grants(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "user_id long, x string")
    assert [r.x for r in relational.tenant_scope(rows, 2).collect()] == ["b"]
    assert relational.tenant_scope(rows, 9).count() == relational.tenant_scope(rows, None).count() == 0
    now, later, past = dt.datetime(2026, 1, 1), dt.datetime(2026, 2, 1), dt.datetime(2025, 1, 1)
    grants = spark.createDataFrame([(1, 9, ["x"], later, None), (2, 9, ["x"], past, None), (3, 9, ["x"], later, past), (3, 9, ["y"], later, None)], "grantor long, grantee long, scopes array<string>, expires_at timestamp, revoked_at timestamp")
    assert [r.user_id for r in relational.granted_rows(rows, grants, 9, "x", F.lit(now)).collect()] == [1]


def test_ledger(spark):
    lines = [(1, 1, 1, "house", "debit", "USD", 10000), (1, 1, 1, "redeemable", "credit", "USD", 5000), (1, 1, 1, "withdrawable", "credit", "USD", 5000), (2, 1, 1, "house", "credit", "USD", 3)]
    df = spark.createDataFrame(lines, "transaction_id long, wallet_id long, user_id long, account string, direction string, currency string, amount_minor long")
    assert {r.account: r.balance_minor for r in relational.wallet_balances(df).collect()} == {"house": -9997, "redeemable": 5000, "withdrawable": 5000}
    assert [tuple(r) for r in relational.unbalanced(df).collect()] == [(2, 3)]


def test_streaks(spark):
    days = [REF + dt.timedelta(k) for k in (0, 1, 2, 5, 6, 9)]
    got = relational.streaks(spark.createDataFrame([(1, d) for d in days], "user_id long, day date")).orderBy("start")
    assert [r.length for r in got.collect()] == [3, 2, 1]
