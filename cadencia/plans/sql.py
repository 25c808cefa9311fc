"""SQL of the bridge and of the daily series, which the oracles of the queries begin with."""

PROFILES = """
profiles AS (
  SELECT c_custkey AS user_id, c_custkey AS k, c_nationkey AS group_id,
    CASE c_custkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' ELSE 'unspecified' END AS sex,
    CASE WHEN c_custkey % 11 <> 0 THEN 18 + c_custkey * 7 % 50 END AS age,
    CASE WHEN c_custkey % 4 <> 0 THEN 175 + c_custkey * 3 % 25 END AS hr_max,
    CASE WHEN c_custkey % 5 <> 0 THEN 45 + c_custkey % 15 END AS hr_rest,
    CASE WHEN c_custkey % 3 <> 0 THEN 150 + c_custkey * 5 % 20 END AS lthr,
    CAST(CASE WHEN c_custkey % 6 <> 0 THEN 180 + c_custkey * 11 % 140 END AS DOUBLE) AS ftp,
    CAST(CASE WHEN c_custkey % 9 = 0 THEN 220 + c_custkey % 80 END AS DOUBLE) AS run_power,
    CAST(CASE WHEN c_custkey % 5 <> 1 THEN 220 + c_custkey * 13 % 120 END AS DOUBLE) AS pace,
    CAST(CASE WHEN c_custkey % 7 <> 1 THEN 85 + c_custkey * 3 % 40 END AS DOUBLE) AS css,
    CASE WHEN c_custkey % 8 <> 3 THEN (c_custkey % 40) / 2.0::DOUBLE END AS training_age,
    CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS injuries,
    CASE c_custkey % 3 WHEN 0 THEN 'beginner' WHEN 1 THEN 'intermediate' ELSE 'advanced' END AS level
  FROM customer
), anchors AS (
  SELECT *, coalesce(lthr, CAST(round_even(hm * 0.9::DOUBLE, 0) AS INT)) AS lt, coalesce(hr_rest, 60) AS rest
  FROM (SELECT *, coalesce(hr_max, CAST(round_even(208::DOUBLE - 0.7::DOUBLE * age, 0) AS INT)) AS hm FROM profiles)
)"""

ACTIVITIES = """
raw_events AS (
  SELECT user_id, event_id AS e, ts, CAST(ts AS DATE) AS day, CAST(json_extract_string(props, '$.k') AS INT) AS k,
    CASE event_type WHEN 'view' THEN 'run' WHEN 'click' THEN 'bike' WHEN 'purchase' THEN 'swim' WHEN 'signup' THEN 'strength' ELSE 'other' END AS sport,
    CAST(900 + event_id * 37 % 6300 AS INT) AS d
  FROM events
), activities AS (
  SELECT *, CASE WHEN e % 4 = 1 THEN avg_power * (95 + e % 20) / 100.0::DOUBLE END AS np, avg_hr + (e % 30) - 2 AS max_hr,
    CASE WHEN e % 6 <> 0 THEN dist / d * (80 + e % 50) / 100.0::DOUBLE END AS avg_speed
  FROM (
    SELECT *, CASE WHEN e % 3 <> 0 THEN d - e * 13 % 300 END AS mov,
      d * (CASE sport WHEN 'run' THEN 2400 + e * 7 % 1600 WHEN 'bike' THEN 6000 + e * 11 % 5000 WHEN 'swim' THEN 800 + e * 3 % 600 END) / 1000.0::DOUBLE AS dist,
      CAST(CASE WHEN e % 7 <> 0 THEN 110 + k % 70 END AS DOUBLE) AS avg_hr,
      CAST(CASE WHEN sport IN ('run', 'bike') AND e % 5 <> 0 THEN 120 + 2 * k END AS DOUBLE) AS avg_power,
      CAST(CASE WHEN e % 4 <> 0 THEN 1 + e % 10 END AS DOUBLE) AS rpe, e % 13 = 0 AS is_manual, CAST(e * 17 % 900 AS DOUBLE) AS gain,
      CASE WHEN sport = 'swim' THEN 600 + e * 7 % 900 END AS strokes, CAST(CASE WHEN sport = 'swim' THEN 25 * (1 + e % 2) END AS DOUBLE) AS pool
    FROM raw_events
  )
)"""

# TRIMP as a macro-like fragment: minutes, heart rate
_TRIMP = """(({m}) * greatest(0, least(1, (({hr}) - rest) / CAST(hm - rest AS DOUBLE))) * CASE sex
  WHEN 'male' THEN 0.64 * exp(1.92 * greatest(0, least(1, (({hr}) - rest) / CAST(hm - rest AS DOUBLE))))
  WHEN 'female' THEN 0.86 * exp(1.67 * greatest(0, least(1, (({hr}) - rest) / CAST(hm - rest AS DOUBLE))))
  ELSE (0.64 * exp(1.92 * greatest(0, least(1, (({hr}) - rest) / CAST(hm - rest AS DOUBLE)))) + 0.86 * exp(1.67 * greatest(0, least(1, (({hr}) - rest) / CAST(hm - rest AS DOUBLE))))) / 2 END)"""


def trimp(minutes: str, hr: str) -> str:
    return _TRIMP.format(m=minutes, hr=hr)


SESSIONS = f"""
scored AS (
  SELECT *, CASE sport WHEN 'bike' THEN coalesce(l_power, l_hr, l_rpe) WHEN 'run' THEN coalesce(l_power, l_hr, l_pace, l_rpe)
      WHEN 'swim' THEN coalesce(l_pace, l_hr, l_rpe) ELSE coalesce(l_hr, l_rpe) END AS best,
    CASE WHEN sport IN ('bike', 'run') AND l_power IS NOT NULL THEN 'power' WHEN sport = 'swim' AND l_pace IS NOT NULL THEN 'pace'
      WHEN l_hr IS NOT NULL THEN 'heart_rate' WHEN sport = 'run' AND l_pace IS NOT NULL THEN 'pace' WHEN l_rpe IS NOT NULL THEN 'rpe' ELSE 'none' END AS source
  FROM (
    SELECT *, 100 * act / 3600 * power(pw / thr, 2) AS l_power,
      CASE WHEN hm > rest AND avg_hr IS NOT NULL THEN 100 * {trimp("d / 60.0::DOUBLE", "avg_hr")} / nullif({trimp("60.0::DOUBLE", "lt")}, 0) END AS l_hr,
      CASE sport WHEN 'swim' THEN 100 * act / 3600 * power(css / (100 * act / dist), 3) ELSE 100 * act / 3600 * power(pace / (1000 * act / dist), 2) END AS l_pace,
      d / 60.0::DOUBLE * rpe * (100.0::DOUBLE / 420.0::DOUBLE) AS l_rpe
    FROM (
      SELECT a.*, p.* EXCLUDE (user_id, k), CAST(coalesce(mov, d) AS DOUBLE) AS act, coalesce(np, avg_power) AS pw,
        CASE sport WHEN 'bike' THEN ftp WHEN 'run' THEN run_power END AS thr
      FROM activities a LEFT JOIN anchors p ON a.user_id = p.user_id
    )
  )
), sessions AS (
  SELECT *, round(coalesce(best, 0) + 1e-9, 2) AS load FROM scored
), daily AS (
  SELECT user_id, day, sum(load) AS load, count(*) AS sessions FROM sessions GROUP BY user_id, day
)"""

FORM = """
numbered AS (
  SELECT *, date_diff('day', DATE '1970-01-01', day) AS n, date_diff('day', min(day) OVER (PARTITION BY user_id), day) AS since FROM daily
), form AS (
  SELECT *, ctl - atl AS tsb FROM (
    SELECT user_id, day, n, since, load,
      round((1 - exp(-1.0::DOUBLE / 42)) * exp(-since / 42.0::DOUBLE) * sum(load * exp(since / 42.0::DOUBLE)) OVER w + 1e-9, 2) AS ctl,
      round((1 - exp(-1.0::DOUBLE / 7)) * exp(-since / 7.0::DOUBLE) * sum(load * exp(since / 7.0::DOUBLE)) OVER w + 1e-9, 2) AS atl
    FROM numbered WINDOW w AS (PARTITION BY user_id ORDER BY n)
  )
)"""

WORKLOAD = """
dense AS (
  SELECT u.user_id, g.n, coalesce(x.load, 0) AS load, x.n IS NOT NULL AS here
  FROM (SELECT user_id, min(n) AS a, max(n) AS b FROM numbered GROUP BY user_id) u, LATERAL (SELECT unnest(range(a - 28, b + 1)) AS n) g
  LEFT JOIN numbered x ON x.user_id = u.user_id AND x.n = g.n
), windows AS (
  SELECT *, sum(load) OVER w7 AS week, sum(load) OVER w28 AS month, sum(load) OVER p7 AS prev, stddev_samp(load) OVER w7 AS sd,
    count(*) FILTER (here) OVER w28 AS observed
  FROM dense
  WINDOW w7 AS (PARTITION BY user_id ORDER BY n ROWS 6 PRECEDING), w28 AS (PARTITION BY user_id ORDER BY n ROWS 27 PRECEDING),
    p7 AS (PARTITION BY user_id ORDER BY n ROWS BETWEEN 13 PRECEDING AND 7 PRECEDING)
), workload AS (
  SELECT *, CASE WHEN acwr IS NULL THEN 'unknown' WHEN acwr < 0.8 THEN 'undertraining' WHEN acwr <= 1.3 THEN 'sweet_spot' WHEN acwr <= 1.5 THEN 'elevated' ELSE 'danger' END AS acwr_zone,
    dense_days >= 28 AND acwr IS NOT NULL AS acwr_reliable
  FROM (
    SELECT f.*, week, month, observed, least(f.since + 1, 28) AS dense_days,
      CASE WHEN month > 0 THEN round((week / 7) / (month / 28) + 1e-9, 3) END AS acwr,
      CASE WHEN sd > 1e-4 THEN round(week / 7 / sd + 1e-9, 3) END AS monotony,
      CASE WHEN sd > 1e-4 THEN round(week * (week / 7 / sd) + 1e-9, 1) END AS strain,
      CASE WHEN prev > 0 THEN round(100 * (week - prev) / prev + 1e-9, 1) END AS ramp_pct
    FROM form f JOIN windows w ON f.user_id = w.user_id AND f.n = w.n
  )
)"""

WELLNESS = """
day_sums AS (
  SELECT user_id, CAST(ts AS DATE) AS day, CAST(sum(event_id) AS BIGINT) AS s FROM events GROUP BY ALL
), wellness AS (
  SELECT user_id, day, date_diff('day', DATE '1970-01-01', day) AS n,
    CAST(CASE WHEN s % 9 <> 0 THEN 400 + s % 400 END AS DOUBLE) / 10 AS hrv, CAST(CASE WHEN s % 11 <> 0 THEN 440 + s * 7 % 160 END AS DOUBLE) / 10 AS rhr,
    CAST(CASE WHEN s % 10 <> 0 THEN 300 + s * 13 % 240 END AS DOUBLE) AS sleep, CAST(CASE WHEN s % 6 <> 0 THEN s * 3 % 120 END AS DOUBLE) AS deep,
    CAST(CASE WHEN s % 7 <> 0 THEN s * 5 % 130 END AS DOUBLE) AS rem, CAST(CASE WHEN s % 8 <> 0 THEN 70 + s % 31 END AS DOUBLE) AS eff,
    CASE WHEN s % 5 <> 0 THEN 1 + s % 5 END AS soreness, CASE WHEN s % 7 <> 0 THEN 1 + (s // 3) % 5 END AS mood,
    CASE WHEN s % 9 <> 0 THEN 1 + (s // 5) % 5 END AS stress, CASE WHEN s % 13 <> 0 THEN 1 + (s // 7) % 5 END AS fatigue
  FROM day_sums
), baselines AS (
  SELECT *, avg(hrv) OVER b AS raw_mean, stddev_samp(hrv) OVER b AS raw_sd, avg(ln(hrv)) OVER b AS log_mean, stddev_samp(ln(hrv)) OVER b AS log_sd, count(hrv) OVER b AS log_n,
    avg(rhr) OVER b AS rhr_mean, stddev_samp(rhr) OVER b AS rhr_sd, count(rhr) OVER b AS rhr_n,
    avg(sleep / 60) OVER w AS week_sleep, avg(rhr) OVER w AS rhr_week, count(rhr) OVER w AS rhr_week_n,
    avg(rhr) OVER p AS rhr_early, stddev_samp(rhr) OVER p AS rhr_early_sd, count(rhr) OVER p AS rhr_early_n
  FROM wellness
  WINDOW b AS (PARTITION BY user_id ORDER BY n RANGE BETWEEN 28 PRECEDING AND 1 PRECEDING),
    w AS (PARTITION BY user_id ORDER BY n RANGE BETWEEN 6 PRECEDING AND CURRENT ROW),
    p AS (PARTITION BY user_id ORDER BY n RANGE BETWEEN 34 PRECEDING AND 7 PRECEDING)
), wells AS (
  SELECT *, sum(CASE WHEN log_n >= 7 AND log_sd > 1e-9 AND (ln(hrv) - log_mean) / log_sd < -1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY n RANGE BETWEEN 13 PRECEDING AND CURRENT ROW) AS low_days
  FROM baselines
)"""

READINESS = """
athlete_days AS (
  SELECT coalesce(w.user_id, l.user_id) AS user_id, coalesce(w.day, l.day) AS day, w.* EXCLUDE (user_id, day, n), l.* EXCLUDE (user_id, day, n)
  FROM wells w FULL JOIN workload l ON w.user_id = l.user_id AND w.day = l.day
), parts AS (
  SELECT *,
    CASE WHEN hrv IS NOT NULL AND log_n >= 7 THEN CASE WHEN abs(100 * (hrv - raw_mean) / raw_mean) < 0.5 * 100 * coalesce(raw_sd, 0) / abs(raw_mean) THEN 50.0
      WHEN log_sd > 1e-9 THEN 50 + 50 * greatest(-1, least(1, (ln(hrv) - log_mean) / log_sd / 2)) END END AS c1,
    CASE WHEN rhr IS NOT NULL AND rhr_n >= 7 AND rhr_sd > 1e-9 THEN 50 + 50 * greatest(-1, least(1, -((rhr - rhr_mean) / rhr_sd) / 2)) END AS c2,
    list_avg([x FOR x IN [greatest(0, least(100, 100 * sleep / 480)), CASE WHEN eff IS NOT NULL THEN greatest(0, least(100, eff)) END,
      CASE WHEN sleep IS NOT NULL AND (deep IS NOT NULL OR rem IS NOT NULL) THEN greatest(0, least(100, 100 * ((coalesce(deep, 0) + coalesce(rem, 0)) / sleep) / 0.45)) END] IF x IS NOT NULL AND (x = x)]) AS c3x,
    list_avg([CAST(x AS DOUBLE) FOR x IN [soreness, mood, stress, fatigue] IF x IS NOT NULL]) AS hooper,
    list_avg([x FOR x IN [greatest(0, least(100, 100 * (tsb + 30) / 35)), CASE WHEN acwr_reliable THEN CASE WHEN acwr <= 1.3 THEN 100 ELSE greatest(0, least(100, 100 - (acwr - 1.3) * 200)) END END,
      CASE WHEN monotony IS NOT NULL THEN greatest(0, least(100, 100 - greatest(0, monotony - 1.5) * 60)) END] IF x IS NOT NULL]) AS c5x
  FROM athlete_days
), parts2 AS (
  SELECT * EXCLUDE (c3x, c5x),
    list_avg([x FOR x IN [CASE WHEN sleep IS NOT NULL THEN greatest(0, least(100, 100 * sleep / 480)) END, CASE WHEN eff IS NOT NULL THEN greatest(0, least(100, eff)) END,
      CASE WHEN sleep IS NOT NULL AND (deep IS NOT NULL OR rem IS NOT NULL) THEN greatest(0, least(100, 100 * ((coalesce(deep, 0) + coalesce(rem, 0)) / sleep) / 0.45)) END] IF x IS NOT NULL]) AS c3,
    CASE WHEN hooper IS NOT NULL THEN greatest(0, least(100, 100 * (5 - hooper) / 4)) END AS c4,
    CASE WHEN tsb IS NOT NULL THEN c5x END AS c5
  FROM parts
), known AS (
  SELECT *, (CASE WHEN c1 IS NOT NULL THEN 0.30 ELSE 0 END + CASE WHEN c2 IS NOT NULL THEN 0.15 ELSE 0 END + CASE WHEN c3 IS NOT NULL THEN 0.25 ELSE 0 END
    + CASE WHEN c4 IS NOT NULL THEN 0.10 ELSE 0 END + CASE WHEN c5 IS NOT NULL THEN 0.20 ELSE 0 END)::DOUBLE AS q
  FROM parts2
), ready AS (
  SELECT *, round(total + 1e-9, 1) AS readiness, round(q, 3) AS data_quality,
    CASE WHEN total + 1e-9 < 25 THEN 'compromised' WHEN total + 1e-9 < 50 THEN 'limited' WHEN total + 1e-9 < 70 THEN 'moderate' WHEN total + 1e-9 < 85 THEN 'good' ELSE 'prime' END AS band
  FROM (SELECT *, CASE WHEN q > 0 THEN 0.30::DOUBLE / q * coalesce(c1, 0) + 0.15::DOUBLE / q * coalesce(c2, 0) + 0.25::DOUBLE / q * coalesce(c3, 0) + 0.10::DOUBLE / q * coalesce(c4, 0) + 0.20::DOUBLE / q * coalesce(c5, 0) ELSE 50 END AS total FROM known)
)"""

RISK = """
features AS (
  SELECT r.*,
    [CASE WHEN acwr_reliable THEN least(3, greatest(0, acwr - 1.3) / 0.2) ELSE 0 END,
     coalesce(CASE WHEN ramp_pct IS NOT NULL THEN least(3, greatest(0, ramp_pct - 10) / 10) END, 0),
     coalesce(CASE WHEN monotony IS NOT NULL THEN least(3, greatest(0, monotony - 1.8) / 0.5) END, 0),
     coalesce(CASE WHEN week_sleep IS NOT NULL THEN greatest(0, least(3, 8 - week_sleep)) END, 0),
     coalesce(least(3, low_days / 7.0::DOUBLE), 0),
     coalesce(CASE WHEN rhr_week_n >= 3 AND rhr_early_n >= 7 AND rhr_early_sd > 1e-9 THEN greatest(0, least(3, (rhr_week - rhr_early) / rhr_early_sd)) END, 0),
     CASE WHEN p.injuries >= 1 THEN 1 ELSE 0 END,
     coalesce(CASE WHEN ctl IS NOT NULL THEN greatest(0, least(3, (30 - ctl) / 30)) END, 0),
     coalesce(CASE WHEN p.training_age IS NOT NULL THEN least(p.training_age, 5) / 5 END, 0),
     coalesce(CASE WHEN p.age IS NOT NULL THEN greatest(0, least(3, (p.age - 40) / 10.0::DOUBLE)) END, 0)]::DOUBLE[] AS f
  FROM ready r LEFT JOIN profiles p ON r.user_id = p.user_id
), risky AS (
  SELECT *, 1 / (1 + exp(-(-2.6 + 0.45 * f[1] + 0.30 * f[2] + 0.25 * f[3] + 0.35 * f[4] + 0.30 * f[5] + 0.20 * f[6] + 0.85 * f[7] + 0.55 * f[8] - 0.40 * f[9] + 0.15 * f[10]))) AS p
  FROM features
), risk AS (
  SELECT *, round(p + 1e-9, 4) AS risk, CASE WHEN p < 0.1 THEN 'low' WHEN p < 0.2 THEN 'moderate' WHEN p < 0.35 THEN 'high' ELSE 'very_high' END AS risk_band FROM risky
)"""


def query(*parts: str, select: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + select


LOADS = (PROFILES, ACTIVITIES, SESSIONS)
CURVE = (*LOADS, FORM)
RATIOS = (*CURVE, WORKLOAD)
READY = (*RATIOS, WELLNESS, READINESS)
RISKS = (*READY, RISK)
