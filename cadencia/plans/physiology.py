"""Zones, efficiency, race predictions and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import efficiency as fe
from ..functions import load as fl
from ..functions import performance as fp
from ..functions import zones as fz
from ..functions.stats import normal_below
from ..operators import plan as po
from ..operators import trend
from ..params import RACES_M, TRANSITIONS_S
from ..sources.bridge import activities, profiles, table
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


_BANDS = """lthr_bands AS (SELECT * FROM (VALUES (1, 'Z1 Recovery', 0.00, 0.85), (2, 'Z2 Aerobic', 0.85, 0.90), (3, 'Z3 Tempo', 0.90, 0.95), (4, 'Z4 Threshold', 0.95, 1.00), (5, 'Z5 VO2max', 1.00, NULL)) v(zone, name, lo, hi)),
max_bands AS (SELECT * FROM (VALUES (1, 'Z1 Recovery', 0.50, 0.60), (2, 'Z2 Aerobic', 0.60, 0.70), (3, 'Z3 Tempo', 0.70, 0.80), (4, 'Z4 Threshold', 0.80, 0.90), (5, 'Z5 VO2max', 0.90, NULL)) v(zone, name, lo, hi)),
power_bands AS (SELECT * FROM (VALUES (1, 'Z1 Active Recovery', 0.00, 0.56), (2, 'Z2 Endurance', 0.56, 0.76), (3, 'Z3 Tempo', 0.76, 0.91), (4, 'Z4 Threshold', 0.91, 1.06), (5, 'Z5 VO2max', 1.06, 1.21), (6, 'Z6 Anaerobic', 1.21, 1.51), (7, 'Z7 Neuromuscular', 1.51, NULL)) v(zone, name, lo, hi)),
speed_bands AS (SELECT * FROM (VALUES (1, 'Z1 Recovery', 0.00, 0.78), (2, 'Z2 Aerobic', 0.78, 0.87), (3, 'Z3 Tempo', 0.87, 0.95), (4, 'Z4 Threshold', 0.95, 1.02), (5, 'Z5 VO2max', 1.02, NULL)) v(zone, name, lo, hi)),
hr_zones AS (
  SELECT user_id, zone, name, lthr * lo::DOUBLE AS low, lthr * hi::DOUBLE AS high, 'lthr' AS anchor FROM anchors, lthr_bands WHERE lthr IS NOT NULL
  UNION ALL SELECT user_id, zone, name, hm * lo::DOUBLE, hm * hi::DOUBLE, 'hr_max' FROM anchors, max_bands WHERE lthr IS NULL AND hm IS NOT NULL
)"""
ZONES = (sql.PROFILES, _BANDS)


def with_anchor(spark, d) -> DataFrame:
    return profiles(spark, d).withColumn("hm", fl.effective_hr_max(F.col("hr_max"), F.col("age")))


def listed(rows: DataFrame, *extra) -> DataFrame:
    return rows.select("user_id", *extra, F.inline("zones")).withColumns({"low": F.round(fz.finite(F.col("low")), 4), "high": F.round(fz.finite(F.col("high")), 4)})


@register(sql.query(*ZONES, select="SELECT user_id, zone, name, round(low, 4) AS low, round(high, 4) AS high, anchor FROM hr_zones"))
def hr_zones(spark, d):
    anchor = F.when(F.coalesce(F.col("lthr"), F.lit(0)) != 0, "lthr").otherwise("hr_max").alias("anchor")
    return listed(with_anchor(spark, d).withColumn("zones", fz.hr_zones(F.col("lthr"), F.col("hm"))), anchor)


@register(sql.query(*ZONES, select="SELECT user_id, zone, name, round(ftp * lo::DOUBLE, 4) AS low, round(ftp * hi::DOUBLE, 4) AS high FROM anchors, power_bands WHERE ftp IS NOT NULL"))
def power_zones(spark, d):
    return listed(profiles(spark, d).withColumn("zones", fz.power_zones(F.col("ftp_watts"))))


@register(sql.query(*ZONES, select="SELECT user_id, zone, name, CASE WHEN hi IS NULL THEN 0 ELSE round(pace / hi::DOUBLE, 4) END AS low, CASE WHEN lo > 0 THEN round(pace / lo::DOUBLE, 4) END AS high FROM anchors, speed_bands WHERE pace IS NOT NULL"))
def pace_zones(spark, d):
    return listed(profiles(spark, d).withColumn("zones", fz.pace_zones(F.col("threshold_pace_s_per_km"))))


@register(sql.query(*ZONES, select="""SELECT user_id, CASE WHEN ftp IS NOT NULL THEN 'power' WHEN hm IS NOT NULL OR lthr IS NOT NULL THEN 'heart_rate' END AS model,
  CASE WHEN ftp IS NOT NULL THEN 'self_reported' WHEN lthr IS NOT NULL OR hr_max IS NOT NULL THEN 'self_reported' WHEN hm IS NOT NULL THEN 'estimated' END AS anchor_source,
  CASE WHEN ftp IS NULL AND hm IS NULL AND lthr IS NULL THEN 'insufficient_data' END AS refusal FROM anchors"""))
def bike_zone_set(spark, d):
    """Which zones a cyclist gets, from what, or why none."""
    c = F.col
    heart = c("lthr").isNotNull() | c("hm").isNotNull()
    return with_anchor(spark, d).select(
        "user_id",
        F.when(c("ftp_watts").isNotNull(), "power").when(heart, "heart_rate").alias("model"),
        F.when(c("ftp_watts").isNotNull() | c("lthr").isNotNull() | c("hr_max").isNotNull(), "self_reported").when(c("hm").isNotNull(), "estimated").alias("anchor_source"),
        F.when(c("ftp_watts").isNull() & ~heart, "insufficient_data").alias("refusal"),
    )


def samples_in_zones(spark, d) -> DataFrame:
    """Each event as 60 seconds at a heart rate of 90 + k."""
    hr = (90 + F.get_json_object("props", "$.k").cast("int")).cast("double")
    rows = table(spark, d, "events").select("user_id", hr.alias("hr"))
    zones = with_anchor(spark, d).select("user_id", fz.hr_zones(F.col("lthr"), F.col("hm")).alias("zones")).filter("zones IS NOT NULL")
    return rows.join(zones, "user_id").withColumn("zone", fz.zone_of(F.col("hr"), F.col("zones")))


_IN_ZONES = """samples AS (SELECT user_id, CAST(90 + CAST(json_extract_string(props, '$.k') AS INT) AS DOUBLE) AS hr FROM events),
placed AS (SELECT s.user_id, z.zone FROM samples s JOIN hr_zones z ON s.user_id = z.user_id AND s.hr >= z.low AND (z.high IS NULL OR s.hr < z.high)),
users AS (SELECT DISTINCT s.user_id FROM samples s JOIN hr_zones z ON s.user_id = z.user_id)"""


@register(sql.query(*ZONES, _IN_ZONES, select="SELECT u.user_id, z AS zone, CAST(60 * count(p.zone) AS BIGINT) AS seconds FROM (SELECT user_id, unnest([1, 2, 3, 4, 5]) AS z FROM users) u LEFT JOIN placed p ON p.user_id = u.user_id AND p.zone = u.z GROUP BY ALL"))
def time_in_zone(spark, d):
    totals = samples_in_zones(spark, d).groupBy("user_id").agg(*(F.count(F.when(F.col("zone") == z, 1)).alias(str(z)) for z in range(1, 6)))
    each = F.array(*(F.struct(F.lit(z).alias("zone"), (60 * F.col(str(z))).alias("seconds")) for z in range(1, 6)))
    return totals.select("user_id", F.inline(each))


@register(sql.query(*ZONES, _IN_ZONES, select="""SELECT user_id, round(100 * lo / t, 4) AS low_pct, round(100 * mid / t, 4) AS moderate_pct, round(100 * hi / t, 4) AS high_pct, 100 * lo / t >= 75 AND hi >= mid AS polarised
FROM (SELECT user_id, count(*)::DOUBLE AS t, count(*) FILTER (zone <= 2) AS lo, count(*) FILTER (zone = 3) AS mid, count(*) FILTER (zone >= 4) AS hi FROM placed GROUP BY user_id)"""))
def intensity_distribution(spark, d):
    n = lambda c: F.count(F.when(c, 1))
    z = F.col("zone")
    rows = samples_in_zones(spark, d).filter("zone IS NOT NULL").groupBy("user_id").agg(F.count("*").alias("t"), n(z <= 2).alias("lo"), n(z == 3).alias("mid"), n(z >= 4).alias("hi"))
    pct = lambda c: F.round(100 * F.col(c) / F.col("t"), 4)
    return rows.select("user_id", pct("lo").alias("low_pct"), pct("mid").alias("moderate_pct"), pct("hi").alias("high_pct"), ((100 * F.col("lo") / F.col("t") >= 75) & (F.col("hi") >= F.col("mid"))).alias("polarised"))


_METRICS = """acts AS (SELECT *, CAST(coalesce(mov, d) AS DOUBLE) AS act, coalesce(np, avg_power) AS pw FROM activities),
halves AS (SELECT *, CASE WHEN e % 3 <> 1 THEN coalesce(avg_power + 2, dist / d + 0.1) / (avg_hr - e % 5) END AS r1, CASE WHEN e % 3 <> 1 THEN coalesce(avg_power - e % 9, dist / d - 0.1) / (avg_hr + e % 7) END AS r2 FROM acts),
metrics AS (
  SELECT user_id, e, day, 'running_efficiency_index' AS metric, dist / (act / 60) / avg_hr AS v, 'm/min/bpm' AS unit FROM acts WHERE sport = 'run'
  UNION ALL SELECT user_id, e, day, 'cycling_efficiency_factor', pw / avg_hr, 'W/bpm' FROM acts WHERE sport = 'bike'
  UNION ALL SELECT user_id, e, day, 'stroke_index', dist / act * (dist / strokes), 'm^2/s' FROM acts WHERE sport = 'swim'
  UNION ALL SELECT user_id, e, day, 'swolf', act / (dist / pool) + strokes / (dist / pool), 's+strokes' FROM acts WHERE sport = 'swim' AND dist / pool >= 1
  UNION ALL SELECT user_id, e, day, 'aerobic_decoupling', round(100 * (r1 - r2) / r1 + 1e-9, 2), '%' FROM halves
), kept AS (SELECT user_id, e AS activity_id, day, metric, round(v + 1e-9, 4) AS value, unit FROM metrics WHERE v IS NOT NULL)"""


def metrics(spark, d) -> DataFrame:
    return activities(spark, d).select("user_id", "activity_id", "day", "start_time", F.inline_outer(fe.session_metrics())).filter("metric IS NOT NULL")


@register(sql.query(sql.ACTIVITIES, _METRICS, select="SELECT user_id, activity_id, metric, value, unit FROM kept"))
def efficiency_metrics(spark, d):
    return metrics(spark, d).select("user_id", "activity_id", "metric", "value", "unit")


@register(sql.query(sql.ACTIVITIES, _METRICS, select="""SELECT activity_id, metric, value, round(b + 1e-9, 4) AS baseline, CASE WHEN b <> 0 THEN round(100 * (value - b) / abs(b) + 1e-9, 2) END AS delta_pct FROM (
  SELECT *, avg(value) OVER (PARTITION BY user_id, metric ORDER BY day RANGE BETWEEN INTERVAL 14 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING) AS b FROM kept WHERE metric NOT IN ('swolf', 'aerobic_decoupling'))"""))
def efficiency_vs_baseline(spark, d):
    """Against the athlete's mean of the 14 days before; swolf and decoupling have no baseline."""
    w = Window.partitionBy("user_id", "metric").orderBy("n").rangeBetween(-14, -1)
    rows = metrics(spark, d).filter(~F.col("metric").isin("swolf", "aerobic_decoupling")).withColumn("n", F.datediff("day", F.lit("1970-01-01").cast("date"))).withColumn("b", F.avg("value").over(w))
    return rows.select("activity_id", "metric", "value", F.round(F.col("b") + 1e-9, 4).alias("baseline"), F.when(F.col("b") != 0, F.round(100 * (F.col("value") - F.col("b")) / F.abs("b") + 1e-9, 2)).alias("delta_pct"))


@register("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN r = 1 THEN round(w + 1e-9, 1) ELSE round(w * (1 + r / 30.0::DOUBLE) + 1e-9, 1) END AS epley,
  CASE WHEN r = 1 THEN round(w + 1e-9, 1) WHEN r < 37 THEN round(w * 36 / (37 - r) + 1e-9, 1) ELSE round(w * (1 + r / 30.0::DOUBLE) + 1e-9, 1) END AS brzycki,
  round((CASE WHEN r = 1 THEN w ELSE w * (1 + r / 30.0::DOUBLE) END + CASE WHEN r = 1 THEN w WHEN r < 37 THEN w * 36 / (37 - r) ELSE w * (1 + r / 30.0::DOUBLE) END) / 2 + 1e-9, 1) AS mean, r <= 12 AS reliable
FROM (SELECT *, CAST(l_quantity AS INT) AS r, 20.0::DOUBLE + l_partkey % 120 AS w FROM lineitem) WHERE r >= 1""")
def estimated_1rm(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("r"), (20 + F.col("l_partkey") % 120).cast("double").alias("w")).filter("r >= 1")
    epley, brzycki, mean, reliable = fp.estimated_1rm(F.col("w"), F.col("r"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", epley.alias("epley"), brzycki.alias("brzycki"), mean.alias("mean"), reliable.alias("reliable"))


_RACES = """races AS (SELECT o_orderkey AS k, o_custkey AS user_id, CAST(o_orderdate AS DATE) AS day, ([1500, 5000, 10000, 21097.5, 42195]::DOUBLE[])[1 + o_orderkey % 5] AS dist,
  ([1500, 5000, 10000, 21097.5, 42195]::DOUBLE[])[1 + o_orderkey % 5] * (0.2::DOUBLE + (o_orderkey * 7 % 200) / 1000.0::DOUBLE) AS t FROM orders)"""


def races(spark, d) -> DataFrame:
    """An order as a race: distance and time from its key."""
    k = F.col("o_orderkey")
    distance = F.get(F.array(*(F.lit(x) for x in RACES_M)), (k % 5).cast("int"))
    return table(spark, d, "orders").select(k.alias("k"), F.col("o_custkey").alias("user_id"), F.to_date("o_orderdate").alias("day"), distance.alias("dist"), (distance * (0.2 + k * 7 % 200 / 1000.0)).alias("t"))


_BESTS = """bests AS (SELECT user_id, dist, min(t) AS t FROM races GROUP BY ALL),
fits AS (SELECT user_id, count(*) AS n, CASE WHEN count(*) < 3 THEN 1.06 ELSE round(greatest(1.0, least(1.2, regr_slope(ln(t), ln(dist)))), 4) END::DOUBLE AS exponent, CASE WHEN count(*) < 3 THEN 0 ELSE round(greatest(0, least(1, regr_r2(ln(t), ln(dist)))), 4) END::DOUBLE AS r2 FROM bests GROUP BY user_id)"""


@register(sql.query(_RACES, select="SELECT user_id, dist AS distance_m, min(t) AS time_s, arg_min(k, struct_pack(t := t, k := k)) AS race FROM races GROUP BY ALL"))
def personal_bests(spark, d):
    return trend.bests(races(spark, d)).select("user_id", F.col("dist").alias("distance_m"), F.col("t").alias("time_s"), F.col("k").alias("race"))


@register(sql.query(_RACES, _BESTS, select="SELECT * FROM fits"))
def riegel_fit(spark, d):
    return trend.riegel_fit(trend.bests(races(spark, d)))


@register(sql.query(_RACES, select="SELECT k, round((-4.60 + 0.182258 * v + 0.000104 * v * v) / (0.8 + 0.1894393 * exp(-0.012778 * m) + 0.2989558 * exp(-0.1932605 * m)), 4) AS vdot FROM (SELECT k, t / 60 AS m, dist / (t / 60) AS v FROM races)"))
def vdot(spark, d):
    return races(spark, d).select("k", F.round(fp.vdot(F.col("dist"), F.col("t")), 4).alias("vdot"))


_EQUAL = """shown AS (SELECT r.*, f.exponent, f.r2, target FROM races r JOIN fits f ON r.user_id = f.user_id, (SELECT unnest([1500, 5000, 10000, 21097.5, 42195]::DOUBLE[]) AS target)),
steps AS (
  WITH RECURSIVE b AS (
    SELECT k, target, exponent, dist, t, (-4.60 + 0.182258 * (dist / (t / 60)) + 0.000104 * (dist / (t / 60)) * (dist / (t / 60))) / (0.8 + 0.1894393 * exp(-0.012778 * (t / 60)) + 0.2989558 * exp(-0.1932605 * (t / 60))) AS v, 30.0::DOUBLE AS lo, 43200.0::DOUBLE AS hi, 0 AS i FROM shown
    UNION ALL
    SELECT k, target, exponent, dist, t, v, CASE WHEN slow THEN mid ELSE lo END, CASE WHEN slow THEN hi ELSE mid END, i + 1 FROM (
      SELECT *, (-4.60 + 0.182258 * (target / (mid / 60)) + 0.000104 * (target / (mid / 60)) * (target / (mid / 60))) / (0.8 + 0.1894393 * exp(-0.012778 * (mid / 60)) + 0.2989558 * exp(-0.1932605 * (mid / 60))) > v AS slow
      FROM (SELECT *, (lo + hi) / 2 AS mid FROM b WHERE i < 23))
  ) SELECT *, round((lo + hi) / 2 + 1e-9, 2) AS a, t * power(target / dist, exponent) AS g FROM b WHERE i = 23
)"""


@register(sql.query(_RACES, _BESTS, _EQUAL, select="SELECT k, 'time_' || CAST(floor(target) AS INT) || 'm' AS metric, round((a + g) / 2 + 1e-9, 1) AS value, round(least(a, g) + 1e-9, 1) AS low, round(greatest(a, g) + 1e-9, 1) AS high, round(greatest(0.2, 1 - abs(a - g) / ((a + g) / 2) * 5) + 1e-9, 2) AS confidence FROM steps"))
def equivalent_times(spark, d):
    """For every race."""
    fits = trend.riegel_fit(trend.bests(races(spark, d)))
    return trend.equivalent_times(races(spark, d).join(fits, "user_id")).select("k", "metric", "value", "low", "high", "confidence")


@register(sql.query(_RACES, select="""SELECT k, user_id, round(cs + 1e-9, 4) AS critical_speed, round(dist - cs * t + 1e-9, 1) AS d_prime, round(p - w / t + 1e-9, 1) AS critical_power, round(w + 1e-9, 0) AS w_prime, round(0.95 * p + 1e-9, 1) AS ftp FROM (
  SELECT *, (dist2 - dist) / (t2 - t) AS cs, (p - p2) / (1 / t - 1 / t2) AS w FROM (
    SELECT *, lead(dist) OVER q AS dist2, lead(t) OVER q AS t2, 200.0::DOUBLE + k % 100 AS p, 200.0::DOUBLE + lead(k) OVER q % 100 AS p2 FROM races WINDOW q AS (PARTITION BY user_id ORDER BY day, k)) WHERE t2 IS NOT NULL AND t2 <> t)"""))
def critical_speed_power(spark, d):
    """From each race and the athlete's next."""
    w = Window.partitionBy("user_id").orderBy("day", "k")
    rows = races(spark, d).withColumn("p", (200 + F.col("k") % 100).cast("double"))
    rows = rows.withColumns({f"{c}2": F.lead(c).over(w) for c in ("dist", "t", "p")}).filter("t2 IS NOT NULL AND t2 <> t")
    c = F.col
    cs, dp = fp.critical_speed(c("dist"), c("t"), c("dist2"), c("t2"))
    cp, wp = fp.critical_power(c("p"), c("t"), c("p2"), c("t2"))
    return rows.select("k", "user_id", cs.alias("critical_speed"), dp.alias("d_prime"), cp.alias("critical_power"), wp.alias("w_prime"), F.round(0.95 * c("p") + 1e-9, 1).alias("ftp"))


_FORECAST = """h AS (SELECT o_custkey AS user_id, CAST(o_orderdate AS DATE) AS day, o_totalprice AS y FROM orders WHERE o_totalprice > 0),
x AS (SELECT *, date_diff('day', min(day) OVER q, day)::DOUBLE AS x, power(0.5::DOUBLE, date_diff('day', day, max(day) OVER q) / 600.0::DOUBLE) AS w, date_diff('day', min(day) OVER q, max(day) OVER q) + 28.0::DOUBLE AS tx FROM h WINDOW q AS (PARTITION BY user_id)),
m AS (SELECT user_id, count(*) AS n, max(tx) AS tx, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM x GROUP BY user_id HAVING count(*) >= 3),
s AS (SELECT x.user_id, n, m.tx, mx, my, sum(w * (x - mx) * (x - mx)) AS sxx, sum(w * (x - mx) * (y - my)) AS sxy, sum(w * (y - my) * (y - my)) AS syy FROM x JOIN m ON x.user_id = m.user_id GROUP BY ALL),
f AS (SELECT *, CASE WHEN sxx > 0 THEN sxy / sxx ELSE 0 END AS slope, greatest(0, syy - CASE WHEN sxx > 0 THEN sxy * sxy / sxx ELSE 0 END) AS sse FROM s),
g AS (SELECT *, my + slope * (tx - mx) AS p, CASE WHEN syy > 0 THEN greatest(0, least(1, 1 - sse / syy)) ELSE 0 END AS r2, CASE WHEN sxx > 0 THEN sqrt(sse / (n - 2)) * sqrt(1 + 1.0::DOUBLE / n + (tx - mx) * (tx - mx) / sxx) ELSE sqrt(sse / (n - 2)) END AS psd FROM f),
forecast AS (SELECT user_id, n, round(p + 1e-9, 2) AS value, round(p - 1.96 * psd + 1e-9, 2) AS low, round(p + 1.96 * psd + 1e-9, 2) AS high, round(least(1, r2 * least(1, n / 6.0::DOUBLE)) + 1e-9, 2) AS confidence FROM g)"""


def forecasts(spark, d) -> DataFrame:
    history = table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("value"))
    return trend.progression_forecast(history, horizon_days=28, half_life_days=600.0)


@register(sql.query(_FORECAST, select="SELECT * FROM forecast"))
def progression_forecast(spark, d):
    return forecasts(spark, d)


@register(sql.query(_FORECAST, select="""SELECT user_id, round(CASE WHEN sd <= 0 THEN CASE WHEN u >= 0 THEN 1 ELSE 0 END WHEN u >= 0 THEN 0.5 * (1 + er) ELSE 0.5 * (1 - er) END, 4) AS probability FROM (
  SELECT *, 1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-u * u) AS er FROM (
    SELECT *, 1 / (1 + 0.3275911 * abs(u)) AS t FROM (SELECT *, (150000.0::DOUBLE - value) / (nullif(sd, 0) * sqrt(2.0::DOUBLE)) AS u FROM (SELECT *, (high - low) / (2 * 1.96) AS sd FROM forecast))))"""))
def probability_of_beating(spark, d):
    """That the next value stays below 150,000."""
    sd = (F.col("high") - F.col("low")) / (2 * 1.96)
    return forecasts(spark, d).select("user_id", F.round(normal_below(F.lit(150000.0), F.col("value"), sd), 4).alias("probability"))


@register(sql.query(_RACES, select="SELECT user_id, round(sum(t) + 240 + 1e-9, 1) AS total_s FROM races WHERE dist IN (1500, 5000, 10000) GROUP BY user_id HAVING count(DISTINCT dist) = 3"))
def triathlon_prediction(spark, d):
    rows = races(spark, d).filter(F.col("dist").isin(1500.0, 5000.0, 10000.0))
    return rows.groupBy("user_id").agg(F.round(F.sum("t") + TRANSITIONS_S + 1e-9, 1).alias("total_s"), F.countDistinct("dist").alias("n")).filter("n = 3").drop("n")


_PLAN = """requests AS (SELECT c_custkey AS id, (4 + c_custkey % 14)::INT AS weeks, (1 + c_custkey % 9)::INT AS per_week, ['beginner', 'intermediate', 'advanced'][1 + c_custkey % 3] AS level, (c_custkey * 7 % 90)::DOUBLE AS ctl, c_custkey % 4 <> 0 AS race, ['run', 'bike', 'swim'][1 + c_custkey % 3] AS sport FROM customer),
shape AS (SELECT *, CASE WHEN weeks >= 8 THEN 2 WHEN weeks >= 4 THEN 1 ELSE 0 END AS taper, CASE WHEN weeks >= 12 THEN 2 WHEN weeks >= 6 THEN 1 ELSE 0 END AS peak,
  CASE level WHEN 'beginner' THEN 0.05 WHEN 'intermediate' THEN 0.08 ELSE 0.10 END::DOUBLE AS ramp, greatest(ctl * 7, CASE level WHEN 'beginner' THEN 150 WHEN 'intermediate' THEN 300 ELSE 500 END)::DOUBLE AS base FROM requests),
phased AS (SELECT *, CASE WHEN NOT race THEN CASE WHEN w < greatest(1, weeks // 3) THEN 'base' ELSE 'build' END
    WHEN w < bw THEN 'base' WHEN w < weeks - taper - peak THEN 'build' WHEN w < weeks - taper THEN 'peak' ELSE 'taper' END AS phase0
  FROM (SELECT s.*, greatest(0, CAST(round_even((weeks - taper - peak) * 0.45::DOUBLE, 0) AS INT)) AS bw, unnest(range(weeks))::INT AS w FROM shape s)),
kinds AS (SELECT *, (w + 1) % 4 = 0 AND phase0 IN ('base', 'build') AS rec FROM phased),
grown AS (SELECT *, base * power(1 + ramp, sum(CASE WHEN w > 0 AND NOT rec AND phase0 <> 'taper' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY w)) AS prog FROM kinds),
weeks AS (SELECT *, CASE WHEN rec THEN 'recovery' ELSE phase0 END AS phase, CASE WHEN phase0 = 'taper' THEN prog * CASE WHEN w - (weeks - taper) <= 0 THEN 0.7 ELSE 0.5 END::DOUBLE WHEN rec THEN prog * 0.65::DOUBLE ELSE prog END AS load FROM grown)"""


def requests(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    pick = lambda *x: F.get(F.array(*(F.lit(v) for v in x)), (k % len(x)).cast("int"))
    return table(spark, d, "customer").select(
        k.alias("id"), (4 + k % 14).cast("int").alias("weeks"), (1 + k % 9).cast("int").alias("sessions_per_week"), pick("beginner", "intermediate", "advanced").alias("level"), (k * 7 % 90).cast("double").alias("current_ctl"), (k % 4 != 0).alias("has_race"), pick("run", "bike", "swim").alias("primary_sport"),
        F.when(k % 5 == 0, F.array(F.lit("swim"), F.lit("bike"))).otherwise(F.array().cast("array<string>")).alias("secondary_sports"),
    )


@register(sql.query(_PLAN, select="SELECT id, w AS week, phase, rec AS is_recovery, round(load + 1e-9, 1) AS target_load FROM weeks"))
def plan_weeks(spark, d):
    """For every customer."""
    return weeks_of(requests(spark, d))


def weeks_of(some) -> DataFrame:
    return po.weeks(some).select("id", "week", "phase", "is_recovery", F.round(F.col("load") + 1e-9, 1).alias("target_load"))


_SLOTS = """quality AS (SELECT *, CASE phase WHEN 'recovery' THEN [] WHEN 'taper' THEN [('threshold', 1.2)] WHEN 'base' THEN [('tempo', 1.4)] WHEN 'build' THEN [('threshold', 1.5), ('tempo', 1.3)] ELSE [('vo2max', 1.6), ('threshold', 1.4)] END AS q FROM weeks),
cut AS (SELECT *, CASE WHEN phase = 'taper' THEN q ELSE q[1 : greatest(1, per_week - 1)] END AS q2 FROM quality),
slots AS (SELECT c.*, s, CASE WHEN phase = 'recovery' THEN ('recovery', 1.0, false) WHEN s < len(q2) THEN (q2[s + 1][1], q2[s + 1][2], true)
    WHEN phase <> 'taper' AND per_week >= 3 AND s = len(q2) THEN ('easy', 2.0, true) ELSE ('easy', 1.0, false) END AS t,
    greatest(per_week, len(q2) + CASE WHEN phase NOT IN ('taper', 'recovery') AND per_week >= 3 THEN 1 ELSE 0 END) AS cnt
  FROM (SELECT *, unnest(range(CASE WHEN phase = 'recovery' THEN per_week ELSE greatest(per_week, len(q2) + CASE WHEN phase <> 'taper' AND per_week >= 3 THEN 1 ELSE 0 END) END))::INT AS s FROM cut) c),
shares AS (SELECT *, load * t[2]::DOUBLE / sum(t[2]::DOUBLE) OVER (PARTITION BY id, w) AS sl, CASE t[1] WHEN 'recovery' THEN 36 WHEN 'easy' THEN 49 WHEN 'tempo' THEN 72 WHEN 'threshold' THEN 96 ELSE 117 END::DOUBLE AS ph FROM slots)"""


@register(sql.query(_PLAN, _SLOTS, select="""SELECT id, w AS week, s AS slot, (w * 7 + CASE WHEN cnt >= 7 THEN s % 7 ELSE least(6, CAST(round_even(s * 7.0::DOUBLE / cnt, 0) AS INT)) END)::INT AS day_offset, t[1] AS intensity, t[3] AS is_key, round(sl + 1e-9, 1) AS target_load,
  greatest(20, CAST(round_even(60 * sl / ph, 0) AS INT)) AS duration_min, CASE WHEN id % 5 <> 0 OR s % 2 = 0 THEN sport WHEN (s // 2) % 2 = 0 THEN 'swim' ELSE 'bike' END AS sport FROM shares"""))
def plan_sessions(spark, d):
    """For every customer."""
    return sessions_of(requests(spark, d))


def sessions_of(some) -> DataFrame:
    return po.sessions(po.weeks(some)).select("id", "week", "slot", "day_offset", "intensity", "is_key", "target_load", "duration_min", "sport")


@register(sql.query(*sql.LOADS, select="SELECT user_id, date_trunc('week', day)::DATE AS week, round(greatest(0, least(2, sum(load) / (200 + any_value(user_id) % 200))) + 1e-9, 3) AS compliance FROM daily GROUP BY ALL"))
def weekly_compliance(spark, d):
    rows = daily(spark, d).groupBy("user_id", F.to_date(F.date_trunc("week", "day")).alias("week")).agg(F.sum("load").alias("load"))
    return po.weekly_compliance(rows.withColumn("planned", 200 + F.col("user_id") % 200)).select("user_id", "week", "compliance")


_MATCH = """planned AS (SELECT user_id, day, sport, e, (d * 3 // 4 + e % 2000)::DOUBLE AS pd, load * (0.7::DOUBLE + (e % 9) / 10.0::DOUBLE) AS pl FROM sessions WHERE e % 2 = 0),
pairs AS (SELECT p.e AS planned_id, s.e AS activity_id, abs(s.d - p.pd) / p.pd AS dd FROM planned p JOIN sessions s ON p.user_id = s.user_id AND p.day = s.day AND p.sport = s.sport AND (abs(s.d - p.pd) <= 0.3::DOUBLE * p.pd OR abs(s.load - p.pl) <= 0.4::DOUBLE * p.pl))"""


@register(sql.query(*sql.LOADS, _MATCH, select="SELECT planned_id, activity_id FROM (SELECT *, row_number() OVER (PARTITION BY planned_id ORDER BY dd, activity_id) AS r FROM pairs) WHERE r = 1"))
def session_match(spark, d):
    """Planned sessions matched with the done one of the same day and sport that is closest in duration."""
    from .training import sessions

    done = sessions(spark, d).select("user_id", "day", "sport", "activity_id", "duration_s", "load")
    e = F.col("activity_id")
    planned = done.filter("activity_id % 2 = 0").select("user_id", "day", "sport", e.alias("planned_id"), (F.floor(F.col("duration_s") * 3 / 4) + e % 2000).cast("double").alias("planned_s"), (F.col("load") * (0.7 + e % 9 / 10.0)).alias("planned_load"))
    return po.match_sessions(planned, done).select("planned_id", "activity_id")


@register(sql.query(*sql.LOADS, _MATCH, select="""SELECT p.user_id, round(sum(CASE WHEN b.activity_id IS NOT NULL THEN s.load ELSE 0 END) / sum(pl) + 1e-9, 3) AS load_ratio, round(count(b.activity_id) / count(*)::DOUBLE + 1e-9, 3) AS session_ratio,
  round(count(b.activity_id) FILTER (p.e % 6 = 0) / nullif(count(*) FILTER (p.e % 6 = 0), 0)::DOUBLE + 1e-9, 3) AS key_rate
FROM planned p LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY planned_id ORDER BY dd, activity_id) AS r FROM pairs) b ON p.e = b.planned_id AND r = 1 LEFT JOIN sessions s ON s.e = b.activity_id GROUP BY p.user_id"""))
def compliance_three_ways(spark, d):
    from .training import sessions

    done = sessions(spark, d).select("user_id", "day", "sport", "activity_id", "duration_s", "load")
    e = F.col("activity_id")
    planned = done.filter("activity_id % 2 = 0").select("user_id", "day", "sport", e.alias("planned_id"), (F.floor(F.col("duration_s") * 3 / 4) + e % 2000).cast("double").alias("planned_s"), (F.col("load") * (0.7 + e % 9 / 10.0)).alias("planned_load"))
    matched = planned.join(po.match_sessions(planned, done).select("planned_id", "activity_id", F.col("load").alias("done_load")), "planned_id", "left")
    key = F.col("planned_id") % 6 == 0
    hit = F.col("activity_id").isNotNull()
    return matched.groupBy("user_id").agg(
        F.round(F.sum(F.coalesce("done_load", F.lit(0.0))) / F.sum("planned_load") + 1e-9, 3).alias("load_ratio"),
        F.round(F.count("activity_id") / F.count("*") + 1e-9, 3).alias("session_ratio"),
        F.round(F.count(F.when(key & hit, 1)) / F.nullif(F.count(F.when(key, 1)), F.lit(0)) + 1e-9, 3).alias("key_rate"),
    )
