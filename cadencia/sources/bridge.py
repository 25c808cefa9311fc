"""Domain tables derived from the driver's generic ones, by integer arithmetic that every engine agrees on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The last day of the events.
REF_DAY = "2024-01-30"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unless(condition: Column, value: Column) -> Column:
    return F.when(~condition, value)


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each athlete (customer)."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("user_id"),
        F.when(k % 3 == 0, "male").when(k % 3 == 1, "female").otherwise("unspecified").alias("sex"),
        unless(k % 11 == 0, 18 + k * 7 % 50).cast("int").alias("age"),
        unless(k % 4 == 0, 175 + k * 3 % 25).cast("int").alias("hr_max"),
        unless(k % 5 == 0, 45 + k % 15).cast("int").alias("hr_rest"),
        unless(k % 3 == 0, 150 + k * 5 % 20).cast("int").alias("lthr"),
        unless(k % 6 == 0, 180 + k * 11 % 140).cast("double").alias("ftp_watts"),
        F.when(k % 9 == 0, 220 + k % 80).cast("double").alias("run_threshold_power_w"),
        unless(k % 5 == 1, 220 + k * 13 % 120).cast("double").alias("threshold_pace_s_per_km"),
        unless(k % 7 == 1, 85 + k * 3 % 40).cast("double").alias("css_s_per_100m"),
        unless(k % 8 == 3, k % 40 / 2.0).cast("double").alias("training_age_years"),
        F.when(k % 4 == 0, 1).otherwise(0).alias("injuries_last_12m"),
        F.when(k % 3 == 0, "beginner").when(k % 3 == 1, "intermediate").otherwise("advanced").alias("level"),
        F.col("c_nationkey").alias("group_id"),
    )


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each session (event)."""
    e = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    sport = F.when(F.col("event_type") == "view", "run").when(F.col("event_type") == "click", "bike").when(F.col("event_type") == "purchase", "swim").when(F.col("event_type") == "signup", "strength").otherwise("other")
    rows = table(spark, sf_dir, "events").select("user_id", e.alias("activity_id"), F.col("ts").alias("start_time"), F.to_date("ts").alias("day"), sport.alias("sport"), k.alias("k"), (900 + e * 37 % 6300).cast("int").alias("duration_s"))
    e, d, k = F.col("activity_id"), F.col("duration_s"), F.col("k")
    pace = F.when(F.col("sport") == "run", 2400 + e * 7 % 1600).when(F.col("sport") == "bike", 6000 + e * 11 % 5000).when(F.col("sport") == "swim", 800 + e * 3 % 600)
    rows = rows.withColumns(
        {
            "moving_time_s": unless(e % 3 == 0, d - e * 13 % 300).cast("int"),
            "distance_m": d * pace / 1000.0,
            "avg_hr": unless(e % 7 == 0, 110 + k % 70).cast("double"),
            "avg_power": F.when(F.col("sport").isin("bike", "run") & (e % 5 != 0), 120 + 2 * k).cast("double"),
            "rpe": unless(e % 4 == 0, 1 + e % 10).cast("double"),
            "is_manual": e % 13 == 0,
            "elevation_gain_m": (e * 17 % 900).cast("double"),
            "total_strokes": F.when(F.col("sport") == "swim", 600 + e * 7 % 900).cast("int"),
            "pool_length_m": F.when(F.col("sport") == "swim", 25 * (1 + e % 2)).cast("double"),
        }
    )
    half = lambda hr, power, speed: F.struct((F.col("avg_hr") + hr).alias("avg_hr"), (F.col("avg_power") + power).alias("avg_power"), (F.col("distance_m") / d + speed).alias("avg_speed_m_s"))
    return rows.withColumns(
        {
            "normalized_power": F.when(e % 4 == 1, F.col("avg_power") * (95 + e % 20) / 100.0),
            "max_hr": F.col("avg_hr") + (e % 30) - 2,
            "avg_speed_m_s": unless(e % 6 == 0, F.col("distance_m") / d * (80 + e % 50) / 100.0),
            "first_half": F.when(e % 3 != 1, half(-(e % 5), F.lit(2), F.lit(0.1))),
            "second_half": F.when(e % 3 != 1, half(e % 7, -(e % 9), F.lit(-0.1))),
        }
    )


def wellness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each athlete and day with an event."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("event_id").alias("s"))
    s = F.col("s")
    item = lambda part, gap: unless(s % gap == 0, 1 + part % 5).cast("int")
    return rows.select(
        "user_id",
        "day",
        unless(s % 9 == 0, 400 + s % 400).cast("double").alias("hrv10"),
        unless(s % 11 == 0, 440 + s * 7 % 160).cast("double").alias("rhr10"),
        unless(s % 10 == 0, 300 + s * 13 % 240).cast("double").alias("sleep_total_min"),
        unless(s % 6 == 0, s * 3 % 120).cast("double").alias("sleep_deep_min"),
        unless(s % 7 == 0, s * 5 % 130).cast("double").alias("sleep_rem_min"),
        unless(s % 8 == 0, 70 + s % 31).cast("double").alias("sleep_efficiency_pct"),
        item(s, 5).alias("soreness"),
        item(F.floor(s / 3), 7).alias("mood"),
        item(F.floor(s / 5), 9).alias("stress"),
        item(F.floor(s / 7), 13).alias("fatigue"),
    ).withColumns({"hrv_rmssd_ms": F.col("hrv10") / 10, "resting_hr": F.col("rhr10") / 10}).drop("hrv10", "rhr10")
