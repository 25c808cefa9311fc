"""Synthetic athletes: each value is a function of a digest of athlete, day and kind, whatever the order of generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The epoch, the four-week cycle and the week's sessions from Monday (sport, seconds).
EPOCH = "2026-01-01"
CYCLE = (1.0, 1.08, 1.16, 0.55)
WEEK = (("run", 3600), ("bike", 4500), ("swim", 2700), ("run", 3000), None, ("strength", 2400), ("bike", 9000))


def seed(*parts: Column) -> Column:
    """The first 64 bits of a digest of the parts, unsigned."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def jitter(value: Column, spread: float) -> Column:
    """A factor within 1 - spread and 1 + spread."""
    unit = (value % 10000).cast("double") / 10000
    return 1 + (unit * 2 - 1) * spread


def calendar(athletes: DataFrame, first: str, n: int) -> DataFrame:
    day = F.lit(first).cast("date")
    return athletes.withColumn("day", F.explode(F.sequence(day, F.date_add(day, n - 1)))).withColumn("since", F.datediff("day", F.lit(EPOCH).cast("date")))


def activities(athletes: DataFrame, first: str = EPOCH, n: int = 90) -> DataFrame:
    """A session for each athlete and day that isn't for rest; expects a column athlete."""
    plan = F.array(*(F.struct(F.lit(None if x is None else x[0]).cast("string").alias("sport"), F.lit(None if x is None else x[1]).cast("double").alias("base")) for x in WEEK))
    rows = calendar(athletes, first, n).withColumn("plan", F.get(plan, F.weekday("day"))).select("*", "plan.*").drop("plan").filter("sport IS NOT NULL")
    cycle = F.get(F.array(*(F.lit(x) for x in CYCLE)), (F.floor(F.col("since") / 7) % 4).cast("int"))
    return rows.withColumn("duration_s", F.col("base") * cycle * jitter(seed(F.col("athlete"), F.col("day").cast("string"), F.col("sport")), 0.08))


def wellness(athletes: DataFrame, first: str = EPOCH, n: int = 90) -> DataFrame:
    """A night for each athlete and day, but each 23rd; days 40 to 46 are bad."""
    rows = calendar(athletes, first, n).filter("since % 23 <> 0").withColumn("seed", seed(F.col("athlete"), F.col("day").cast("string"), F.lit("wellness")))
    bad = F.col("since").between(40, 46)
    return rows.withColumns({"sleep_h": F.when(bad, 5.4).otherwise(7.6) * jitter(F.col("seed"), 0.06), "hrv": F.when(bad, 44.0).otherwise(58.0) * jitter(F.col("seed") + 1, 0.09)})


def heart_rate_stream(sessions: DataFrame) -> DataFrame:
    """One sample a minute of the first hour at most; expects duration_s and avg_hr."""
    offsets = F.sequence(F.lit(0), (F.least(F.col("duration_s"), F.lit(3600.0)) - 1).cast("int"), F.lit(60))
    return sessions.withColumn("offset_s", F.explode(offsets)).withColumn("hr", F.col("avg_hr") + F.col("offset_s") / 60 % 7 - 3)
