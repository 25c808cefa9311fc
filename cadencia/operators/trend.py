"""Personal bests, fits and forecasts by athlete, each a grouped aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import performance as fp
from ..params import RACES_M, RECENCY_HALF_LIFE_DAYS, RIEGEL_EXPONENT, RIEGEL_LEAST, RIEGEL_MOST


def bests(races: DataFrame) -> DataFrame:
    """The fastest race (time, then key) of each athlete and distance; keep-faster merging is the same over a union."""
    best = F.min(F.struct("t", "k", "day"))
    return races.groupBy("user_id", "dist").agg(best.alias("b")).select("user_id", "dist", "b.t", "b.k", "b.day")


def riegel_fit(best: DataFrame) -> DataFrame:
    """The slope of log time over log distance, within its limits; the default with fewer than three distances."""
    usable = best.filter("dist > 0 AND t > 0")
    y, x = F.log("t"), F.log("dist")
    fit = usable.groupBy("user_id").agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r2"))
    few = F.col("n") < 3
    exponent = F.round(F.greatest(F.lit(RIEGEL_LEAST), F.least(F.lit(RIEGEL_MOST), F.col("slope"))), 4)
    return fit.select("user_id", "n", F.when(few, RIEGEL_EXPONENT).otherwise(exponent).alias("exponent"), F.when(few, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("r2"))), 4)).alias("r2"))


def equivalent_times(races: DataFrame, targets: tuple = RACES_M) -> DataFrame:
    """For each race (dist, t, exponent) and target: the mean of two models, their range and a confidence."""
    rows = races.withColumns({"vdot": fp.vdot(F.col("dist"), F.col("t")), "target": F.explode(F.array(*(F.lit(x) for x in targets)))})
    rows = rows.withColumns({"a": fp.time_from_vdot(F.col("vdot"), F.col("target")), "b": fp.riegel(F.col("t"), F.col("dist"), F.col("target"), F.col("exponent"))})
    a, b = F.col("a"), F.col("b")
    mid = (a + b) / 2
    r = lambda x, n=1: F.round(x + 1e-9, n)
    return rows.withColumns({"metric": F.concat(F.lit("time_"), F.floor("target").cast("string"), F.lit("m")), "value": r(mid), "low": r(F.least(a, b)), "high": r(F.greatest(a, b)), "confidence": r(F.greatest(F.lit(0.2), 1 - F.abs(a - b) / mid * 5), 2)})


def progression_forecast(history: DataFrame, horizon_days: int, half_life_days: float = RECENCY_HALF_LIFE_DAYS) -> DataFrame:
    """Weighted least squares of value over days with a 95 % prediction interval; athletes with fewer than three values get no row.

    Two passes: means first, then centred sums, which keeps them exact enough; both are partial aggregates by athlete.
    """
    usable = history.filter("value > 0")
    ends = usable.groupBy("user_id").agg(F.min("day").alias("a"), F.max("day").alias("b"), F.count("*").alias("n")).filter("n >= 3")
    rows = usable.join(ends, "user_id").select("user_id", "n", "value", F.datediff("day", "a").cast("double").alias("x"), F.pow(F.lit(0.5), F.datediff("b", "day") / half_life_days).alias("w"), (F.datediff("b", "a") + horizon_days).cast("double").alias("tx"))
    mean = lambda c: F.sum(F.col("w") * F.col(c)) / F.sum("w")
    means = rows.groupBy("user_id").agg(mean("x").alias("mx"), mean("value").alias("my"))
    rows = rows.join(means, "user_id")
    dx, dy, w = F.col("x") - F.col("mx"), F.col("value") - F.col("my"), F.col("w")
    fit = rows.groupBy("user_id", "n", "tx", "mx", "my").agg(F.sum(w * dx * dx).alias("sxx"), F.sum(w * dx * dy).alias("sxy"), F.sum(w * dy * dy).alias("syy"))
    c = F.col
    fit = fit.withColumns({"slope": F.when(c("sxx") > 0, c("sxy") / c("sxx")).otherwise(0.0), "sse": F.greatest(F.lit(0.0), c("syy") - F.when(c("sxx") > 0, c("sxy") * c("sxy") / c("sxx")).otherwise(0.0))})
    sd = F.sqrt(c("sse") / (c("n") - 2))
    off = c("tx") - c("mx")
    fit = fit.withColumns({"p": c("my") + c("slope") * off, "r2": F.when(c("syy") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - c("sse") / c("syy")))).otherwise(0.0), "psd": F.when(c("sxx") > 0, sd * F.sqrt(1 + 1 / c("n") + off * off / c("sxx"))).otherwise(sd)})
    r = lambda x: F.round(x + 1e-9, 2)
    return fit.select("user_id", "n", r(c("p")).alias("value"), r(c("p") - 1.96 * c("psd")).alias("low"), r(c("p") + 1.96 * c("psd")).alias("high"), r(F.least(F.lit(1.0), c("r2") * F.least(F.lit(1.0), c("n") / 6.0))).alias("confidence"))
