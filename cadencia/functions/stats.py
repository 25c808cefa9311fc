"""Scalar and windowed statistics."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

#: Added before rounding, so that decimal ties fall the same way in every engine.
NUDGE = 1e-9


def present(x: Column) -> Column:
    """Null for 0 too: a provider's way of saying that there is no measurement."""
    return F.nullif(x, F.lit(0).cast("double"))


def rounded(x: Column, digits: int = 2) -> Column:
    return F.round(x + F.lit(NUDGE), digits)


def clamp(x: Column, low: float, high: float) -> Column:
    """Null stays null, although greatest and least skip it."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def half_even(x: Column) -> Column:
    return F.bround(x, 0).cast("int")


def z_score(x: Column, mean: Column, sd: Column, n: Column, flat: float = 1e-9) -> Column:
    """Null where fewer than two values, or a flat baseline, leave it undefined."""
    return F.when((n >= 2) & (sd > flat), (x - mean) / sd)


def sd_or_zero(x: Column) -> Column:
    return F.coalesce(F.stddev_samp(x), F.lit(0.0))


def coefficient_of_variation(mean: Column, sd: Column) -> Column:
    return F.when(mean == 0, 0.0).otherwise(100 * sd / F.abs(mean))


def smallest_worthwhile_change(mean: Column, sd: Column) -> Column:
    return 0.5 * coefficient_of_variation(mean, sd)


def normal_below(x: Column, mean: Column, sd: Column) -> Column:
    """P(X < x), by the polynomial 7.1.26 of Abramowitz and Stegun (error below 1.5e-7)."""
    u = F.abs(x - mean) / (sd * F.sqrt(F.lit(2.0)))
    t = 1 / (1 + 0.3275911 * u)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-u * u)
    return F.when(sd <= 0, F.when(x >= mean, 1.0).otherwise(0.0)).when(x >= mean, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))


def day_number(day: Column) -> Column:
    return F.datediff(day, F.lit("1970-01-01").cast("date"))


def days(before: int, after: int, by: str = "user_id", order: str = "dayno") -> WindowSpec:
    """Calendar days around a row, whatever days have rows."""
    return Window.partitionBy(by).orderBy(order).rangeBetween(before, after)


def so_far(by: str = "user_id", order: str = "dayno") -> WindowSpec:
    return Window.partitionBy(by).orderBy(order).rangeBetween(Window.unboundedPreceding, 0)


def ewma(load: Column, since: Column, days_constant: float, window: WindowSpec, seed: Column | float = 0.0) -> Column:
    """Exponentially weighted mean over dense days, from sparse rows: days without a row add nothing.

    since is the day's number from the athlete's first, 0 there. Beyond 500 time constants (57 years for 42 days,
    9 for 7) the running sum would overflow; carry the state into a new series before that.
    """
    alpha = 1 - F.exp(F.lit(-1.0 / days_constant))
    age = since.cast("double") / days_constant
    running = F.sum(load * F.exp(age)).over(window)
    seed = seed if isinstance(seed, Column) else F.lit(float(seed))
    return F.exp(-age) * alpha * running + seed * F.exp(-(since + 1).cast("double") / days_constant)


def ewma_fold(values: Column, days_constant: float, seed: Column) -> Column:
    """The same as a recurrence over an array of daily values."""
    alpha = 1 - F.exp(F.lit(-1.0 / days_constant))
    return F.aggregate(values, seed, lambda y, x: y + alpha * (x - y))


__all__ = [x for x in dir() if not x.startswith("_")]
