"""Race predictions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import VDOT_BRACKET_S, VDOT_STEPS


def riegel(time: Column, distance: Column, target: Column, exponent: Column) -> Column:
    return time * F.pow(target / distance, exponent)


def vdot(distance: Column, time: Column) -> Column:
    minutes = time / 60
    v = distance / minutes
    cost = -4.60 + 0.182258 * v + 0.000104 * v * v
    share = 0.8 + 0.1894393 * F.exp(-0.012778 * minutes) + 0.2989558 * F.exp(-0.1932605 * minutes)
    return cost / share


def time_from_vdot(value: Column, distance: Column) -> Column:
    """By bisection in a fixed number of steps, which take the bracket below 0.01 s; outside the bracket, its end."""
    low, high = (F.lit(x) for x in VDOT_BRACKET_S)
    start = F.struct(low.alias("low"), high.alias("high"))

    def step(b: Column, _: Column) -> Column:
        mid = (b.low + b.high) / 2
        slow = vdot(distance, mid) > value
        return F.struct(F.when(slow, mid).otherwise(b.low).alias("low"), F.when(slow, b.high).otherwise(mid).alias("high"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(VDOT_STEPS)), start, step, lambda b: F.round((b.low + b.high) / 2 + 1e-9, 2))
    return F.when(vdot(distance, high) > value, high).when(vdot(distance, low) < value, low).otherwise(found)


def critical_speed(d1: Column, t1: Column, d2: Column, t2: Column) -> tuple[Column, Column]:
    cs = (d2 - d1) / F.nullif(t2 - t1, F.lit(0.0))
    return F.round(cs + 1e-9, 4), F.round(d1 - cs * t1 + 1e-9, 1)


def critical_power(p1: Column, t1: Column, p2: Column, t2: Column) -> tuple[Column, Column]:
    work = (p1 - p2) / F.nullif(1 / F.nullif(t1, F.lit(0.0)) - 1 / F.nullif(t2, F.lit(0.0)), F.lit(0.0))
    return F.round(p1 - work / t1 + 1e-9, 1), F.round(work + 1e-9, 0)


def estimated_1rm(weight: Column, reps: Column) -> tuple[Column, Column, Column, Column]:
    """(Epley, Brzycki, their mean, whether at most 12 repetitions make them reliable)."""
    epley = F.when(reps == 1, weight).otherwise(weight * (1 + reps / 30))
    brzycki = F.when(reps == 1, weight).when(reps < 37, weight * 36 / F.nullif(37 - reps, F.lit(0))).otherwise(epley)
    r = lambda x: F.round(x + 1e-9, 1)
    return r(epley), r(brzycki), r((epley + brzycki) / 2), reps <= 12
