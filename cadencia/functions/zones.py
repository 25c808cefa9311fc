"""Training zones as arrays of (zone, name, low, high); an open end is infinite inside and null outside."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import HR_MAX_ZONES, LTHR_ZONES, POWER_ZONES, SPEED_ZONES
from .stats import present


def bands(anchor: Column, table: tuple) -> Column:
    zone = lambda i, name, low, high: F.struct(F.lit(i).alias("zone"), F.lit(name).alias("name"), (anchor * F.lit(low)).alias("low"), (anchor * F.lit(math.inf if high is None else high)).alias("high"))
    return F.when(anchor.isNotNull(), F.array(*(zone(i, *z) for i, z in enumerate(table, 1))))


def hr_zones(lthr: Column, hr_max: Column) -> Column:
    """From a measured threshold, else from the (measured or estimated) maximum."""
    return F.coalesce(bands(F.nullif(lthr, F.lit(0)).cast("double"), LTHR_ZONES), bands(hr_max.cast("double"), HR_MAX_ZONES))


def power_zones(ftp: Column) -> Column:
    return bands(present(ftp), POWER_ZONES)


def pace_zones(threshold: Column) -> Column:
    """In seconds a kilometre: faster is smaller, so the ends change places."""
    pace = present(threshold)
    zone = lambda i, name, low, high: F.struct(F.lit(i).alias("zone"), F.lit(name).alias("name"), (F.lit(0.0) if high is None else pace / high).alias("low"), (F.lit(math.inf) if low == 0 else pace / low).alias("high"))
    return F.when(pace.isNotNull(), F.array(*(zone(i, *z) for i, z in enumerate(SPEED_ZONES, 1))))


def zone_of(value: Column, zones: Column) -> Column:
    """Number of the first zone that holds the value; above the last one's beginning, the last; below the first, null."""
    inside = F.filter(zones, lambda z: (z.low <= value) & (value < z.high))
    last = F.element_at(zones, -1)
    return F.coalesce(F.get(inside, F.lit(0)).zone, F.when(value >= last.low, last.zone))


def finite(x: Column) -> Column:
    return F.when(x < F.lit(math.inf), x)
