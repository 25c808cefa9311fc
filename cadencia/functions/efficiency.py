"""Output for effort."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stats import present


def positive(x: Column) -> Column:
    return F.when(x > 0, x)


def decoupling_pct(first: Column, second: Column) -> Column:
    """Fall of the output for a heart beat from the first half to the second; power where there is some, else speed."""
    ratio = lambda h: positive(F.coalesce(present(h.avg_power), present(h.avg_speed_m_s))) / positive(h.avg_hr)
    a, b = ratio(first), ratio(second)
    return F.round(100 * (a - b) / positive(a) + 1e-9, 2)


def session_metrics(c=F.col) -> Column:
    """(metric, value, unit) of every metric that the session has the data for."""
    active = F.coalesce(F.nullif(c("moving_time_s"), F.lit(0)), c("duration_s"))
    power = F.coalesce(present(c("normalized_power")), present(c("avg_power")))
    distance, strokes = present(c("distance_m")), F.nullif(c("total_strokes"), F.lit(0))
    lengths = distance / present(c("pool_length_m"))
    item = lambda condition, name, value, unit: F.when(condition & value.isNotNull(), F.struct(F.lit(name).alias("metric"), F.round(value + 1e-9, 4).alias("value"), F.lit(unit).alias("unit")))
    sport = c("sport")
    found = F.array(
        item(sport == "run", "running_efficiency_index", positive(distance) / (active / 60) / positive(c("avg_hr")), "m/min/bpm"),
        item(sport == "bike", "cycling_efficiency_factor", positive(power) / positive(c("avg_hr")), "W/bpm"),
        item(sport == "swim", "stroke_index", positive(distance / active) * positive(distance / strokes), "m^2/s"),
        item((sport == "swim") & (lengths >= 1), "swolf", active / lengths + strokes / lengths, "s+strokes"),
        item(F.lit(True), "aerobic_decoupling", decoupling_pct(c("first_half"), c("second_half")), "%"),
    )
    return F.filter(found, lambda x: x.isNotNull())
