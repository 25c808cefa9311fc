"""Streams of provider events and daily loads. Every job gives what the batch operators give over the same rows.

Watermarks are on the time of arrival, not of the activity: a watch that syncs after a week is late training, not a late
event. Days that such a sync changes are computed again from the earliest one on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.series import form_curve
from ..params import ATL_DAYS, CTL_DAYS
from ..sources import provider as pv
from ..sources.sinks import VersionedTable

STATE = "last_day date, ctl double, atl double"
FORM = "user_id bigint, day date, load double, ctl double, atl double, tsb double"


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1, name: str | None = None) -> DataFrame:
    """Files of raw events in the order of arrival, all in the folder or those of a name; the number of files a batch is the back pressure."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return (stream.option("pathGlobFilter", name) if name else stream).parquet(path)


def json_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """The same for files of JSON lines, plain or gzipped (.json.gz); a malformed line's columns are null."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def prioritised(spark: SparkSession, live: str, backfill: str, schema, live_files: int = 16, backfill_files: int = 1) -> tuple[DataFrame, DataFrame]:
    """Two streams of raw events, live ones ahead of history: a batch of the live stream takes so many files, one of the
    import only a few, and each runs as a query of its own, so that a long import never holds up what comes in."""
    return file_stream(spark, live, schema, live_files).withColumn("priority", F.lit("live")), file_stream(spark, backfill, schema, backfill_files).withColumn("priority", F.lit("backfill"))


def deduplicated(events: DataFrame, key: str = "event_key", received: str = "received_at", delay: str = "1 hour") -> DataFrame:
    """The first delivery of each event; retries arrive within the delay."""
    return events.withWatermark(received, delay).dropDuplicatesWithinWatermark([key])


def verified(events: DataFrame) -> DataFrame:
    """Events whose verdict at the edge lets them be acted on."""
    return events.filter(F.col("verdict") == "signed_valid")


def parsed_activities(events: DataFrame, body: str = "body") -> DataFrame:
    """Bodies to sessions, the same expression as in batch."""
    return pv.normalise_activities(events, body)


def coalesced_recomputes(events: DataFrame, received: str = "received_at", delay: str = "5 minutes", width: str = "60 seconds") -> DataFrame:
    """One job for each athlete and minute, from the earliest day that its events touch."""
    rows = events.withWatermark(received, delay).groupBy(F.window(received, width), "user_id").agg(F.min("local_date").alias("from_day"), F.count("*").alias("events"))
    return rows.select("user_id", "from_day", "events", F.col("window.start").alias("window_start"))


def form_updates(daily: DataFrame) -> DataFrame:
    """Form from state: an athlete's (last day, ctl, atl) is carried over batches, and rest days decay it.

    Expects user_id, day and load, each day once and in order over the batches, within one in any order; a day that isn't
    after the last of an earlier batch is left to recompute_from(). An athlete's days of a batch, which may come in
    several frames, are held together.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, ctl, atl = state.get if state.exists else (None, 0.0, 0.0)
        out = []
        for day, load in sorted(row for frame in frames for row in zip(frame["day"], frame["load"], strict=True)):
            if last is not None and day <= last:
                continue
            gap = 1 if last is None else (day - last).days
            ctl = ctl * math.exp(-gap / CTL_DAYS) + (1 - math.exp(-1 / CTL_DAYS)) * load
            atl = atl * math.exp(-gap / ATL_DAYS) + (1 - math.exp(-1 / ATL_DAYS)) * load
            last = day
            c, a = round(ctl + 1e-9, 2), round(atl + 1e-9, 2)
            out.append((key[0], day, load, c, a, c - a))
        if last is not None:
            state.update((last, ctl, atl))
        yield pd.DataFrame(out, columns=["user_id", "day", "load", "ctl", "atl", "tsb"])

    return daily.groupBy("user_id").applyInPandasWithState(fold, FORM, STATE, "append", GroupStateTimeout.NoTimeout)


def recompute_from(stored_loads: DataFrame, changed: DataFrame) -> DataFrame:
    """Form of the athletes with changed days, from the earliest of them on. stored_loads already holds the changes."""
    earliest = changed.groupBy("user_id").agg(F.min("day").alias("from_day"))
    rows = form_curve(stored_loads.join(earliest.select("user_id"), "user_id", "left_semi"))
    return rows.join(earliest, "user_id").filter("day >= from_day").drop("from_day", "dayno", "since")


def upsert_once(rows: DataFrame, target: VersionedTable, checkpoint: str):
    """Merges the stream into the table, batch by batch, over all that is there, and ends."""
    return rows.writeStream.foreachBatch(target.upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_once(rows: DataFrame, path: str, checkpoint: str):
    """Runs the stream over all that is there and ends; exactly once by the checkpoint."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
