"""The streaming jobs over the driver's tables: each runs over all that is there, ends, and must equal its batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import sinks
from ..sources import provider as pv
from ..streaming import jobs
from . import ingest, training

SPARK: dict = {}
ORACLE: dict[str, str] = {}
#: Files of a batch of the written tables.
FILES_PER_BATCH = 1000


def register(oracle: str | None = None):
    def add(f):
        SPARK[f.__name__] = f
        if oracle is not None:
            ORACLE[f.__name__] = oracle
        return f

    return add


def events(spark, d) -> DataFrame:
    """The events as a stream of files."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return jobs.file_stream(spark, f"{d}/events.parquet", schema) if sinks.is_folder(spark, f"{d}/events.parquet") else jobs.file_stream(spark, d, schema, name="events.parquet")


def written(rows: DataFrame, spark) -> DataFrame:
    """The stream's rows, once it has ended."""
    folder = sinks.work_folder(spark)
    jobs.write_once(rows, f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows")


@register("""SELECT DISTINCT 'provider:' || CASE WHEN event_id % 3 = 0 THEN 'e' || (event_id // 2) ELSE 'sha256:' || sha256(user_id || '|' || (event_id // 4)) END AS event_key FROM events""")
def stream_ingest(spark, d):
    """Deliveries, each event once."""
    e = F.col("event_id")
    body = F.concat_ws("|", F.col("user_id").cast("string"), F.floor(e / 4).cast("string"))
    key = pv.event_key(F.when(e % 3 == 0, F.concat(F.lit("e"), F.floor(e / 2).cast("string"))), body)
    rows = events(spark, d).select(key.alias("event_key"), F.col("ts").cast("timestamp").alias("received_at"))
    return written(jobs.deduplicated(rows, delay="90 days").select("event_key"), spark)


@register("""SELECT user_id, min(ts::DATE) AS from_day, count(*) AS events, epoch(time_bucket(INTERVAL 60 SECONDS, ts))::BIGINT AS window_epoch FROM events GROUP BY user_id, time_bucket(INTERVAL 60 SECONDS, ts) HAVING time_bucket(INTERVAL 60 SECONDS, ts) + INTERVAL 60 SECONDS <= (SELECT max(ts) FROM events) - INTERVAL 5 MINUTES""")
def stream_recomputes(spark, d):
    """One recompute for each athlete and minute; minutes that the watermark hasn't passed yet are still open."""
    rows = events(spark, d).select("user_id", F.col("ts").cast("timestamp").alias("received_at"), F.to_date("ts").alias("local_date"))
    out = written(jobs.coalesced_recomputes(rows), spark)
    return out.select("user_id", "from_day", "events", F.unix_seconds("window_start").alias("window_epoch"))


@register(training.ORACLE["form_curve"])
def stream_form(spark, d):
    """Form from state, day by day. All days of an athlete are in one file, and so in one batch, however many files there are."""
    path = f"{sinks.work_folder(spark)}/daily"
    training.daily(spark, d).select("user_id", "day", "load").repartition("user_id").write.parquet(path)
    rows = jobs.form_updates(jobs.file_stream(spark, path, spark.read.parquet(path).schema, files_per_batch=FILES_PER_BATCH))
    return written(rows, spark).select("user_id", "day", F.round("load", 2).alias("load"), "ctl", "atl", F.round("tsb", 2).alias("tsb"))


@register(ingest.ORACLE["normalise_activity"] + " WHERE e % 41 <> 0")
def stream_activities(spark, d):
    """Raw events to sessions: kept as they came, those with a good signature parsed, and merged by key into a table."""
    folder = sinks.work_folder(spark)
    raw = ingest.payloads_of(events(spark, d)).withColumn("verdict", F.when(F.col("event_id") % 41 == 0, "signed_invalid").otherwise("signed_valid"))
    jobs.write_once(raw, f"{folder}/raw", f"{folder}/raw-checkpoint").awaitTermination()
    kept = jobs.file_stream(spark, f"{folder}/raw", raw.schema, files_per_batch=FILES_PER_BATCH)
    rows = jobs.parsed_activities(jobs.verified(kept)).drop("body", "verdict")
    target = sinks.VersionedTable(spark, f"{folder}/activities", ["provider_activity_id"], ["ts"], rows.schema)
    jobs.upsert_once(rows, target, f"{folder}/checkpoint").awaitTermination()
    return ingest.normalised(target.read())



