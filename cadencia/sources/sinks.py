"""Tables on disk: raw events, typed rows and metrics, with the guarantees that a store would give."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def work_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share. Only a local session gets a temporary one."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/work-{uuid.uuid4().hex}"


def is_folder(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


class VersionedTable:
    """A table that batches are merged into by key, the last row of a key staying. Each batch writes the next version, named
    by the batch, so that a batch that runs again changes nothing; a version is there when its _SUCCESS is, and readers keep
    the one that they began with. Two versions are kept. The whole table is written for each batch: for tables whose
    batches touch few months, use overwrite_partitions."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str], schema: T.StructType) -> None:
        self.spark, self.path, self.keys, self.order, self.schema = spark, path.rstrip("/"), keys, order, schema

    def _files(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        at, files = self._files(self.path)
        if not files.exists(at):
            return []
        found = [s.getPath() for s in files.listStatus(at)]
        return sorted(int(p.getName()[2:]) for p in found if p.getName().startswith("v-") and self._files(f"{p}/_SUCCESS")[1].exists(self._files(f"{p}/_SUCCESS")[0]))

    def read(self) -> DataFrame:
        versions = self.versions()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v-{versions[-1]}") if versions else self.spark.createDataFrame([], self.schema)

    def upsert(self, batch: DataFrame, number: int) -> None:
        if number in self.versions():
            return
        rest = [c for c in self.schema.names if c not in (*self.keys, *self.order)]
        both = self.read().withColumn("__new", F.lit(0)).unionByName(batch.select(*self.schema.names).withColumn("__new", F.lit(1)))
        last = both.groupBy(*self.keys).agg(F.max_by(F.struct(*self.order, *rest), F.struct(*self.order, "__new")).alias("r")).select(*self.keys, "r.*")
        last.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/v-{number}")
        for old in self.versions()[:-2]:
            at, files = self._files(f"{self.path}/v-{old}")
            files.delete(at, True)


def append_new(rows: DataFrame, stored: DataFrame | None, keys: list[str], path: str, partition: str | None = None) -> None:
    """Appends the rows whose key isn't stored yet, one for each key: an insert that ignores conflicts. Nothing is changed."""
    new = rows.dropDuplicates(keys)
    if stored is not None:
        new = new.join(stored.select(*keys), keys, "left_anti")
    writer = new.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def by_month(rows: DataFrame, day: str) -> DataFrame:
    """With the month that the table is partitioned by, so that a range of days reads few folders."""
    return rows.withColumn("month", F.date_format(day, "yyyy-MM"))


def overwrite_partitions(rows: DataFrame, path: str, partition: str) -> None:
    """Replaces just the partitions that the rows are in: a recompute of some months leaves the others alone."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def pending_chunks(chunks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks of an import that aren't done yet."""
    return chunks.join(done.filter("status = 'done'").select(*keys), keys, "left_anti")


def import_progress(chunks: DataFrame, by: list[str], most_attempts: int = 3) -> DataFrame:
    """Chunks done, open, to retry and given up, and attempts, of each import."""
    n = lambda condition: F.count(F.when(condition, 1))
    failed = F.col("status") == "failed"
    return chunks.groupBy(*by).agg(
        n(F.col("status") == "done").alias("done"),
        n(F.col("status").isin("pending", "running")).alias("open"),
        n(failed & (F.col("attempts") < most_attempts)).alias("to_retry"),
        n(failed & (F.col("attempts") >= most_attempts)).alias("given_up"),
        F.sum("attempts").cast("bigint").alias("attempts"),
    )


def high_water_mark(events: DataFrame, received: str = "received_at") -> DataFrame:
    """The latest arrival by user and kind: by upload time, so that a late sync isn't skipped."""
    return events.groupBy("user_id", "kind").agg(F.max(received).alias("synced_to"), F.count("*").alias("events"))


def retained(rows: DataFrame, day: str, today: str, keep_days: int) -> DataFrame:
    return rows.filter(F.col(day) >= F.date_sub(F.lit(today).cast("date"), keep_days))
