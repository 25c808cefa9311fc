"""What the operators share: columns, a shared folder for written tables, and a cache of per-word results."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .wordhash import BLOCK, U, Words


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def residue(column: str, n: int) -> Column:
    """crc32 of the value as text, modulo n."""
    return F.crc32(F.col(column).cast("string")) % n


#: Folders with written tables of this session, the oldest first.
WRITTEN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share. Where it is unset, a local session gets a
    temporary one; on a cluster, where executors couldn't see that, this raises an error."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(top)
    WRITTEN.append(f"{top.rstrip('/')}/written-{uuid.uuid4().hex}")
    return WRITTEN[-1]


def drop_written(spark: SparkSession, kept: int = 0) -> None:
    """Deletes the written tables of this session, but for the first `kept` folders: results that read them end with that."""
    while len(WRITTEN) > kept:
        removed(spark, WRITTEN.pop())


#: Bytes of an Arrow batch, about: what a Python worker holds of the input.
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's limit of bytes for Arrow batches to that of the operators, where it is higher."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(re.sub(r"\D", "", spark.conf.get(key)) or 0) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def trimmed() -> None:
    """Gives memory that is free in this process back to the system: workers live on after a task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def heaps_trimmed(spark: SparkSession) -> None:
    """Has the executors collect their garbage, by which their JVMs give free heap back to the system: else an executor keeps
    the most heap that any step of the session took, beside what the Python workers of the next one need. A task for each
    core, all at once, reaches every executor that has a free one; it reads no table and changes no result."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()


def mapped(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType, seconds: float = 2.0) -> DataFrame:
    """mapInArrow whose worker gives memory back now and then and at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = time.monotonic()
        try:
            for out in f(batches):
                yield out
                if time.monotonic() > last + seconds:
                    trimmed()
                    last = time.monotonic()
        finally:
            trimmed()

    return df.mapInArrow(run, schema)


#: Lets Spark delete the shuffle files of a query that has ended, which else stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, folder: str, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again, so that a lost executor costs no recomputation. The shuffle
    files of the writing go when it has ended, so that disk is needed for one step at a time."""
    path, spark = f"{folder}/{name}", df.sparkSession
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a written table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Words of 64 bits of by_bucket's bitmap, and so the most rows that it broadcasts, whatever the number and size of the keys.
BITMAP = 1 << 19


def by_bucket(rows: DataFrame, keys: DataFrame, column: str, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows whose key may be among keys, and the others, without a shuffle: by hash bucket. The buckets in use are
    broadcast, 64 in a row, so that few of 2^25 hold a key that isn't meant as long as there are some million keys."""
    key = key or keys.columns[0]
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(64 * BITMAP))
    word, bit = F.shiftright("__bucket", 6), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("__bucket", F.lit(64)).cast("int"))
    some = keys.select(bucket(key).alias("__bucket")).groupBy(word.alias("__word")).agg(F.bit_or(bit).alias("__bits"))
    keyed = rows.withColumn("__bucket", bucket(column)).withColumn("__word", word).join(F.broadcast(some), "__word", "left")
    among = F.coalesce(F.col("__bits").bitwiseAND(bit), F.lit(0)) != 0
    return tuple(keyed.filter(x).drop("__bucket", "__word", "__bits") for x in (among, ~among))


#: Bytes of the longest word that stays in a full cache.
STAYS = 64


class WordCache:
    """Results per distinct word; make(words) gives a row of numbers for each new one. Words are found by hash and then
    compared byte by byte, so that two words of one hash each get their own.

    Beyond `most` words, or 8 times as many blocks of bytes, the half that was found again most often of late stays, but no
    long words, so its memory is bounded. kept(rows) gives the rows of those that stay, if they change with that.
    """

    def __init__(self, make: Callable[[list[str]], np.ndarray], most: int = 1 << 18, kept: Callable[[np.ndarray], np.ndarray] = lambda rows: rows) -> None:
        self.make, self.most, self.kept = make, most, kept
        #: Sorted hashes and the entry of each; by entry its row, its place in the blocks and its size in bytes, and how often it was found.
        self.keys, self.entry, self.rows = np.zeros(0, U), np.zeros(0, np.int32), None
        self.place, self.found = np.zeros((0, 2), np.int32), np.zeros(0, np.int32)
        self.blocks, self.used = np.zeros(1 << 12, U), 0

    def _shrink(self) -> None:
        """Leaves the words that stay, in order of their hashes."""
        n = len(self.keys)
        stays = (self.found[:n] > 0) & (self.place[:n, 1] <= STAYS)
        if np.count_nonzero(stays) > self.most // 2:
            stays &= self.found[:n] > np.partition(self.found[:n], n - self.most // 2)[n - self.most // 2]
        keep = stays[self.entry]
        old = self.entry[keep]
        size = self.place[old, 1]
        count = (size + BLOCK - 1) // BLOCK
        ends = np.cumsum(count)
        self.used = int(ends[-1]) if len(old) else 0
        self.blocks = np.append(self.blocks[np.repeat(self.place[old, 0] - (ends - count), count) + np.arange(self.used)], np.zeros(1 << 12, U))
        self.keys, self.entry = self.keys[keep], np.arange(len(old), dtype=np.int32)
        self.place, self.found = np.column_stack([ends - count, size]).astype(np.int32), self.found[old] // 2
        self.rows = self.kept(self.rows[old])

    def _add(self, w: Words, at: np.ndarray, keys: np.ndarray, first: np.ndarray) -> None:
        """Puts the words at first, whose hashes are keys, into the cache before the entries at."""
        rows = self.make(texts_of(w, first))
        begin, count = w.block[first], w.block[first + 1] - w.block[first]
        ends = np.cumsum(count)
        total = int(ends[-1])
        while self.used + total > len(self.blocks):
            self.blocks = np.concatenate([self.blocks, np.zeros_like(self.blocks)])
        self.blocks[self.used : self.used + total] = w.blocks[np.repeat(begin - (ends - count), count) + np.arange(total)]
        n, m = len(self.keys), len(keys)
        if self.rows is None:
            self.rows = rows[:0].copy()
        if n + m > len(self.place):
            more = max(m, n // 4)
            larger = lambda x: np.concatenate([x[:n], np.zeros((more, *x.shape[1:]), x.dtype)])
            self.place, self.found, self.rows = larger(self.place), larger(self.found), larger(self.rows)
        self.place[n : n + m] = np.column_stack([self.used + ends - count, w.size[first]])
        self.found[n : n + m], self.rows[n : n + m] = 0, rows
        self.used += total
        self.keys, self.entry = np.insert(self.keys, at, keys), np.insert(self.entry, at, np.arange(n, n + m, dtype=np.int32))

    def __call__(self, w: Words) -> np.ndarray:
        """A row for each word of w."""
        keys, first, which = np.unique(w.hash, return_index=True, return_inverse=True)
        if not len(keys) and self.rows is None:
            return self.make([])
        if len(self.keys) > self.most or self.used > 8 * self.most:
            self._shrink()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        known[at < len(self.keys)] = self.keys[at[at < len(self.keys)]] == keys[at < len(self.keys)]
        self.found[self.entry[at[known]]] += 1
        if not known.all():
            self._add(w, at[~known], keys[~known], first[~known])
            at = np.searchsorted(self.keys, keys)
        entry = self.entry[at][which]
        count = np.diff(w.block)
        other = self.place[entry, 1] != w.size
        where = np.repeat(self.place[entry, 0] - w.block[:-1], count) + np.arange(len(w.blocks))
        differs = self.blocks[np.minimum(where, self.used - 1)] != w.blocks
        if differs.any():
            other[np.repeat(np.arange(len(entry)), count)[differs]] = True
        if not other.any():
            return self.rows[entry]
        out, some = self.rows[entry], np.flatnonzero(other)
        texts = texts_of(w, some)
        distinct = {t: i for i, t in enumerate(dict.fromkeys(texts))}
        out[some] = self.make(list(distinct))[[distinct[t] for t in texts]]
        return out


def texts_of(w: Words, some: np.ndarray) -> list[str]:
    """The words at these places, as strings."""
    data = memoryview(w.data)
    return [str(data[a:b], "utf-8", "replace") for a, b in zip(w.start[some].tolist(), w.end[some].tolist(), strict=True)]


def sums_by_text(values: np.ndarray, w: Words) -> np.ndarray:
    """Sums over the words of each text."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    return total[w.first[1:]] - total[w.first[:-1]]
