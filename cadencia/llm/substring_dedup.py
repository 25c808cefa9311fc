"""Substring dedup (method: a log-structured fingerprint index).

A window is `size` consecutive words of one document. Consecutive windows with the same least 9-word hash (their
fingerprint, a winnowing) form a span. Equal windows have equal fingerprints, so only spans that share one can hold
equal windows. The index is a list of immutable runs: the distinct spans of a batch of documents with their number and
one place, range-partitioned and sorted by fingerprint. Adding a batch

1. merge-joins its fingerprints with the earlier runs, so that only earlier spans that share one go on,
2. writes its spans as a new run,
3. verifies: spans are equal if the BLAKE2b digests (128 bits) of their words are; of the spans that share a fingerprint
   only, the texts are read again and their windows compared by such digests,
4. gives the places of all windows that are known to repeat now and weren't before: those of the batch, and those of
   earlier documents whose window occurred once so far. What a late batch does to earlier documents is thus a list of
   their places; remove_repeats collects the lists of all batches before it takes any word away, so the number of batches
   doesn't change its result.

Counts are pre-aggregated before each shuffle, runs are partitioned by fingerprint and content, joins are equi-joins of
written tables that adaptive execution can split, and each distinct text and span is looked at once however many copies
there are, so no hot passage meets in one task.

Null and empty texts and texts shorter than a window lose nothing; very long texts are taken whole, in a slice of their
own; a repeated row is another document with the same words, so both lose every word once they have a window (no tie is
broken: no copy is kept); an empty table gives no rows; input columns named like a result are replaced, all others are
kept. Texts are told apart by the BLAKE2b digests of their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bucket, mapped, removed, saved, shared_folder, small_batches
from .wordhash import STEP, U, Words, digests, hashed, mix, sliding_min

SIZE, SHINGLE = 35, 9
#: Runs of an index before they are compacted, and batches that a whole table is added in.
MOST_RUNS, BATCHES = 1, 2
#: A span: its fingerprint, the digest of its words, that of its text, its first word, its windows, whether a window recurs in it, and how often it was met.
SPAN = "fp bigint, c1 bigint, c2 bigint, s1 bigint, s2 bigint, start int, n int, inner boolean, copies bigint"
PLACES = "s1 bigint, s2 bigint, start int, n int"


def signatures(w: Words, joined: tuple[bytes, np.ndarray, np.ndarray]) -> np.ndarray:
    """The digest of the word sequence of each text, as two numbers; of texts without words, that of nothing."""
    text, begin, end = joined
    begin, end = np.append(begin, 0), np.append(end, 0)
    some = w.counts > 0
    first, last = np.where(some, w.first[:-1], len(begin) - 1), np.where(some, w.first[1:] - 1, len(end) - 1)
    return digests(text, begin[first], end[last])


def spans(w: Words, size: int = SIZE, shingle: int = SHINGLE) -> dict[str, np.ndarray]:
    """Runs of windows with one fingerprint: text, first (word), n (windows), fp and inner (whether a window recurs within it)."""
    hashes, whole = w.windows(size)
    at = np.flatnonzero(whole)
    if not len(at):
        return {}
    least = sliding_min(w.windows(min(shingle, size))[0], size - min(shingle, size) + 1)[at]
    text = w.text_of()[at]
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    span = np.cumsum(new) - 1
    keyed = mix(hashes[at] + span.astype(U) * STEP)
    inner = np.zeros(len(first), bool)
    order = np.sort(keyed)
    if (order[1:] == order[:-1]).any():
        _, back, count = np.unique(keyed, return_inverse=True, return_counts=True)
        inner[span[count[back] > 1]] = True
    return {"text": text[first], "first": at[first], "n": n, "fp": least[first], "inner": inner}


def entries(docs: DataFrame, text_col: str, size: int) -> DataFrame:
    """The spans of all texts. Of texts that are equal in a batch of rows, the spans are given once, with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            for _, w in hashed(batch.column(0)):
                if x := spans(w, size):
                    joined = w.joined()
                    sig = signatures(w, joined)
                    _, one, which, count = np.unique(sig, axis=0, return_index=True, return_inverse=True, return_counts=True)
                    copies = np.zeros(len(sig), np.int64)
                    copies[one] = count
                    some = copies[x["text"]] > 0
                    text, first, n = x["text"][some], x["first"][some], x["n"][some]
                    content = digests(joined[0], joined[1][first], joined[2][first + n + size - 2])
                    held.append((x["fp"][some].view(np.int64), content[:, 0], content[:, 1], sig[text, 0], sig[text, 1], (first - w.first[text]).astype(np.int32), n.astype(np.int32), x["inner"][some], copies[text]))
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], schema=pa.schema([("fp", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("inner", pa.bool_()), ("copies", pa.int64())]))

    return mapped(docs.select(F.col(text_col).cast("string")), run, SPAN)


def kinds_of(rows: DataFrame) -> DataFrame:
    """Distinct spans, with the number of all and the least place."""
    found = rows.groupBy("fp", "c1", "c2").agg(F.sum("copies").alias("copies"), F.min(F.struct("s1", "s2", "start", "n", "inner")).alias("one"))
    return found.select("fp", "c1", "c2", "one.s1", "one.s2", "one.start", "one.n", "one.inner", "copies")


class FingerprintIndex:
    """Sorted immutable runs of the spans of all texts so far."""

    def __init__(self, spark: SparkSession, folder: str | None = None, size: int = SIZE, most_runs: int = MOST_RUNS) -> None:
        self.spark, self.size, self.most_runs = spark, size, most_runs
        small_batches(spark)
        self.folder = folder or shared_folder(spark)
        self.runs: list[str] = []
        self.made = 0

    def _write(self, kinds: DataFrame) -> DataFrame:
        self.made += 1
        # content is in the order too, so that a fingerprint of many different spans isn't one task's
        run = saved(kinds.repartitionByRange("fp", "c1").sortWithinPartitions("fp", "c1", "c2"), self.folder, f"run-{self.made}")
        self.runs.append(f"{self.folder}/run-{self.made}")
        return run

    def compact(self) -> None:
        """Merges all runs into one, in order of the fingerprints."""
        old, rows = self.runs, self.rows()
        self.runs = []
        self._write(kinds_of(rows))
        for path in old:
            removed(self.spark, path)

    def rows(self) -> DataFrame:
        """The spans of all runs; a span that several batches have is in several."""
        return self.spark.read.schema(SPAN).parquet(*self.runs) if self.runs else self.spark.createDataFrame([], SPAN)

    def known(self, batch: DataFrame) -> DataFrame:
        """The runs' spans whose fingerprint the batch's spans have too: a merge join."""
        return self.rows().join(batch.select("fp").distinct().hint("merge"), "fp")

    def drop(self) -> None:
        """Deletes the runs. What add() has given stays readable no longer."""
        removed(self.spark, self.folder)

    def add(self, docs: DataFrame, text_col: str = "text", texts: DataFrame | None = None, texts_col: str = "text") -> DataFrame:
        """Adds a batch and gives (s1, s2, start, n): the runs of windows, of this batch or earlier ones, that are now known
        to occur elsewhere too. `texts` has the texts of all batches so far, this one too; they are read by digest."""
        at = f"batch-{self.made}"
        names = ("found", "seen", "several", "wanted", "windows", "twice")
        keep = lambda df, name: saved(df, self.folder, f"{at}-{name}")
        found = keep(entries(docs, text_col, self.size), "found")
        known = self.known(found).withColumn("old", F.col("copies"))
        new = self._write(kinds_of(found))
        both = known.unionByName(new.withColumn("old", F.lit(0).cast("bigint")))
        # where both have a span, an earlier place is wanted: it is the one to give out if it was the only one
        place = F.min(F.when(F.col("old") > 0, F.struct("s1", "s2", "start", "n")))
        seen = both.groupBy("fp", "c1", "c2").agg(F.sum("copies").alias("copies"), F.sum("old").alias("old"), F.min(F.struct("s1", "s2", "start", "n", "inner")).alias("one"), place.alias("before"))
        seen = keep(seen, "seen")
        whole = seen.filter("copies > 1 and copies > old")
        places = found.join(whole.select("fp", "c1", "c2"), ["fp", "c1", "c2"]).select("s1", "s2", "start", "n").distinct()
        places = places.unionByName(whole.filter("old = 1").select("before.s1", "before.s2", "before.start", "before.n"))
        # windows of spans that aren't alone with their fingerprint, one span for each content
        several = keep(seen.groupBy("fp").agg(F.count("*").alias("k"), F.max(F.col("one.inner") & (F.col("copies") == 1)).alias("inner")).filter("k > 1 or inner").select("fp"), "several")
        ones = seen.join(several, "fp").select("one.s1", "one.s2", "one.start", "one.n", "copies")
        wanted = keep(ones.groupBy("s1", "s2").agg(F.collect_list(F.struct("start", "n", "copies")).alias("places")), "wanted")
        texts, texts_col = (docs, text_col) if texts is None else (texts, texts_col)
        windows = keep(self._windows(distinct_texts(texts, texts_col, wanted).join(wanted, ["s1", "s2"])), "windows")
        twice = keep(windows.groupBy("h1", "h2").agg(F.sum("copies").alias("copies")).filter("copies > 1").select("h1", "h2"), "twice")
        edge = windows.filter("copies = 1").join(twice, ["h1", "h2"]).select("s1", "s2", "start", F.lit(1).cast("int").alias("n"))
        out = keep(places.unionByName(edge), "repeats")
        for name in names:
            removed(self.spark, f"{self.folder}/{at}-{name}")
        if len(self.runs) > self.most_runs:
            self.compact()
        return out

    def _windows(self, texts: DataFrame) -> DataFrame:
        """The digests of the windows at the places of each text."""
        size = self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sig, places, out = np.column_stack([batch.column(k).to_numpy() for k in (1, 2)]), batch.column(3), []
                for at, w in hashed(batch.column(0)):
                    joined, begin, end = w.joined()
                    for i in range(len(w.first) - 1):
                        mine = places[at + i].values
                        start, n, copies = (mine.field(k).to_numpy() for k in range(3))
                        word = np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                        digest, k = digests(joined, begin[w.first[i] + word], end[w.first[i] + word + size - 1]), len(word)
                        out.append((digest[:, 0], digest[:, 1], np.full(k, sig[at + i, 0]), np.full(k, sig[at + i, 1]), word.astype(np.int32), np.minimum(np.repeat(copies, n), 2).astype(np.int64)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["h1", "h2", "s1", "s2", "start", "copies"])

        return mapped(texts.select("text", "s1", "s2", "places"), run, "h1 bigint, h2 bigint, s1 bigint, s2 bigint, start int, copies bigint")


def signed(docs: DataFrame, text_col: str, whole: bool = False) -> DataFrame:
    """The rows with the digest of their word sequence, __s1 and __s2, and n_words; columns of the operator's results are
    replaced. With whole also with n_removed (0) and kept_text (all words), the result for a text without repeats."""
    kept = [c for c in docs.columns if c.lower() not in ("n_words", "n_removed", "kept_text")]
    place = kept.index(text_col)
    long = T.LongType()
    more = [T.StructField("n_removed", long), T.StructField("kept_text", T.StringType())] if whole else []
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField("__s1", long), T.StructField("__s2", long), T.StructField("n_words", long), *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, n, texts = np.zeros((batch.num_rows, 2), np.int64), np.zeros(batch.num_rows, np.int64), []
            for at, w in hashed(batch.column(place)):
                joined = w.joined()
                sig[at : at + len(w.counts)], n[at : at + len(w.counts)] = signatures(w, joined), w.counts
                if whole:
                    text, begin, end = joined
                    texts += [text[begin[a] : end[b - 1]] if b > a else b"" for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]
            made = [pa.array(np.zeros(batch.num_rows, np.int64)), pa.array(texts, pa.binary()).cast(pa.string())] if whole else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sig[:, 0].copy()), pa.array(sig[:, 1].copy()), pa.array(n), *made], names=schema.names)

    return mapped(docs.select(*kept), run, schema)


def distinct_texts(docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """(s1, s2, text) of the wanted texts, each once."""
    some, _ = by_bucket(signed(docs.select(F.col(text_col).cast("string").alias("text")), "text"), wanted, "__s1", "s1")
    return some.select("text", F.col("__s1").alias("s1"), F.col("__s2").alias("s2")).dropDuplicates(["s1", "s2"])


def without(docs: DataFrame, repeats: DataFrame, text_col: str = "text", size: int = SIZE) -> DataFrame:
    """The rows with n_words, n_removed and kept_text: the words left, joined by one space. Each word under a repeated window goes."""
    by_text = repeats.groupBy(F.col("s1").alias("__s1"), F.col("s2").alias("__s2")).agg(F.collect_list(F.struct("start", "n")).alias("__places"))
    by_text = saved(by_text, shared_folder(docs.sparkSession), "repeats")
    # texts whose digest falls into no repeat's bucket are done in one pass
    some, _ = by_bucket(signed(docs, text_col), by_text, "__s1", "__s1")
    _, rest = by_bucket(signed(docs, text_col, whole=True), by_text, "__s1", "__s1")
    rows = some.join(by_text, ["__s1", "__s2"], "left")
    kept = [c for c in docs.columns if c.lower() not in ("n_words", "n_removed", "kept_text")]
    place = kept.index(text_col)
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, places, n_removed, out = batch.column(place).cast(pa.binary()), batch.column(batch.num_columns - 1), [], []
            for text, mine in zip(texts, places, strict=True):
                words = (text.as_py() or b"").split()
                gone = 0
                if mine.is_valid:
                    edges = np.zeros(len(words) + 1, np.int64)
                    start, n = (mine.values.field(k).to_numpy() for k in range(2))
                    np.add.at(edges, start, 1)
                    np.add.at(edges, start + n + size - 1, -1)
                    stays = np.cumsum(edges)[:-1] == 0
                    gone = len(words) - int(stays.sum())
                    words = [words[i] for i in np.flatnonzero(stays).tolist()]
                n_removed.append(gone)
                out.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept) + 1], pa.array(n_removed, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())], names=schema.names)

    return mapped(rows.select(*kept, "n_words", "__places"), run, schema).unionByName(rest.select(*schema.names))


def remove_repeats(docs: DataFrame, text_col: str = "text", size: int = SIZE, batches: int = BATCHES, most_runs: int = MOST_RUNS) -> DataFrame:
    """Adds the table to an index batch by batch and removes each word under a window that starts anywhere else too."""
    index = FingerprintIndex(docs.sparkSession, size=size, most_runs=most_runs)
    batch, found = F.pmod(F.xxhash64(F.col(text_col).cast("string")), F.lit(batches)), None
    for k in range(batches):
        places = index.add(docs.filter(batch == k), text_col, docs.filter(batch <= k), text_col)
        found = places if found is None else found.unionByName(places)
    kept = without(docs, found, text_col, size)
    index.drop()  # the places to remove are written apart
    return kept
