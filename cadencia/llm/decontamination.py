"""Benchmark decontamination (method: SimHash of item-sized windows over multi-index Hamming blocks).

Words are lower-cased and split at blanks and ASCII punctuation. For each benchmark item, the windows of a text with as
many words are fingerprinted: 64 sums over the window's 5-word shingles, each counted as often as it occurs. A
fingerprint is cut into radius + 1 blocks, and two fingerprints within the radius agree in a block, so a lookup by block
finds all items within the radius. Those are verified by the exact weighted Jaccard similarity of the shingle counts,
sum of minima over sum of maxima, which must be at least 0.8.

The radius goes by the item's length: it is the least that a window of the least similarity exceeds with at most the
chance MISS, by the exact chance that a bit differs (radius()). Items of up to 4 shingles are only like their equals, so
theirs is 0 and one block of 64 bits; it grows to 20 and 21 blocks of 3 bits, which alone prune little: unrelated
fingerprints share one of those nearly always, and it is the distance within a block's hits that leaves 2 in a thousand.

A window that shares no shingle with any item has similarity 0, so only windows around shared shingles are made; that
drops nothing.

A text shorter than the item is one window. Items of fewer than 5 words are one shingle; items without a word, and null
items, match nothing; null texts match nothing; very long texts are looked at whole, their windows in runs of RUN; an
item id, of any type with an order, with several texts is one item that each of them marks; of windows of equal similarity the
first is given, of items of equal similarity the one with the least id (null last). The benchmark is collected in blocks
of at most `block_items` texts on average, each of which passes over the texts, so that what a task holds is bounded.
Repeated rows are looked at each; extra columns are kept; those named like a result are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped, small_batches
from .wordhash import U, Words, hashed, mix

SIZE, SIMILARITY = 5, 0.8
#: Bits of a fingerprint, the chance that a window of the least similarity is farther than the radius, and the shingles beyond which the radius doesn't change.
BITS, MISS, MANY = 64, 1e-3, 120
BLOCK_ITEMS = 20_000
#: Windows whose sums are made at once.
RUN = 4096
#: ASCII that is neither a letter nor a digit ends a word.
NOT_WORDS = bytes(b for b in range(128) if not chr(b).isalnum())
RESULTS = ("n_items", "item_ids", "best_item", "best_similarity", "matches")


def sums_of_bits(shingles: np.ndarray) -> np.ndarray:
    """Running sums, from 0, of the bits of the shingles as -1 and 1."""
    bits = (shingles[:, None] >> np.arange(BITS, dtype=U)) & U(1)
    out = np.zeros((len(shingles) + 1, BITS), np.int32)
    np.cumsum(bits.astype(np.int32) * 2 - 1, axis=0, out=out[1:])
    return out


def packed_bits(sums: np.ndarray) -> np.ndarray:
    return ((sums > 0).astype(U) << np.arange(BITS, dtype=U)).sum(axis=1, dtype=U)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets."""
    values, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.bincount(back[: len(a)], minlength=len(values)), np.bincount(back[len(a) :], minlength=len(values))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


@lru_cache(4096)
def walk(n: int) -> np.ndarray:
    """The chances that n signs add up to -n, -n + 2, ... n."""
    return np.array([math.comb(n, k) / 2**n for k in range(n + 1)])


def differs(a: int, b: int, common: int) -> float:
    """The chance that a bit differs between the fingerprints of a and of b shingles that have so many in common."""

    def up(n: int) -> np.ndarray:
        """The chance that the sum is above 0 with n - common signs more, by the common ones' sum."""
        own = n - common
        above = np.append(np.cumsum(walk(own)[::-1])[::-1], 0.0)  # at least k of the own signs are up
        least = (own + common - 2 * np.arange(common + 1)) // 2 + 1  # so many must be, for the common ones' sum
        return above[np.clip(least, 0, own + 1)]

    one, other = up(a), up(b)
    return float((walk(common) * (one * (1 - other) + other * (1 - one))).sum())


@lru_cache(4096)
def radius(n: int, least: float = SIMILARITY, miss: float = MISS) -> int:
    """The distance that a window whose similarity with an item of n shingles is least or more exceeds with at most that chance."""
    n = min(n, MANY)
    sizes = [(m, math.ceil(least * (m + n) / (1 + least) - 1e-9)) for m in range(max(1, math.ceil(least * n - 1e-9)), n + 1)]
    p = max(differs(n, m, c) for m, c in sizes if c <= m)
    chance, r = (1 - p) ** BITS, 0
    while 1 - chance > miss:
        r += 1
        chance += math.comb(BITS, r) * p**r * (1 - p) ** (BITS - r)
    return r


def block_cuts(radius: int) -> np.ndarray:
    """Where radius + 1 blocks of the fingerprint begin and end."""
    return np.linspace(0, BITS, radius + 2).astype(int)


class Items:
    """Items of one length: their shingles, fingerprints and an index for each block."""

    def __init__(self, ids: list, shingles: list[np.ndarray], least: float, miss: float) -> None:
        self.ids, self.shingles = ids, shingles
        # repeated shingles weigh more, as fewer ones would: the largest radius then
        repeated = any(len(np.unique(x)) < len(x) for x in shingles)
        self.radius = max(radius(n, least, miss) for n in ([*range(1, 12)] if repeated else []) + [len(shingles[0])])
        self.prints = np.array([packed_bits(sums_of_bits(s)[-1:])[0] for s in shingles], U)
        self.index = []
        cuts = block_cuts(self.radius)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            value = self._block(self.prints, a, b)
            order = np.argsort(value, kind="stable")
            self.index.append((a, b, order, value[order]))

    @staticmethod
    def _block(prints: np.ndarray, a: int, b: int) -> np.ndarray:
        return (prints >> U(a)) & U((1 << (b - a)) - 1)

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(print, item) pairs within the radius, all of them."""
        pairs = []
        for a, b, order, values in self.index:
            value = self._block(prints, a, b)
            begin = np.searchsorted(values, value)
            n = np.searchsorted(values, value, "right") - begin
            item = order[np.repeat(begin - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
            pairs.append(np.repeat(np.arange(len(prints)), n) * len(self.ids) + item)
        pairs = np.unique(np.concatenate(pairs))
        at, item = pairs // len(self.ids), pairs % len(self.ids)
        near = np.bitwise_count(prints[at] ^ self.prints[item]) <= self.radius
        return at[near], item[near]


class Benchmark:
    """A block of items, by number of words."""

    def __init__(self, ids: list, texts: list[str | None], size: int, least: float, miss: float) -> None:
        groups: dict[int, tuple[list, list]] = {}
        for at, w in hashed(pa.array(texts, pa.string()), lower=True, extra=NOT_WORDS):
            for i, n in enumerate(w.counts.tolist()):
                if n:
                    k = min(size, n)
                    some = groups.setdefault(n, ([], []))
                    some[0].append(ids[at + i])
                    some[1].append(w.windows(k)[0][w.first[i] : w.first[i] + n - k + 1])
        self.items = {n: Items(*x, least, miss) for n, x in sorted(groups.items())}
        # by shingle size: sorted hashes and for each the lengths of the items that have it
        self.lengths: dict[int, tuple[np.ndarray, list[list[int]]]] = {}
        for k in {min(size, n) for n in groups}:
            found: dict[int, set[int]] = {}
            for n, (_, shingles) in groups.items():
                if min(size, n) == k:
                    for h in np.unique(np.concatenate(shingles)).tolist():
                        found.setdefault(h, set()).add(n)
            order = sorted(found)
            self.lengths[k] = np.array(order, U), [sorted(found[h]) for h in order]
        self.size = size

    def matches(self, w: Words, least: float) -> Iterator[tuple]:
        """(text, item, first word, words, similarity) of the best window of each item in each text."""
        text_of = w.text_of()
        windows: dict[int, set[int]] = {}
        for k, (keys, lengths) in self.lengths.items():
            h, whole = w.windows(k)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            for p in np.flatnonzero((keys[at] == h) & whole).tolist():
                a, b = w.first[text_of[p]], w.first[text_of[p] + 1]
                for n in lengths[at[p]]:
                    # all starts of windows of n words that hold this shingle, or the whole of a shorter text
                    windows.setdefault(n, set()).update(range(max(a, p - n + k), max(a + 1, min(p, b - n) + 1)))
        best: dict[tuple, tuple[float, int, int]] = {}
        for n, starts in windows.items():
            items, k = self.items[n], min(self.size, n)
            h = w.windows(k)[0]
            start = np.array(sorted(starts))
            end = np.minimum(start + n - k + 1, np.maximum(w.first[text_of[start] + 1] - k + 1, start + 1))
            # sums over the runs of shingles in use
            prints = np.zeros(len(start), U)
            cut = np.flatnonzero(np.append(True, start[1:] > np.maximum.accumulate(end)[:-1]))
            cut = np.unique(np.concatenate([cut, np.arange(0, len(start), RUN)]))
            for a, b in zip(cut.tolist(), np.append(cut[1:], len(start)).tolist(), strict=True):
                low, high = start[a], end[a:b].max()
                sums = sums_of_bits(h[low:high])
                prints[a:b] = packed_bits(sums[end[a:b] - low] - sums[start[a:b] - low])
            for i, j in zip(*(x.tolist() for x in items.within(prints)), strict=True):
                sim = similarity(h[start[i] : end[i]], items.shingles[j])
                key = (int(text_of[start[i]]), items.ids[j])
                if sim >= least - 1e-12 and sim > best.get(key, (0, 0, 0))[0] + 1e-12:
                    best[key] = (sim, int(start[i] - w.first[key[0]]), int(min(n, w.first[key[0] + 1] - start[i])))
        for (text, item), (sim, start, n) in best.items():
            yield text, item, start, n, sim


def _one_block(docs: DataFrame, items: DataFrame, text_col: str, size: int, least: float, miss: float) -> DataFrame:
    rows = items.toArrow()
    ids, texts = rows.column(0).to_pylist(), rows.column(1).to_pylist()
    place = docs.columns.index(text_col)
    kind = T.ArrayType(T.StructType([T.StructField("item_id", items.schema[0].dataType), T.StructField("start", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("similarity", T.DoubleType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField("matches", kind)])
    arrow = pa.list_(pa.struct([("item_id", rows.schema.field(0).type), ("start", pa.int32()), ("n", pa.int32()), ("similarity", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = Benchmark(ids, texts, size, least, miss)
        for batch in batches:
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for at, w in hashed(batch.column(place), lower=True, extra=NOT_WORDS):
                if len(w.hash) and bench.items:
                    for text, item, start, n, sim in bench.matches(w, least):
                        found[at + text].append({"item_id": item, "start": start, "n": n, "similarity": sim})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, arrow)], names=schema.names)

    return mapped(docs, run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = SIZE, least: float = SIMILARITY, miss: float = MISS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows with matches (item_id, start, n, similarity of each item's best window, in words), n_items, item_ids, best_item and best_similarity."""
    small_batches(docs.sparkSession)
    items = benchmark.filter(F.col(item_text).isNotNull()).select(F.col(item_col).alias("id"), F.col(item_text).cast("string").alias("text")).distinct()
    blocks = max(1, -(-items.count() // block_items))
    kept = [c for c in docs.columns if c.lower() not in RESULTS]
    out = docs.select(*kept)
    for k in range(blocks):
        out = _one_block(out.withColumnRenamed("matches", "__before") if k else out, items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k), text_col, size, least, miss)
        if k:
            out = out.withColumn("matches", F.concat("__before", "matches")).drop("__before")
    last = lambda x: F.coalesce(x.isNull(), F.lit(False))
    # best first, then by id, null last, then by place
    order = lambda a, b: (
        F.when(a.similarity > b.similarity, -1).when(a.similarity < b.similarity, 1).when(last(a.item_id) & ~last(b.item_id), 1).when(last(b.item_id) & ~last(a.item_id), -1)
        .when(a.item_id < b.item_id, -1).when(a.item_id > b.item_id, 1).when(a.start < b.start, -1).when(a.start > b.start, 1).otherwise(0)
    )
    out = out.withColumn("matches", F.array_sort("matches", order))
    if blocks > 1:  # texts of one id may be in several blocks
        out = out.withColumn("__ids", F.transform("matches", lambda m: m.item_id))
        first = lambda m, i: F.forall(F.slice("__ids", 1, i), lambda x: ~x.eqNullSafe(m.item_id))
        out = out.withColumn("matches", F.filter("matches", first)).drop("__ids")
    return out.select(*kept, F.size("matches").cast("bigint").alias("n_items"), F.array_sort(F.transform("matches", lambda m: m.item_id)).alias("item_ids"), F.get("matches", F.lit(0)).item_id.alias("best_item"), F.get("matches", F.lit(0)).similarity.alias("best_similarity"), "matches")
