"""N-gram Jaccard join (method: a prefix-tree join).

A document's set has its distinct n-word shingles. Documents with equal sets form a class with one representative. Sets
are told apart by a 64-bit hash; a second one, independent of it, is compared for all of a class, and where it differs
the sets are hashed anew with another key, so that classes rest on 128 bits.

Pruning: of the sets' shingles with the lowest hashes (a fixed share of the hash range) it is counted how many another set
has too. A set can miss at most (1-t) of its shingles in a set that it links with, so one with more unshared ones among
these links with none and goes. That needs no pairs, and leaves out documents that only share a passage.

Candidates: two sets with similarity t have at most (1-t)/(1+t) * (|x|+|y|) shingles that only one of them has. With the
shingles dealt by hash into more buckets than that, some bucket has the same content in both. So each distinct set
gives a key for each bucket, for its own size class and the next (sizes of similar sets differ by less than 1/t, one
class), and sets that are linked share a key: nothing is lost. Sets that share a key, directly or through others, form a
cell.

Verification in a cell: shingles that only one set has can't be shared, and a set with too few others goes at once; the
rest are put, by falling frequency (one order for all sets of the trie, ties by hash), into a trie whose
nodes hold runs of shingles. Each set walks the trie level by level: the overlap of a node is that of its parent plus
its own, so common beginnings are counted once, and a subtree is left when even all that remains of both sets can't
reach the threshold. Tasks return a spanning forest of the links they find.

A large cell is dealt into blocks, within size classes, as sets whose classes differ by more than one can't link; each
pair of blocks of a class, or of two neighbouring ones, is a group of its own. A block holds at most about `most_shingles`
shingles, which bounds a group's memory whatever the sets' sizes, and else enough sets for about COPIES blocks
of a class, which bounds how often a set is copied until the memory bound is reached.

Null texts and texts without words have an empty set and link with nothing; very long texts are sets like others, alone
in their block if need be; repeated rows and copies are of one class; ties don't arise, as a component has the least id;
an empty table gives no rows; extra columns are ignored, also those named like a result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bucket, mapped, removed, saved, shared_folder, small_batches, trimmed
from .components import components
from .wordhash import U, Words, hashed, mix

SIZE = 4
#: Similarity as a fraction: 85 / 100.
SHARE, OF = 85, 100
#: Shingles of a block of a large cell, at most about; sets of a block at least, if they fit; and blocks of a class that are aimed at.
MOST_SHINGLES, LEAST_SETS, COPIES = 1 << 20, 128, 32
#: Shingles whose hash is below this share of the range are counted for pruning.
LOW = 0.3
#: Shingles of a trie's node.
NODE = 16


def shingle_sets(w: Words, size: int = SIZE) -> Iterator[np.ndarray]:
    """The sorted hashes of the distinct shingles of each text; a shorter text has its whole sequence as one."""
    hashes, whole = w.windows(size)
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(hashes[a : b - size + 1])
        elif b > a:
            yield mix(mix(w.hash[a:b] + np.arange(b - a, dtype=U) * U(0x9E3779B97F4A7C15)).sum(keepdims=True) + U(b - a))
        else:
            yield np.zeros(0, U)


def signature(s: np.ndarray, key: int) -> int:
    return int(mix(mix(s ^ mix(np.array([key], U))).sum(keepdims=True) + U(len(s)))[0].view(np.int64)) if len(s) else 0


def size_class(n: int, share: int = SHARE, of: int = OF) -> int:
    return math.floor(math.log(n) / math.log(of / share) + 1e-9)


def most_different(k: int, share: int = SHARE, of: int = OF) -> int:
    """The most shingles in which two linked sets can differ, the larger of class k."""
    return math.floor(2 * (of / share) ** (k + 1) * (1 + 1e-6) * (of - share) / (of + share))


def keys(s: np.ndarray, share: int = SHARE, of: int = OF) -> np.ndarray:
    """A key for the content of each bucket in use, for the size class of the set and the next.

    Each differing shingle spoils one bucket, so a set with more buckets in use than that has one that is equal in any
    linked set. A set that has too few (the buckets hold 5 shingles on average) gives its first shingles as keys besides,
    so many that two linked sets must share one: if one of two sets has enough buckets they share a bucket, else those."""
    out, enough = [], True
    for k in (size_class(len(s), share, of), size_class(len(s), share, of) + 1):
        most = most_different(k, share, of)
        n = most + 3 + most // 32
        bucket = ((s >> U(32)) * U(n)) >> U(32)
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        enough &= len(first) > most
        total = np.add.reduceat(mix(s), first)
        out.append(mix(mix(total + bucket[first] * U(0x9E3779B97F4A7C15)) + U(k)))
    if not enough:
        out.append(mix(s[: len(s) - -(-share * len(s) // of) + 1] + U(0x5851F42D4C957F2D)))
    return np.concatenate(out)


def low_part(s: np.ndarray) -> np.ndarray:
    return s[: np.searchsorted(s, U(int(LOW * 2**64)))]


def sets_of(docs: DataFrame, text_col: str, size: int, key: int) -> DataFrame:
    """The rows with n_shingles, n_low (those with low hashes) and sig and sig2 (0 for an empty set), two hashes of the set."""
    columns, place = docs.columns, docs.columns.index(text_col)
    long = T.LongType()
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, long) for c in ("n_shingles", "n_low", "sig", "sig2"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = ((len(s), len(low_part(s)), signature(s, 2 * key), signature(s, 2 * key + 1)) for _, w in hashed(batch.column(place), lower=True) for s in shingle_sets(w, size))
            found = np.array(list(sets), np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(found[:, k].copy()) for k in range(4))], names=[*columns, "n_shingles", "n_low", "sig", "sig2"])

    return mapped(docs, run, schema)


def low_rows(texts: DataFrame, size: int, key: int) -> DataFrame:
    """(shingle, sig, credit) of the low shingles. A shingle of several sets of a batch is settled for them at once: it leaves one row without credit, and the sets a row with their number of settled shingles, negative, under a shingle of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            low, sig = [np.zeros(0, U)], [np.zeros(0, np.int64)]
            for _, w in hashed(batch.column(0), lower=True):
                for s in shingle_sets(w, size):
                    own = signature(s, 2 * key)
                    if len(s) and own not in seen:
                        seen.add(own)
                        low.append(low_part(s))
                        sig.append(np.full(len(low[-1]), own))
            if len(seen) > 1 << 19:
                seen.clear()
            low, sig = np.concatenate(low), np.concatenate(sig)
            _, first, which, count = np.unique(low, return_index=True, return_inverse=True, return_counts=True)
            settled = count[which] > 1
            some, n = np.unique(sig[settled], return_counts=True)
            once = np.sort(first)  # a row for each shingle, in order of the sets
            out = np.concatenate([low[once], mix(some.view(U) + U(0x2545F4914F6CDD1D))])
            credit = np.concatenate([np.where(settled[once], 0, 1), -n]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64)), pa.array(np.concatenate([sig[once], some])), pa.array(credit)], names=["shingle", "sig", "credit"])

    return mapped(texts, run, "shingle bigint, sig bigint, credit int")


def credits_of(rows: DataFrame) -> DataFrame:
    """(sig, n): how many low shingles of each set another set has. The rows of a shingle are read as a sorted stream."""

    def settle(k: np.ndarray, s: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
        shared = np.zeros(0, bool)
        if len(k):
            several = np.minimum.reduceat(s, first) != np.maximum.reduceat(s, first)
            shared = np.repeat(several, np.diff(np.append(first, len(k))))
        got = np.where(c < 0, -c, np.where(shared, c, 0))
        sig, back = np.unique(s[got > 0], return_inverse=True)
        n = np.bincount(back, got[got > 0], len(sig)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(n)], names=["sig", "n"])

    def columns(some: list[pa.RecordBatch]) -> list[np.ndarray]:
        return [np.concatenate([np.zeros(0, kind), *(b.column(i).to_numpy() for b in some)]) for i, kind in enumerate((np.int64, np.int64, np.int32))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < 1 << 17:
                continue
            k, s, c = columns(held)
            last = int(np.searchsorted(k, k[-1]))  # the last shingle may go on
            yield settle(k[:last], s[:last], c[:last])
            held = [pa.Table.from_batches(held).combine_chunks().slice(last).to_batches()[0]]
        yield settle(*columns(held))

    return mapped(rows.repartition("shingle").sortWithinPartitions("shingle"), run, "sig bigint, n bigint").groupBy("sig").agg(F.sum("n").alias("n"))


def key_rows(texts: DataFrame, size: int, share: int, of: int, seed: int) -> DataFrame:
    """(key, sig) of all sets. Within a batch, sets that share a key are tied to the first of them by a key of their own, each once, so that a hot key has a row for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            key, sig = [np.zeros(0, U)], [np.zeros(0, np.int64)]
            for _, w in hashed(batch.column(0), lower=True):
                for s in shingle_sets(w, size):
                    own = signature(s, 2 * seed)
                    if len(s) and own not in seen:
                        seen.add(own)
                        key.append(keys(s, share, of))
                        sig.append(np.full(len(key[-1]), own))
            if len(seen) > 1 << 19:
                seen.clear()
            key, sig = np.concatenate(key), np.concatenate(sig)
            _, first, which = np.unique(key, return_index=True, return_inverse=True)
            head = sig[first][which]
            tied = np.unique(np.column_stack([head, sig])[head != sig], axis=0)
            heads = np.unique(tied[:, 0])
            once = np.sort(first)
            own = lambda x: mix(x.view(U) + U(0x2545F4914F6CDD1D))
            out_key = np.concatenate([key[once], own(tied[:, 0].copy()), own(heads.copy())])
            yield pa.RecordBatch.from_arrays([pa.array(out_key.view(np.int64)), pa.array(np.concatenate([sig[once], tied[:, 1], heads]))], names=["key", "sig"])

    return mapped(texts, run, "key bigint, sig bigint")


def edges_of(rows: DataFrame) -> DataFrame:
    """(a, b): each set with the least that shares a key with it; the rows of a key are read as a sorted stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, head = None, None
        for batch in batches:
            k, s = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(k):
                continue
            new = np.append(key is None or k[0] != key, k[1:] != k[:-1])
            start = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
            first = np.where(start >= 0, s[np.maximum(start, 0)], 0 if head is None else head)
            key, head = k[-1], first[-1]
            pairs = np.unique(np.column_stack([s, first])[s != first], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    return mapped(rows.repartition("key").sortWithinPartitions("key", "sig"), run, "a bigint, b bigint")


class Trie:
    """Sets of ranked shingles as paths; a node holds NODE of them, and the best that a set below it can still reach."""

    def __init__(self, ranks: list[np.ndarray], sizes: np.ndarray, slack: np.ndarray) -> None:
        self.levels, n = [], len(ranks)
        length = np.array([len(r) for r in ranks])
        depth = np.maximum(1, -(-length // NODE))
        padded = np.full((n, int(depth.max()) * NODE), -1, np.int64)
        for i, r in enumerate(ranks):
            padded[i, : len(r)] = r
        node, alive = np.zeros(n, np.int64), np.arange(n)
        for level in range(int(depth.max())):
            part = padded[alive, level * NODE : (level + 1) * NODE]
            paths, back = np.unique(np.column_stack([node[alive], part]), axis=0, return_inverse=True)
            back = back.reshape(-1)
            best = np.full(len(paths), -np.inf)
            np.maximum.at(best, back, slack[alive])
            ends = depth[alive] == level + 1
            order = np.argsort(back[ends], kind="stable")
            children = np.searchsorted(paths[:, 0], np.arange((len(self.levels[-1][0]) if self.levels else 1) + 1))
            # (shingles, bound, sets that end here by node, their ranges, children of the level above)
            self.levels.append((paths[:, 1:], best, alive[ends][order], np.searchsorted(back[ends][order], np.arange(len(paths) + 1)), children))
            node[alive] = back
            alive = alive[~ends]

    def walk(self, marks: np.ndarray, need: float) -> tuple[np.ndarray, np.ndarray]:
        """(sets, overlaps) of all paths that are not left. need: what overlap less depth plus slack must reach."""
        found, overlaps = [], []
        nodes, overlap = np.zeros(1, np.int64), np.zeros(1, np.int64)
        for level, (shingles, best, ends, ranges, children) in enumerate(self.levels):
            begin, count = children[nodes], children[nodes + 1] - children[nodes]
            total = int(count.sum())
            if not total:
                break
            nodes, overlap = np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(total), np.repeat(overlap, count)
            bound = overlap - level * NODE + best[nodes] >= need
            nodes, overlap = nodes[bound], overlap[bound]
            part = shingles[nodes]
            overlap = overlap + marks[part].sum(axis=1)
            bound = overlap - (level + 1) * NODE + np.maximum(best[nodes], 0) + NODE >= need
            bound &= overlap - np.minimum((level + 1) * NODE, level * NODE + (part >= 0).sum(axis=1)) + best[nodes] >= need
            nodes, overlap = nodes[bound], overlap[bound]
            n = ranges[nodes + 1] - ranges[nodes]
            if n.any():
                found.append(ends[np.repeat(ranges[nodes] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())])
                overlaps.append(np.repeat(overlap, n))
        return (np.concatenate(found), np.concatenate(overlaps)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def links(sets: list[np.ndarray], probes: np.ndarray, share: int = SHARE, of: int = OF) -> Iterator[tuple[int, np.ndarray]]:
    """(set, the other sets that it links with) for each probe with a link."""
    size = np.array([len(s) for s in sets])
    alive = np.arange(len(sets))
    while True:  # a shingle of one set alone can't be shared; a set with too few others links with none
        owner = np.repeat(alive, size[alive])
        values = np.concatenate([sets[i] for i in alive]) if len(alive) else np.zeros(0, U)
        _, rank, count = np.unique(values, return_inverse=True, return_counts=True)
        shared = count[rank] > 1
        left = np.bincount(owner[shared], minlength=len(sets))
        keep = left[alive] * of >= share * size[alive]
        if keep.all():
            break
        alive = alive[keep]
    if len(alive) < 2:
        return
    order = np.empty(len(count), np.int64)
    order[np.argsort(-count, kind="stable")] = np.arange(len(count))
    rank, owner = order[rank][shared], owner[shared]
    by = np.lexsort((rank, owner))
    rank, starts = rank[by], np.searchsorted(owner[by], np.append(alive, len(sets)))
    ranks = [rank[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
    ratio = share / (share + of)
    trie = Trie(ranks, size[alive], left[alive] - ratio * size[alive])
    marks = np.zeros(len(count) + 1, np.int64)  # the last is for the padding, -1
    for k in np.flatnonzero(probes[alive]).tolist():
        marks[ranks[k]] = 1
        other, overlap = trie.walk(marks, ratio * size[alive[k]] - 1e-6)
        marks[ranks[k]] = 0
        hit = (overlap * (of + share) >= share * (size[alive[k]] + size[alive[other]])) & (other != k)
        if hit.any():
            yield int(alive[k]), alive[other[hit]]


def join_cells(rows: DataFrame, share: int, of: int) -> DataFrame:
    """(sig, other, n_links): for each set of a group with a link, one that it links with or reaches, and the documents that it links with."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        upper, copies, sig = (group.column(c).to_numpy() for c in ("upper", "copies", "sig"))
        two = key[1].as_py() != key[2].as_py()
        sets = [np.frombuffer(x.as_py(), U) for x in group.column("shingles")]
        root, n = np.arange(len(sets)), np.zeros(len(sets), np.int64)

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x, others in links(sets, ~upper, share, of):
            if two:  # links within a block are found where the block meets itself
                others = others[upper[others]]
                np.add.at(n, others, copies[x])
            n[x] += copies[others].sum()
            for y in others.tolist():
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
        some = np.flatnonzero(n)
        other = np.array([find(int(x)) for x in some], np.int64)
        if len(sets) > 200:
            trimmed()
        return pa.table({"sig": sig[some], "other": sig[other], "n_links": n[some]})

    return rows.groupBy("cell", "low", "high").applyInArrow(run, "sig bigint, other bigint, n_links bigint")


def dealt(placed: DataFrame, folder: str, share: int, of: int, most_shingles: int, least_sets: int) -> DataFrame:
    """(sig, copies, cell, low, high, upper) from (sig, copies, cell, n_shingles): a row for each group that a set is in.
    low and high are blocks; equal, all sets of one meet; else those of low meet those of high, whose rows have upper."""
    kind = F.floor(F.log("n_shingles") / F.log(F.lit(of / share)) + 1e-9).cast("int")
    classes = placed.groupBy("cell", kind.alias("class")).agg(F.count("*").alias("sets"), F.sum("n_shingles").alias("total"))
    whole = classes.groupBy("cell").agg(F.sum("sets").alias("all_sets"), F.sum("total").alias("all_total"))
    small = (F.col("all_sets") <= least_sets) & (F.col("all_total") <= most_shingles)
    blocks = F.ceil(F.greatest(F.col("total") / most_shingles, F.least(F.col("sets") / least_sets, F.lit(COPIES)))).cast("int")
    classes = classes.join(whole, "cell").select("cell", F.when(small, -1).otherwise(F.col("class")).alias("class"), F.when(small, 1).otherwise(blocks).alias("blocks")).distinct()
    classes = saved(classes, folder, "classes")
    next_up = classes.select("cell", (F.col("class") - 1).alias("class"), F.col("blocks").alias("blocks_up"))
    next_down = classes.select("cell", (F.col("class") + 1).alias("class"), F.col("blocks").alias("blocks_down"))
    plan = classes.join(next_up, ["cell", "class"], "left").join(next_down, ["cell", "class"], "left")
    plan = saved(plan, folder, "plan")
    sizes = plan.filter("class >= 0").select("cell").distinct().withColumn("large", F.lit(True))
    rows = placed.join(sizes, "cell", "left").withColumn("class", F.when(F.col("large"), kind).otherwise(-1)).join(plan, ["cell", "class"])
    block = F.pmod(F.xxhash64("sig"), "blocks").cast("int")
    name = lambda c, b: F.concat_ws("-", c, b)
    up_to = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    row = lambda low, high, upper: F.struct(low.alias("low"), high.alias("high"), upper.alias("upper"))
    own = name(F.col("class"), F.col("block"))
    same = F.transform(up_to(F.col("blocks")), lambda o: row(name(F.col("class"), F.least("block", o)), name(F.col("class"), F.greatest("block", o)), F.col("block") > o))
    up = F.transform(up_to(F.coalesce("blocks_up", F.lit(0))), lambda o: row(own, name(F.col("class") + 1, o), F.lit(False)))
    down = F.transform(up_to(F.coalesce("blocks_down", F.lit(0))), lambda o: row(name(F.col("class") - 1, o), own, F.lit(True)))
    rows = rows.withColumn("block", block).withColumn("at", F.explode(F.concat(same, up, down)))
    return rows.select("sig", "copies", "cell", "at.low", "at.high", "at.upper")


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, share: int = SHARE, of: int = OF, most_shingles: int = MOST_SHINGLES, least_sets: int = LEAST_SETS) -> DataFrame:
    """id, n_shingles, component_id (the least id reachable by links; the row's own without links) and n_links."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = shared_folder(spark)
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    key = 0
    while True:
        rows = sets_of(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), "text", size, key)
        rows = saved(rows.select("id", "n_shingles", "n_low", "sig", "sig2"), folder, f"sets-{key}")
        classes = rows.filter("n_shingles > 0").groupBy("sig").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("n_low").alias("n_low"), F.min("sig2").alias("a"), F.max("sig2").alias("b"))
        classes = saved(classes, folder, f"classes-{key}")
        if classes.filter("a <> b").isEmpty():
            break
        key += 1
    unshared = F.col("n_low") - F.coalesce("n", F.lit(0))
    left = classes.join(credits_of(low_rows(texts, size, key)), "sig", "left").filter(unshared * of <= F.col("n_shingles") * (of - share)).select("sig")
    left = saved(left, folder, "left")
    cells = components(edges_of(key_rows(by_bucket(sets_of(texts, "text", size, key), left, "sig")[0].select("text"), size, share, of, key)), folder, "cells")
    placed = cells.join(classes, cells["node"] == classes["sig"]).select("sig", "copies", "n_shingles", F.col("component").alias("cell"))
    placed = saved(placed, folder, "placed")
    groups = saved(dealt(placed, folder, share, of, most_shingles, least_sets), folder, "groups")
    found = saved(join_cells(groups.join(members(texts, placed, size, key), "sig"), share, of), folder, "links")
    for name in ("left", "placed", "groups", "classes", "plan"):
        removed(spark, f"{folder}/{name}")
    linked = components(found.select(F.col("sig").alias("a"), F.col("other").alias("b")), folder, "linked")
    totals = found.groupBy("sig").agg(F.sum("n_links").alias("n"))
    of_class = classes.select("sig", "least", "copies").join(linked.withColumnRenamed("node", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    least = of_class.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = of_class.join(least, "component").join(totals, "sig", "left").select("sig", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return rows.join(of_class, "sig", "left").select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def members(texts: DataFrame, placed: DataFrame, size: int, key: int) -> DataFrame:
    """(sig, shingles): the sets of the cells, each once. Only texts whose bucket holds one of them are shuffled."""
    near, _ = by_bucket(sets_of(texts, "text", size, key).filter("n_shingles > 0"), placed, "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for _, w in hashed(batch.column(0), lower=True) for s in shingle_sets(w, size)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(sets, pa.binary())], names=["sig", "shingles"])

    return mapped(near.select("text", "sig").join(placed.select("sig"), "sig", "left_semi").dropDuplicates(["sig"]).select("text", "sig"), run, "sig bigint, shingles binary")
