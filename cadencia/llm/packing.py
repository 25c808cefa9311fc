"""Packing (method: best-fit decreasing over a segment tree of remaining capacities).

A document is its token ids and an end id. Overlong documents are first cut into full windows, each a sequence of its
own; the rests go, longest first, into the open sequence with the least capacity that still holds them. Each task packs
its own documents, so nothing is shuffled and no task sees more than its share, and about one sequence of a task stays
partly empty. The texts' bytes are counted first, and input partitions are put together, without a shuffle, into at most
one task for each LEAST_BYTES of text, which is some 500 sequences: however the input is partitioned, less than 1 % of the
space is padding in a table of that size or more. A sequence's id holds the task's number in its high bits.

Nulls count as empty texts (one piece, the end id alone); very long texts are cut into windows, whole; documents with
rests of one length are packed in the order of the input; repeated rows are packed each; an empty table gives no rows;
extra columns are ignored, also those named like a result.
"""

from __future__ import annotations

import os
import sys
import tempfile
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordCache, mapped, small_batches
from .token_counts import batches_by_bytes, tokenizer_path
from .wordhash import hashed

MODEL = "word_bpe_49k.json"
WINDOW = 2048
END_ID = 1
#: Sequences of one partition are numbered below this.
PER_PARTITION = 1 << 40
#: Bytes of text for each task, at least, if there are so many.
LEAST_BYTES = 4 << 20
#: Bytes of a task's ids that wait in memory, and ids of a batch that is given out, about.
SPOOL_BYTES, OUT_IDS = 32 << 20, 1 << 20


class CapacityTree:
    """Open sequences by remaining capacity: a segment tree whose nodes say whether any capacity below them is in use."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.any = bytearray(2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, sequence: int) -> None:
        self.open[capacity].append(sequence)
        k = capacity + self.size
        while k and not self.any[k]:
            self.any[k] = 1
            k >>= 1

    def tightest(self, length: int) -> int | None:
        """The least capacity in use that is at least length."""
        k = length + self.size
        if not self.any[k]:
            while k > 1 and (k & 1 or not self.any[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.size:
                k = 2 * k if self.any[2 * k] else 2 * k + 1
        return k - self.size

    def take(self, capacity: int) -> int:
        sequence = self.open[capacity].pop()
        if not self.open[capacity]:
            k = capacity + self.size
            self.any[k] = 0
            k >>= 1
            while k and not (self.any[2 * k] or self.any[2 * k + 1]):
                self.any[k] = 0
                k >>= 1
        return sequence


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length, none of which exceeds the window."""
    tree, n = CapacityTree(window), 0
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        capacity = tree.tightest(length)
        if capacity is None:
            capacity, sequence[i] = window, n
            n += 1
        else:
            sequence[i] = tree.take(capacity)
        offset[i] = window - capacity
        if capacity > length:
            tree.add(capacity - length, sequence[i])
    return sequence, offset


class Encoder:
    """Token ids of whole texts. Where the pre-tokenizer drops white space and joins nothing across it, words are
    encoded apart, each distinct one once while it is cached. New words go to the tokenizer many at a time, with a
    control character between them that is a token of its own. With any other tokenizer, whole texts are encoded."""

    BETWEEN = "\x01"
    #: Strings that are tried in pairs with each kind of blank between them, to find out whether the tokenizer is such.
    PROBES = ("a", "The", "don't", "'s", "7", "42", "...", "#", "é", "e\u0301", "\u0301", "ﬁ", "漢字", "😀", "<|endoftext|>", "\x00")
    BLANKS = (" ", "  ", "\n", "\t ", "\r\n", "\x0b", "\x0c")

    def __init__(self, path: str, most: int = 1 << 19) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs as many tasks as there are cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        between = self._each([self.BETWEEN])[0]
        self.between = between[0] if len(between) == 1 else None
        self.ids, self.n = np.zeros(1 << 16, np.uint32), 0
        self.cache = WordCache(self._encode, most, self._kept)
        self.by_word = self.between is not None and self.splits_at_blanks()

    def _each(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def splits_at_blanks(self) -> bool:
        """Whether the ids of words apart are those of the words with blanks, or the mark, between them."""
        alone = dict(zip(self.PROBES, self._each(list(self.PROBES)), strict=True))
        pairs = [(a, b) for a in self.PROBES for b in self.PROBES]
        apart = [alone[a] + alone[b] for a, b in pairs]
        marked = [[*alone[a], self.between, *alone[b]] for a, b in pairs]
        return all(self._each([blank + a + blank + b + blank for a, b in pairs]) == apart for blank in self.BLANKS) and self._each([f"{a} {self.BETWEEN} {b}" for a, b in pairs]) == marked

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and the number of each word's."""
        texts = [f" {self.BETWEEN} ".join(words[k : k + 128]) + f" {self.BETWEEN}" for k in range(0, len(words), 128)]
        ids = np.array([i for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids], np.uint32)
        ends = np.flatnonzero(ids == self.between)
        if len(ends) == len(words) and not any(self.BETWEEN in w for w in words):
            return ids[ids != self.between], np.diff(ends, prepend=-1) - 1
        each = self._each(words)
        return np.array([i for x in each for i in x], np.uint32), np.array([len(x) for x in each], np.int64)

    def _encode(self, words: list[str]) -> np.ndarray:
        """(place, length) of each word's ids in self.ids."""
        out = [np.zeros((0, 2), np.int32)]
        for some in batches_by_bytes(words):
            ids, length = self._ids(some)
            while self.n + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[self.n : self.n + len(ids)] = ids
            out.append(np.column_stack([self.n + np.cumsum(length) - length, length]).astype(np.int32))
            self.n += len(ids)
        return np.concatenate(out)

    def _kept(self, rows: np.ndarray) -> np.ndarray:
        """Leaves the ids of these words alone, and gives the words' places among them."""
        begin, length = rows[:, 0].astype(np.int64), rows[:, 1].astype(np.int64)
        ends = np.cumsum(length)
        self.n = int(ends[-1]) if len(rows) else 0
        ids = self.ids[np.repeat(begin - (ends - length), length) + np.arange(self.n)]
        self.ids = np.append(ids, np.zeros(max(1 << 16, self.n // 2), np.uint32))
        return np.column_stack([ends - length, length]).astype(np.int32)

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text."""
        if not self.by_word:
            for some in batches_by_bytes(texts.fill_null("").to_pylist()):
                yield from (np.array(ids, np.uint32) for ids in self._each(some))
            return
        for _, w in hashed(texts):
            place = self.cache(w) if len(w.hash) else np.zeros((0, 2), np.int64)
            length = place[:, 1]
            ends = np.concatenate([[0], np.cumsum(length)])
            at = np.repeat(place[:, 0] - ends[:-1], length) + np.arange(ends[-1])
            ids = self.ids[at]
            cuts = ends[w.first]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                yield ids[a:b]


def worker_encoder(path: str) -> Encoder:
    """The worker process's encoder, which later tasks of the process use on: its cache is bounded and most words recur."""
    kept = sys.modules.setdefault("cadencia_worker_state", types.ModuleType("cadencia_worker_state")).__dict__
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its ids.

    Pieces that aren't full windows wait for the end of their task; beyond SPOOL_BYTES their ids wait on disk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        from pyspark import TaskContext

        encode = worker_encoder(tokenizer or tokenizer_path(MODEL))
        base = TaskContext.get().partitionId() * PER_PARTITION
        names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        rest_keys: list[pa.Array] = []
        rest_rows: list[np.ndarray] = []
        full = 0

        def batch_of(keys: pa.Array, rows: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
            ends = np.concatenate([[0], np.cumsum(rows[:, 1])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.view("<i4")))
            return pa.RecordBatch.from_arrays([keys, *(pa.array(rows[:, k]) for k in range(6)), lists], names=names)

        with tempfile.SpooledTemporaryFile(SPOOL_BYTES) as spool:
            for batch in batches:
                rows, of, parts, rests, rest_of = [], [], [], [], []
                for i, ids in enumerate(encode(batch.column(1))):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(ids), window):
                        part = ids[start : start + window]
                        data = part.tobytes()
                        if len(part) == window:
                            rows.append((start, window, crc32(data), len(ids), base + full, 0))
                            of.append(i)
                            parts.append(part)
                            full += 1
                        else:
                            rests.append((start, len(part), crc32(data), len(ids)))
                            rest_of.append(i)
                            spool.write(data)
                if rests:
                    rest_keys.append(batch.column(0).take(pa.array(rest_of)))
                    rest_rows.append(np.array(rests, np.int64))
                if rows:
                    yield batch_of(batch.column(0).take(pa.array(of)), np.array(rows, np.int64), np.concatenate(parts))
            if rest_rows:
                keys, rows = pa.concat_arrays(rest_keys), np.concatenate(rest_rows)
                sequence, offset = best_fit_decreasing(rows[:, 1], window)
                rows = np.column_stack([rows, base + full + sequence, offset])
                spool.seek(0)
                first = np.flatnonzero(np.diff(np.cumsum(rows[:, 1]) // OUT_IDS, prepend=-1)).tolist()
                for a, b in zip(first, [*first[1:], len(rows)], strict=True):
                    yield batch_of(keys.slice(a, b - a), rows[a:b], np.frombuffer(spool.read(4 * int(rows[a:b, 1].sum())), "<u4"))

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, F.col(text_col).cast("string").alias(text_col))
    total = rows.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return mapped(rows.coalesce(max(1, int(total) // least_bytes)), run, f"{id_col} {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids array<int>")


def digested(pieces: DataFrame) -> DataFrame:
    """The pieces with ids_crc32 computed from their ids, as little-endian 32-bit numbers, in place of the ids."""
    kept = [c for c in pieces.columns if c != "ids"]
    schema = pieces.select(*kept).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("ids"))
            ends = lists.offsets.to_numpy()
            values = lists.values.to_numpy().astype("<i4", copy=False)
            crc = pa.array([crc32(values[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([crc if c == "ids_crc32" else batch.column(batch.schema.get_field_index(c)) for c in kept], names=kept)

    return mapped(pieces, run, schema)
