"""Toxicity (method: multiple-instance learning).

A document is a bag of sentences. A sentence's probability is logistic in its distinct words, each the sum of
the weights of hashed parts (the word, its beginnings, its runs of 4 characters); the document's is
their noisy-or, 1 - prod(1 - p). Only document labels are learned from: the loss is the log loss of the noisy-or, and
its gradient reaches the sentences through it. Afterwards all sentences of probability 0.5 or more are the offending
ones. Words of any length are scored whole. The weights are fitted on a bounded sample: of the labelled documents of at most
`most_bytes` / 64 bytes, the `most_docs` with the least hash of their id, as many of them as have `most_bytes` bytes together.

Null and empty texts have no sentence and score 0; very long texts are scored whole; an empty table gives no rows.
Documents with a null label teach nothing; a document with several labels counts as toxic if any says so; with nothing to
learn from, all scores are 0. Repeated rows are scored each; of sentences of one probability the first is the worst;
extra columns of the input are ignored, also those named like a result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WordCache, mapped, small_batches
from .wordhash import U, Words, mix, separators, text_slices

#: Labelled documents that are fitted to, their bytes in all, and the number of hashed weights.
MOST_DOCS, MOST_BYTES, BITS = 4000, 32 << 20, 18
#: A word's weight is learned if so many of the sample's documents have it.
LEAST_DOCS = 4
START, ROUNDS, RATE, SHRINK = -9.0, 200, 0.5, 2e-5
#: ASCII that is neither a letter nor a digit ends a word; these bytes also end a sentence.
NOT_WORDS = bytes(b for b in range(128) if not chr(b).isalnum())
ENDS = b".!?\n"
#: So do these code points beyond ASCII (Unicode's sentence terminals, line and paragraph separators), and other Unicode blanks end a word.
TERMINALS = (
    "0085 0589 061D-061F 06D4 0700-0702 07F9 0837 0839 083D-083E 0964-0965 104A-104B 1362 1367-1368 166E 1735-1736 17D4-17D5 1803 1809 1944-1945 1AA8-1AAB 1B5A-1B5B 1B5E-1B5F 1B7D-1B7E 1C3B-1C3C "
    "1C7E-1C7F 2024 2028-2029 203C-203D 2047-2049 2E2E 2E3C 2E53-2E54 3002 A4FF A60E-A60F A6F3 A6F7 A876-A877 A8CE-A8CF A92F A9C8-A9C9 AA5D-AA5F AAF0-AAF1 ABEB FE12 FE15-FE16 FE52 FE56-FE57 FF01 FF0E FF1F FF61"
)
BLANKS = "00A0 1680 2000-200A 202F 205F 3000"


def code_points(ranges: str) -> list[int]:
    return [c for r in ranges.split() for c in range(int(r[:4], 16), int(r[-4:], 16) + 1)]


#: The ASCII byte that stands for a code point in ascii_marks; 0 for the others.
MARKS = np.zeros(1 << 16, np.uint8)
MARKS[code_points(TERMINALS)] = ord(".")
MARKS[code_points(BLANKS)] = ord(" ")


def ascii_marks(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes of the same length, with ASCII ones for the terminals and blanks beyond ASCII."""
    out = data
    for low, high, size in ((0xC2, 0xE0, 2), (0xE0, 0xF0, 3)):
        at = np.flatnonzero((data >= low) & (data < high))
        at = at[at + size <= len(data)]
        code = data[at].astype(np.int64) & (0xFF >> (size + 1))
        for k in range(1, size):
            code = code << 6 | (data[at + k] & 0x3F)
        mark = MARKS[code]
        at, mark = at[mark > 0], mark[mark > 0]
        if len(at):
            out = data.copy() if out is data else out
            out[at] = mark
            for k in range(1, size):
                out[at + k] = ord(" ")
    return out


def bags(texts: pa.Array) -> Iterator[tuple[int, Words, np.ndarray]]:
    """(index of the first text, Words, the texts' own bytes) for slices of texts."""
    ends = separators(NOT_WORDS)
    for at, data, offsets in text_slices(texts):
        yield at, Words(ascii_marks(data), offsets, ends, lower=True), data


def sentences(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sentence of each word, the text of each sentence, and the first word of each sentence."""
    ends = np.zeros(256, bool)
    ends[list(ENDS)] = True
    before = np.concatenate([[0], np.cumsum(ends[w.data])])[w.start]
    text = w.text_of()
    new = np.ones(len(w.start), bool)
    new[1:] = (before[1:] != before[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return np.cumsum(new) - 1, text[first], first


def distinct(w: Words, sentence: np.ndarray) -> np.ndarray:
    """The places of the words that are the first of their kind in their sentence."""
    return np.sort(np.unique(mix(w.hash + sentence.astype(U) * U(0x9E3779B97F4A7C15)), return_index=True)[1])


def word_features(word: str, bits: int = BITS) -> list[int]:
    """Hashed features of a word: itself, its beginnings and its runs of 4 characters, so that inflected or disguised forms share some."""
    word = word.lower()
    parts = {f"={word}", *(f"^{word[:k]}" for k in range(3, min(6, len(word)) + 1)), *(word[k : k + 4] for k in range(len(word) - 3))}
    return [zlib.crc32(p.encode()) >> (32 - bits) for p in parts]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def train(texts: pa.Array, labels: np.ndarray, bits: int = BITS, rounds: int = ROUNDS) -> np.ndarray | None:
    """Weights of the hashed features, with the intercept last; None if only one label, or none, is there."""
    if len(set(labels.tolist())) < 2:
        return None
    size, n = len(labels), 0
    known: dict[str, int] = {}
    word, sent, doc = [], [], []
    for at, w, _ in bags(texts):
        sentence, text, _ = sentences(w)
        data = w.data.tobytes()
        once = distinct(w, sentence)
        word.append(np.array([known.setdefault(data[a:b].decode("utf-8", "replace").lower(), len(known)) for a, b in zip(w.start[once].tolist(), w.end[once].tolist(), strict=True)], np.int64))
        sent.append(sentence[once] + n)
        doc.append(text + at)
        n += len(text)
    word, sent, doc = np.concatenate(word), np.concatenate(sent), np.concatenate(doc)
    features = [word_features(x, bits) for x in known]
    of = np.repeat(np.arange(len(features)), [len(f) for f in features])
    feat = np.array([f for some in features for f in some], np.int64)
    # a feature is learned if enough documents have it, each counted once
    pairs = np.unique(doc[sent] * len(known) + word)
    in_docs = np.bincount(feat, np.bincount(pairs % max(1, len(known)), minlength=len(known))[of], 1 << bits)
    common = in_docs >= LEAST_DOCS
    of, feat = of[common[feat]], feat[common[feat]]
    weights, bias = np.zeros(1 << bits), START
    squares, bias_squares = np.full(1 << bits, 1e-8), 1e-8
    for _ in range(rounds):
        p = sigmoid(np.bincount(sent, np.bincount(of, weights[feat], len(known))[word], n) + bias)
        log_none = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), size)
        none = np.exp(log_none)
        # d loss / d (sentence logit): p for a clean document, -p * none / (1 - none) for a toxic one
        share = np.where(labels == 1, -none / np.maximum(-np.expm1(log_none), 1e-9), 1.0) / size
        slope = p * share[doc]
        g = np.bincount(feat, np.bincount(word, slope[sent], len(known))[of], 1 << bits) + SHRINK * np.sign(weights)
        squares += g * g
        moved = weights - np.where(common, RATE * g / np.sqrt(squares), 0)
        weights = np.where((weights != 0) & (np.sign(moved) != np.sign(weights)), 0, moved)  # a weight stops at 0 on its way through
        b = slope.sum()
        bias_squares += b * b
        bias -= RATE * b / np.sqrt(bias_squares)
    return np.append(weights, bias)


def learn(docs: DataFrame, labels: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_docs: int = MOST_DOCS, most_bytes: int = MOST_BYTES) -> np.ndarray | None:
    """Weights fitted to at most most_docs labelled documents of at most most_bytes in all."""
    some = labels.filter(learnable & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("__label")).orderBy(F.xxhash64(id_col), id_col).limit(most_docs)
    rows = docs.select(id_col, F.col(text_col).cast("string").alias("__text")).withColumns({"__size": F.coalesce(F.octet_length("__text"), F.lit(0)).cast("bigint"), "__hash": F.xxhash64(id_col)})
    rows = rows.filter(F.col("__size") <= most_bytes // 64).join(F.broadcast(some), id_col).orderBy("__hash", id_col, "__text").limit(most_docs)
    so_far = F.sum("__size").over(Window.orderBy("__hash", id_col, "__text").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("__so_far", so_far).filter(F.col("__so_far") <= most_bytes).select("__text", "__label").toArrow()
    return train(rows.column(0), rows.column(1).to_numpy().astype(np.int64))


def score(docs: DataFrame, weights: np.ndarray | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, n_sentences, the sentence with the highest probability (its number, probability and text), and offending:
    all sentences of probability 0.5 or more, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [id_col, "score", "n_sentences", "worst_sentence", "worst_score", "worst_text", "offending"]
        kind = pa.list_(pa.struct([("sentence", pa.int64()), ("probability", pa.float64()), ("text", pa.string())]))
        cache = WordCache(lambda words: np.array([weights[word_features(x)].sum() for x in words]))
        for batch in batches:
            n = batch.num_rows
            total, count, worst, worst_p, texts = np.zeros(n), np.zeros(n, np.int64), np.full(n, -1, np.int64), np.zeros(n), [None] * n
            offending: list[list[tuple]] = [[] for _ in range(n)]
            for at, w, own in bags(batch.column(1)):
                if weights is None or not len(w.hash):
                    continue
                sentence, text, first = sentences(w)
                once = distinct(w, sentence)
                p = sigmoid(np.bincount(sentence[once], cache(w)[once], len(text)) + weights[-1])
                size = len(w.first) - 1
                total[at : at + size] = -np.expm1(np.bincount(text, np.log1p(-np.minimum(p, 1 - 1e-12)), size))
                count[at : at + size] = np.bincount(text, minlength=size)
                start = np.concatenate([[0], np.cumsum(count[at : at + size])])
                order = np.lexsort((np.arange(len(p)), -p, text))  # of equals, the first sentence
                last = np.append(first[1:], len(w.start)) - 1
                said = lambda k: own[w.start[first[k]] : w.end[last[k]]].tobytes().decode("utf-8", "replace")  # noqa: E731, B023
                for i in np.flatnonzero(count[at : at + size]).tolist():
                    k = int(order[start[i]])
                    worst[at + i], worst_p[at + i] = k - start[i], p[k]
                    if p[k] >= 0.5:
                        texts[at + i] = said(k)
                for k in np.flatnonzero(p >= 0.5).tolist():
                    offending[at + int(text[k])].append((k - int(start[text[k]]), float(p[k]), said(k)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total), pa.array(count), pa.array(worst), pa.array(worst_p), pa.array(texts, pa.string()), pa.array(offending, kind)], names=names)

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return mapped(docs.select(id_col, F.col(text_col).cast("string").alias(text_col)), run, f"{id_col} {kind}, score double, n_sentences bigint, worst_sentence bigint, worst_score double, worst_text string, offending array<struct<sentence: bigint, probability: double, text: string>>")
