"""Language identification (method: segmentation-marginalised unigrams).

Each language has a probability for every piece of a fixed public vocabulary. A word's probability in a language is the
sum over all its segmentations into pieces, by the forward algorithm over its characters; a text's is the product over
its words. The probabilities are fitted by expectation-maximisation (forward-backward) on the word counts of a bounded
sample: for each language, of the documents of at most `most_bytes` / 64 bytes, the `per_lang` with the least hash of their
id, as many of them as have `most_bytes` bytes together. Each language is fitted in a task of its own; the driver gets
the models, one number for each piece, 190 KB a language, which go to the tasks that predict.

A text that is null or has no letter gets `und` and score 0; rows with a null language teach nothing; ties between
languages go to the first in alphabetical order; repeated rows are predicted each; with nothing to learn from, every
text gets `und`; an empty table gives no rows. Every language of the table is learned, and very long texts and words of any
length are scored whole. Extra columns are ignored, also those named like a result (judge() keeps the others).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordCache, mapped, small_batches, sums_by_text
from .token_counts import MARK, tokenizer_path
from .wordhash import U, hashed, mix

VOCABULARY = "piece_bpe_32k.model"
#: Documents of each language that are fitted to, their bytes in all, and rounds of the fit.
PER_LANG, MOST_BYTES, ROUNDS = 600, 16 << 20, 3
#: Characters of the longest piece of VOCABULARY; a model has the length of its own vocabulary's.
LONGEST_PIECE = 16
#: Sums are scaled each so many characters; cells (words by characters, or by languages) that are worked on at once, about.
SCALE_EVERY, CELLS = 8, 400_000
#: ASCII that isn't a letter ends a word here.
NOT_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha())
UNDETERMINED = "und"
BASE = U(0x9E3779B97F4A7C15)


@dataclass
class PieceModel:
    langs: list[str]
    keys: list[np.ndarray]  # by piece length, sorted hashes of the pieces
    logp: list[np.ndarray]  # by piece length, log-probability by piece and language
    unknown: np.ndarray  # log-probability of a character that is no piece, by language


def piece_texts(vocabulary: str) -> list[str]:
    """Lower-case pieces of letters, with the leading mark of a word's start."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    found = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size())}
    return sorted(p for p in found if p and all(c.isalpha() for c in p.removeprefix(MARK)))


def string_hashes(codes: np.ndarray, longest: int = LONGEST_PIECE) -> Iterator[np.ndarray]:
    """For each length, hashes of the runs of that many code points that start at each."""
    out = np.zeros(len(codes), U)
    for size in range(1, longest + 1):
        if size > len(codes):
            out = np.zeros(0, U)
        else:
            out = out[: len(codes) - size + 1] * BASE + codes[size - 1 :].astype(U) + U(1)
        yield mix(out)


def lattice(words: list[str], keys: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Starts of the words in the flat characters, and for each piece length the piece that starts at each character (-1: none)."""
    flat = "".join(words)
    codes = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    left = np.repeat(starts[1:], np.diff(starts)) - np.arange(len(codes))
    pieces = []
    for size, h in enumerate(string_hashes(codes, len(keys)), 1):
        found = np.full(len(codes), -1, np.int32)
        if len(keys[size - 1]) and len(h):
            at = np.minimum(np.searchsorted(keys[size - 1], h), len(keys[size - 1]) - 1)
            hit = (keys[size - 1][at] == h) & (left[: len(h)] >= size)
            found[: len(h)][hit] = at[hit]
        pieces.append(found)
    return starts, pieces


def forward(starts: np.ndarray, pieces: list[np.ndarray], model: PieceModel) -> np.ndarray:
    """Log of the sum over segmentations, by word and language. Positions are handled together, over all words; the sums
    of the last positions are kept, and scaled now and then so that long words don't underflow."""
    sizes = np.diff(starts)
    order = np.argsort(-sizes, kind="stable")
    first, n_langs, longest, kept = starts[:-1][order], len(model.langs), int(sizes.max(initial=0)), len(pieces) + 1
    probs = [np.exp(p) for p in model.logp]
    unknown = np.exp(model.unknown)
    alpha = np.zeros((kept, len(sizes), n_langs))
    alpha[0] = 1
    scale, logs = np.zeros((len(sizes), n_langs)), np.zeros((len(sizes), n_langs))
    active = np.searchsorted(-sizes[order], -np.arange(longest + 2), "right")  # words of at least that size
    for end in range(1, longest + 1):
        n, longer = active[end], active[end + 1]
        new = np.zeros((n, n_langs))
        for size in range(1, min(len(pieces), end) + 1):
            piece = pieces[size - 1][first[:n] + end - size]
            hit = piece >= 0
            if size == 1:
                new[~hit] = alpha[(end - 1) % kept, :n][~hit] * unknown
            if hit.any():
                new[hit] += alpha[(end - size) % kept, :n][hit] * probs[size - 1][piece[hit]]
        alpha[end % kept, :n] = new
        logs[longer:n] = np.log(np.maximum(new[longer:], 1e-300)) + scale[longer:n]
        if end % SCALE_EVERY == 0 and longer:
            top = alpha[:, :longer].max(axis=0)
            alpha[:, :longer] /= top
            scale[:longer] += np.log(top)
    out = np.zeros((len(sizes), n_langs))
    out[order] = logs
    return out


def word_scores(words: list[str], model: PieceModel) -> np.ndarray:
    """Log-probability by language, and in the last column whether the word has a letter. Words without one score 0."""
    out = np.zeros((len(words), len(model.langs) + 1))
    letters = np.array([any(c.isalpha() for c in w) for w in words], bool)
    out[:, -1] = letters
    block = max(1, min(20_000, CELLS // max(1, len(model.langs))))
    for a in range(0, len(words), block):
        out[a : a + block, :-1] = forward(*lattice([MARK + w.lower() for w in words[a : a + block]], model.keys), model)
    out[~letters, :-1] = 0
    return out


@lru_cache
def piece_keys(vocabulary: str) -> list[np.ndarray]:
    """The sorted hashes of the pieces of each length, as string_hashes() gives them."""
    texts = piece_texts(vocabulary)
    out = []
    for size in range(1, max(map(len, texts), default=1) + 1):
        some = [p for p in texts if len(p) == size]
        codes = np.frombuffer("".join(some).encode("utf-32-le"), np.uint32).reshape(len(some), size).astype(U)
        key = np.zeros(len(some), U)
        for k in range(size):
            key = key * BASE + codes[:, k] + U(1)
        out.append(np.unique(mix(key)))
    return out


def fit_one(counts: Counter, keys: list[np.ndarray], rounds: int = ROUNDS) -> PieceModel:
    """Piece probabilities of one language from its word counts, by expectation-maximisation."""
    flat = max(1, sum(map(len, keys)))
    model = PieceModel([""], keys, [np.full((len(k), 1), -np.log(flat)) for k in keys], np.full(1, -np.log(flat * 100.0)))
    words = sorted(w for w in counts if any(c.isalpha() for c in w))
    found = (*lattice([MARK + w.lower() for w in words], keys), np.array([counts[w] for w in words], float))
    for _ in range(rounds):
        expected = [np.full((len(k), 1), 0.01) for k in keys]
        expectations(*found, model, 0, expected)
        total = sum((e.sum(axis=0) for e in expected), np.zeros(1))
        model.logp = [np.log(e / total) for e in expected]
        model.unknown = np.log(0.01 / total)
    return model


def together(models: dict[str, PieceModel], keys: list[np.ndarray]) -> PieceModel:
    """The models of single languages as one, in alphabetical order."""
    langs = sorted(models)
    logp = [np.concatenate([np.zeros((len(k), 0)), *(models[x].logp[i] for x in langs)], axis=1) for i, k in enumerate(keys)]
    return PieceModel(langs, keys, logp, np.concatenate([np.zeros(0), *(models[x].unknown for x in langs)]))


def fit(counts: dict[str, Counter], vocabulary: str, rounds: int = ROUNDS) -> PieceModel:
    """Piece probabilities by language from its word counts."""
    keys = piece_keys(vocabulary)
    return together({lang: fit_one(c, keys, rounds) for lang, c in counts.items()}, keys)


def expectations(starts: np.ndarray, pieces: list[np.ndarray], weight: np.ndarray, model: PieceModel, lang: int, expected: list[np.ndarray]) -> None:
    """Adds the expected count of each piece over all segmentations of the words, weighted by their counts. Sums are logs
    here, so that long words don't underflow; words of like length are handled together."""
    logp, unknown = [p[:, lang] for p in model.logp], float(model.unknown[lang])
    sizes = np.diff(starts)
    order = np.argsort(-sizes, kind="stable")
    at = 0
    while at < len(order):
        block = order[at : at + max(1, CELLS // (int(sizes[order[at]]) + 1))]
        at += len(block)
        size_of, first, w = sizes[block], starts[:-1][block], weight[block]
        longest = int(size_of[0])
        active = np.searchsorted(-size_of, -np.arange(longest + 1), "right")
        before, after = np.full((longest + 1, len(block)), -np.inf), np.full((longest + 1, len(block)), -np.inf)
        before[0] = 0
        for end in range(1, longest + 1):
            for size in range(1, min(len(pieces), end) + 1):
                rows, p, _ = steps(pieces[size - 1][first[: active[end]] + end - size], logp[size - 1], unknown, size)
                before[end, rows] = np.logaddexp(before[end, rows], before[end - size, rows] + p)
        after[size_of, np.arange(len(block))] = 0
        total = before[size_of, np.arange(len(block))]
        for start in range(longest - 1, -1, -1):
            for size in range(1, min(len(pieces), longest - start) + 1):
                rows, p, piece = steps(pieces[size - 1][first[: active[start + size]] + start], logp[size - 1], unknown, size)
                ahead = after[start + size, rows] + p
                after[start, rows] = np.logaddexp(after[start, rows], ahead)
                hit = piece >= 0
                if hit.any():
                    some = rows[hit]
                    np.add.at(expected[size - 1][:, lang], piece[hit], w[some] * np.exp(before[start, some] + ahead[hit] - total[some]))


def steps(piece: np.ndarray, logp: np.ndarray, unknown: float, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with a step of that size, its log-probability, and its piece (-1: an unknown character)."""
    rows = np.arange(len(piece)) if size == 1 else np.flatnonzero(piece >= 0)
    piece = piece[rows]
    return rows, np.where(piece >= 0, logp[np.maximum(piece, 0)] if len(logp) else unknown, unknown), piece


def learn(docs: DataFrame, learnable: Column, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, per_lang: int = PER_LANG, most_bytes: int = MOST_BYTES) -> PieceModel:
    """A model fitted to at most per_lang documents, of at most most_bytes in all, of each language."""
    small_batches(docs.sparkSession)
    vocabulary = vocabulary or tokenizer_path(VOCABULARY)
    rows = docs.filter(learnable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.xxhash64(id_col).alias("h"), F.octet_length(F.col(text_col).cast("string")).cast("bigint").alias("size"))
    langs = rows.groupBy("lang").agg(F.count_if(F.col("size") <= most_bytes // 64).alias("n"))
    # about twice as many as are wanted of each language go on, by hash, so that no language's rows meet in one task
    share = F.pmod(F.col("h"), F.lit(1 << 30)) / (1 << 30)
    some = rows.filter(F.col("size") <= most_bytes // 64).join(F.broadcast(langs), "lang").filter(share * F.col("n") < 2 * per_lang + 50)
    order = Window.partitionBy("lang").orderBy("h", "id")
    so_far = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    least = some.withColumns({"k": F.row_number().over(order), "so_far": so_far}).filter((F.col("k") <= per_lang) & (F.col("so_far") <= most_bytes)).select("id", "lang")
    # at most per_lang ids of each language
    found = docs.join(F.broadcast(least.select(F.col("id").alias(id_col), F.col("lang").alias("__lang")).distinct()), id_col)

    def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, Counter] = {}
            langs = batch.column(0).to_pylist()
            for at, w in hashed(batch.column(1), lower=True, extra=NOT_LETTERS):
                data = w.data.tobytes()
                for i, lang in enumerate(langs[at : at + len(w.first) - 1]):
                    a, b = w.first[i], w.first[i + 1]
                    counts.setdefault(lang, Counter()).update(data[s:e].decode("utf-8", "replace").lower() for s, e in zip(w.start[a:b].tolist(), w.end[a:b].tolist(), strict=True))
            rows = [(k, word, n) for k, c in counts.items() for word, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["lang", "word", "n"])

    def fitted(key: tuple, group: pa.Table) -> pa.Table:
        counts = Counter(dict(zip(group.column("word").to_pylist(), group.column("n").to_pylist(), strict=True)))
        model = fit_one(counts, keys)
        return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "logp": pa.array([np.concatenate(model.logp)[:, 0].tobytes()], pa.binary()), "unknown": pa.array([float(model.unknown[0])])})

    keys, models = piece_keys(vocabulary), {}
    words = mapped(found.select("__lang", F.col(text_col).cast("string")), word_counts, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    ends = np.cumsum([len(k) for k in keys])[:-1]
    for r in words.groupBy("lang").applyInArrow(fitted, "lang string, logp binary, unknown double").collect():
        models[r["lang"]] = PieceModel([r["lang"]], keys, [x[:, None] for x in np.split(np.frombuffer(r["logp"]), ends)], np.array([r["unknown"]]))
    return together(models, keys)


def judge(docs: DataFrame, model: PieceModel, text_col: str = "text") -> DataFrame:
    """The rows with lang_pred and score (posterior of that language, all equally likely before); columns of these names are replaced."""
    small_batches(docs.sparkSession)
    langs = [*model.langs, UNDETERMINED]
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    place = kept.index(text_col)
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCache(lambda words: word_scores(words, model))
        for batch in batches:
            pred, score = np.full(batch.num_rows, len(model.langs)), np.zeros(batch.num_rows)
            for at, w in hashed(batch.column(place), lower=True, extra=NOT_LETTERS):
                if not model.langs or not len(w.hash):
                    continue
                total = sums_by_text(cache(w), w)
                here, logp = total[:, -1] > 0, total[:, :-1]
                best = logp.argmax(axis=1)
                p = 1 / np.exp(np.maximum(logp - logp.max(axis=1, keepdims=True), -700)).sum(axis=1)
                pred[at : at + len(here)][here] = best[here]
                score[at : at + len(here)][here] = p[here]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()).take(pa.array(pred)), pa.array(score)], names=schema.names)

    return mapped(docs.select(*kept), run, schema)


def predict(docs: DataFrame, model: PieceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score of each whole text."""
    return judge(docs.select(id_col, F.col(text_col).cast("string").alias("__text")), model, "__text").select(id_col, "lang_pred", "score")
