"""Token counts (method: batch encoding in Arrow functions that return lengths only).

Texts are split at safe boundaries: a blank between two characters that are neither a blank nor the model's own mark
for one. No piece of the vocabulary has that mark behind another character, so no merge crosses such a place, and the
encoder's leading mark stands for the blank. Equal parts are encoded once for each cache; the parts still unknown are
encoded in batches of about equal bytes, and only their lengths are kept.

Whether a model allows that is checked when a worker loads it; with one that doesn't, whole texts are encoded.

Nulls count as empty texts and have 0 tokens; very long texts are encoded by parts, whole; repeated rows are counted each;
extra columns of the input are ignored, and those named like a result are too; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordCache, mapped, small_batches
from .wordhash import Words, separators, text_slices

MARK = "▁"
MODEL = "piece_bpe_32k.model"
#: Bytes of text that go to the encoder at once.
BATCH_BYTES = 1 << 18


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache
def split_is_safe(model: str) -> bool:
    """Whether no piece of the vocabulary has the mark of a blank behind another character."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    return not any(MARK in sp.id_to_piece(i).lstrip(MARK) for i in range(sp.get_piece_size()))


class Parts(Words):
    """Words whose ends are the safe boundaries; other blanks belong to a part."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        blank = data == 0x20
        n = len(data)
        prev, after = np.full(n, 0x20, np.uint8), np.full(n, 0x20, np.uint8)
        prev[1:], after[:-1] = data[:-1], data[1:]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        # 0x81 may end the mark and 0xE2 may begin it
        cut = blank & (prev != 0x20) & (after != 0x20) & (prev != 0x81) & (after != 0xE2) & ~edge[:n] & ~edge[1:]
        ends = np.zeros(256, bool)
        ends[0xFF] = True  # no byte of UTF-8
        shown = data.copy()
        shown[cut] = 0xFF
        super().__init__(shown, offsets, ends)


class Texts(Words):
    """Each whole text as one word, for models that may join pieces over any blank."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        super().__init__(data, offsets, np.zeros(256, bool))


def batches_by_bytes(texts: list[str], most: int = BATCH_BYTES) -> Iterator[list[str]]:
    """The texts in order, in as few runs as hold about `most` bytes each, of about equal bytes; a longer one is a run of its own."""
    ends = np.cumsum([len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts])
    if not len(ends):
        return
    runs = -(-int(ends[-1]) // most) or 1
    # the run that the middle of a text falls into
    run = (ends - np.diff(ends, prepend=0) / 2) * runs // max(1, int(ends[-1]))
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield texts[a:b]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, batch_bytes: int = BATCH_BYTES, cache_words: int = 1 << 18) -> DataFrame:
    """id, n_bytes (UTF-8) and n_tokens of each whole text, as the sentencepiece model counts them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model or tokenizer_path(MODEL))

        def lengths(parts: list[str]) -> np.ndarray:
            # a lone part begins with the blank's mark, which the encoder puts there
            return np.array([len(ids) for some in batches_by_bytes(parts, batch_bytes) for ids in sp.encode(some, num_threads=1)], np.int64)

        cache, kind = WordCache(lengths, cache_words), Parts if split_is_safe(model or tokenizer_path(MODEL)) else Texts
        for batch in batches:
            n_tokens, n_bytes = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for at, data, offsets in text_slices(batch.column(1)):
                w = kind(data, offsets)
                each = np.concatenate([[0], np.cumsum(cache(w))])
                n_tokens[at : at + len(offsets) - 1] = each[w.first[1:]] - each[w.first[:-1]]
                n_bytes[at : at + len(offsets) - 1] = np.diff(offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes), pa.array(n_tokens)], names=[id_col, "n_bytes", "n_tokens"])

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return mapped(docs.select(id_col, F.col(text_col).cast("string").alias(text_col)), count, f"{id_col} {kind}, n_bytes bigint, n_tokens bigint")


__all__ = ["batches_by_bytes", "separators", "split_is_safe", "token_counts", "tokenizer_path"]
