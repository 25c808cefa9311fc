"""Vectorised hashing of words and word windows over Arrow string arrays.

A text's words are its maximal runs of bytes outside 0x20 and 0x09-0x0D, which in UTF-8 are the runs of
``[^\\x20\\x09-\\x0D]+``. Words and windows have 64-bit hashes that are mixed at every step, so that no Python loop runs
over words. Hashes find candidates; where a decision rests on equality, the words' own bytes are compared, or their
BLAKE2b digests.

Memory: a slice of texts takes about 5 bytes for each of its bytes and 150 for each of its words. A text of more than
SLICE_BYTES is a slice of its own, so a worker holds about 30 times its longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Texts are hashed in slices of about this many bytes, which bounds memory; a longer text is a slice of its own.
SLICE_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def separators(extra: bytes = b"") -> np.ndarray:
    """Marks the bytes that end a word: blanks, and those in extra."""
    out = np.zeros(256, bool)
    out[[0x20, *range(0x09, 0x0E), *extra]] = True
    return out


def text_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, its bytes, offsets of the texts in them) for runs of texts; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


#: Bytes of a word's block, and the key of the hash of words.
BLOCK, KEY, STEP = 8, U(0xD6E8FEB86659FD93), U(0x9E3779B97F4A7C15)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words:
    """Words of a slice of texts: hash, byte range, their bytes as blocks of 8, and for each text the range of its words.

    A word's hash is the sum of its mixed blocks, each keyed with its place, mixed with the length. It is no polynomial,
    so that no structure of the letters cancels out; words of one length of at most 8 bytes never share one.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, ends: np.ndarray, lower: bool = False) -> None:
        n = len(data)
        self.inside = inside = ~ends[data]
        new = np.zeros(n + 1, bool)
        new[offsets] = True
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | new[:n]))
        after = np.empty(n, bool)
        after[n - 1 :] = False
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | new[1:])) + 1
        self.data, self.first = LOWER[data] if lower else data, np.searchsorted(self.start, offsets)
        self.size = self.end - self.start
        per = (self.size + BLOCK - 1) // BLOCK
        #: The first block of each word, and where the last one's end.
        self.block = np.concatenate([[0], np.cumsum(per)])
        place = np.arange(self.block[-1]) - np.repeat(self.block[:-1], per)
        at = np.repeat(self.start, per) + BLOCK * place
        padded = np.concatenate([self.data, np.zeros(BLOCK, np.uint8)])
        self.blocks = np.ndarray((n + 1,), "<u8", buffer=padded, strides=(1,))[at]
        spare = np.maximum(BLOCK - (np.repeat(self.end, per) - at), 0).astype(U)
        self.blocks &= U(0xFFFFFFFFFFFFFFFF) >> (U(8) * spare)
        keyed = mix(self.blocks ^ KEY)
        later = place > 0
        keyed[later] = mix(keyed[later] + place[later].astype(U) * STEP)
        self.hash = np.add.reduceat(keyed, self.block[:-1]) if len(self.start) else np.zeros(0, U)
        self.hash = mix(self.hash + self.size.astype(U) * KEY)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The words of each text joined by one blank, and where each word begins and ends there."""
        keep = self.inside.copy()
        keep[self.end[self.end < len(keep)]] = True
        out = np.where(self.inside, self.data, np.uint8(0x20))[keep]
        begin = np.cumsum(keep)[self.start] - 1 if len(self.start) else np.zeros(0, np.int64)
        return out.tobytes(), begin, begin + self.size

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows of size words that start at each word, and a mark where the window lies in one text."""
        n = len(self.hash)
        if n < size:
            return np.zeros(n, U), np.zeros(n, bool)
        last = self.first[1:][self.text_of()]
        whole = np.arange(n) + size <= last
        out = np.zeros(n, U)
        out[: n - size + 1] = rolling(self.hash, size)
        return out, whole


def rolling(x: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of size values, by doubling; each step mixes, so that they aren't polynomials."""
    done, out, part, width, bits = 0, None, x, 1, size
    while bits:
        if bits & 1:
            if out is None:
                out, done = part, width
            else:
                m = len(x) - (done + width) + 1
                out, done = mix(out[:m] * STEP + part[done : done + m]), done + width
        bits >>= 1
        if bits:
            m = len(x) - 2 * width + 1
            part, width = mix(part[:m] * STEP + part[width : width + m]), 2 * width
    return mix(out)


def digests(text: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """BLAKE2b of each range of bytes, as two 64-bit numbers each."""
    view, hashing = memoryview(text), hashlib.blake2b
    found = b"".join([hashing(view[a:b], digest_size=16).digest() for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
    return np.frombuffer(found, "<i8").reshape(-1, 2)


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Least of each run of size values, by doubling."""
    width = 1
    while 2 * width <= size:
        x = np.minimum(x[:-width], x[width:]) if width < len(x) else x[:0]
        width *= 2
    rest = size - width
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def hashed(texts: pa.Array, lower: bool = False, extra: bytes = b"") -> Iterator[tuple[int, Words]]:
    """(index of the first text, Words) for slices of texts."""
    ends = separators(extra)
    for at, data, offsets in text_slices(texts):
        yield at, Words(data, offsets, ends, lower)
