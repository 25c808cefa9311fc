"""Hashes and caches of words: equal hashes of different words change nothing."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cadencia.llm import packing, token_counts
from cadencia.llm.common import WordCache
from cadencia.llm.token_counts import tokenizer_path
from cadencia.llm.wordhash import digests, hashed

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(1)
    some = ["".join(rnd.choices(["a", "b ", "é", " ", "\n", "\0", "xyz", "longerword", "Z"], k=rnd.randint(0, 60))) for _ in range(800)]
    return [*some, None, "", "word " * 200_000]


@pytest.mark.parametrize("lower", [False, True])
def test_words_hashes_and_joined_texts(texts, lower):
    seen = {}
    for at, w in hashed(pa.array(texts), lower):
        joined, begin, end = w.joined()
        for i, n in enumerate(w.counts.tolist()):
            t = texts[at + i] or ""
            t = "".join(chr(ord(c) + 32) if lower and "A" <= c <= "Z" else c for c in t)
            words, a = re.findall("[^\\x20\\x09-\\x0d]+", t), w.first[i]
            assert len(words) == n
            for k, x in enumerate(words[:200]):
                assert seen.setdefault(x, int(w.hash[a + k])) == int(w.hash[a + k])
                assert joined[begin[a + k] : end[a + k]].decode() == x
            assert not n or joined[begin[a] : end[a + n - 1]].decode() == " ".join(words)
    assert len(set(seen.values())) == len(seen)


def test_cache_tells_words_of_one_hash_apart(texts):
    for _, w in hashed(pa.array(texts[:800])):
        w.hash = w.hash % np.uint64(7)
        cache = WordCache(lambda some: np.array([[len(x), sum(map(ord, x))] for x in some], np.int64).reshape(-1, 2), most=50)
        data = w.data.tobytes()
        want = [[len(x), sum(map(ord, x))] for x in (data[a:b].decode() for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True))]
        for _ in range(2):
            assert cache(w).tolist() == want


def test_digests_are_of_the_bytes():
    import hashlib

    got = digests(b"abcdef", np.array([0, 2]), np.array([3, 2]))
    assert got.tobytes() == hashlib.blake2b(b"abc", digest_size=16).digest() + hashlib.blake2b(b"", digest_size=16).digest()


def thue_morse(n):
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_ids_and_counts_of_words_that_collide_in_polynomial_hashes(spark):
    import sentencepiece
    from tokenizers import Tokenizer

    rows = list(enumerate(thue_morse(1024)))
    df = spark.createDataFrame(rows, DOCS).withColumns({"n_tokens": F.lit("x"), "length": F.lit(1)}).coalesce(1)
    sp, tokenizer = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model")), Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    assert sorted(tuple(r) for r in token_counts.token_counts(df).collect()) == [(i, 1024, len(sp.encode(t))) for i, t in rows]
    crc = lambda t: zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes())
    assert sorted((r.doc_id, r.ids_crc32) for r in packing.pack(df).collect()) == [(i, crc(t)) for i, t in rows]


def test_whole_texts_are_encoded_where_splits_are_not_safe(spark):
    import sentencepiece
    from tokenizers import Tokenizer

    rows = [(0, "two  words\n and 12 more's"), (1, None), (2, ""), (3, "é x\u0301 ﬁ 😀" * 30), (0, "again")]
    df = spark.createDataFrame(rows, DOCS)
    path = tokenizer_path("byte_bpe_50k.json")  # its tokens hold the blank before a word
    assert not packing.Encoder(path).by_word and packing.Encoder(tokenizer_path(packing.MODEL)).by_word
    tokenizer = Tokenizer.from_file(path)
    got = sorted((r.doc_id, r.ids) for r in packing.pack(df, tokenizer=path).collect())
    assert got == sorted((i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows)
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(token_counts.MODEL))
    w = next(token_counts.Texts(data, offsets) for _, data, offsets in token_counts.text_slices(pa.array([t for _, t in rows])))
    lengths = WordCache(lambda some: np.array([len(sp.encode(x)) for x in some], np.int64))(w)
    assert w.counts.tolist() == [1, 0, 0, 1, 1] and lengths.tolist() == [len(sp.encode(t)) for _, t in rows if t]


def test_batches_are_balanced_by_bytes():
    some = ["é" * 10, "a" * 20, "b" * 20, "c" * 20, "漢" * 100, "d"]
    got = list(token_counts.batches_by_bytes(some, 45))
    assert [x for b in got for x in b] == some and ["漢" * 100] in got
    even = [sum(len(x) for x in b) for b in token_counts.batches_by_bytes(["a" * 10] * 101, 200)]
    assert max(even) - min(even) <= 10 and len(even) == 6
    assert list(token_counts.batches_by_bytes([])) == []


@pytest.mark.parametrize("partitions", [211, 1000])
def test_padding_is_below_one_percent_however_the_input_is_dealt(spark, sf_dir, partitions):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs).repartition(partitions)
    used, sequences = packing.pack(docs).agg(F.sum("length"), F.countDistinct("sequence_id")).first()
    assert 1 - used / (sequences * packing.WINDOW) < 0.01


def test_frequent_words_stay_in_a_full_cache():
    made = []

    def lengths(words):
        made.extend(words)
        return np.array([len(x) for x in words], np.int64)

    cache = WordCache(lengths, most=100)
    for i in range(200):
        words = [f"often{k}" for k in range(30)] + [f"once{i}x{k}" for k in range(20)] + [f"{i}" + "z" * 5000]
        ((_, w),) = hashed(pa.array([" ".join(words)]))
        assert cache(w).tolist() == [len(x) for x in words]
        assert len(cache.keys) <= 151 and len(cache.place) <= 2 * 151 and len(cache.blocks) < 20_000
    assert sum(x.startswith("often") for x in made) == 30


def test_ids_of_words_when_the_cache_is_full(texts):
    from tokenizers import Tokenizer

    path = tokenizer_path(packing.MODEL)
    tokenizer, encode = Tokenizer.from_file(path), packing.Encoder(path, most=40)
    rnd = random.Random(2)
    some = [" ".join(rnd.choice(["often", "the", "of", "Ünï", "x" * rnd.randint(1, 90), str(rnd.random())]) for _ in range(60)) for _ in range(300)]
    for k in range(0, len(some), 10):
        part = [*some[k : k + 10], None, ""]
        got = [ids.tolist() for ids in encode(pa.array(part))]
        assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in part]
    assert len(encode.ids) < 1 << 18
