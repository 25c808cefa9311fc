"""Operators give out their whole results, and take in their whole inputs."""

import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from cadencia.llm import language_id, packing, toxicity
from cadencia.llm.token_counts import tokenizer_path

DOCS = "doc_id long, text string"


def test_packed_sequences_are_rebuilt_from_the_ids(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "SPOOL_BYTES", 100)
    monkeypatch.setattr(packing, "OUT_IDS", 300)
    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    texts = [(i, " ".join(f"word{(i * 7 + k) % 90}" for k in range(i * 37 % 1500))) for i in range(40)] + [(100, None), (101, "")]
    pieces = packing.pack(spark.createDataFrame(texts, DOCS).repartition(2))
    rows = pieces.collect()
    found = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        found.setdefault(r.doc_id, []).extend(r.ids)
    assert found == {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END_ID] for i, t in texts}
    sequences = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert len(sequences.setdefault(r.sequence_id, [])) == r.offset
        sequences[r.sequence_id].extend(r.ids)
    assert sum(map(len, sequences.values())) == sum(map(len, found.values())) and max(map(len, sequences.values())) <= packing.WINDOW
    want = sorted(tuple(r)[:-1] for r in rows)
    assert sorted(tuple(r) for r in packing.digested(pieces).collect()) == want


def test_toxicity_scores_all_of_a_word_and_returns_all_offending_sentences(spark):
    rnd = random.Random(5)
    plain = [f"{a}{b}" for a in "bcdfgl" for b in ("an", "or", "ist", "elle", "ung")]
    han = "的一是了我不人在他有这上们来到时大地为子中你说生国年着就那和要她出也得里后自以会"
    rows = []
    for i in range(600):
        words = ["".join(rnd.choices(han, k=30)) for _ in range(3)] if i % 2 else [" ".join(rnd.choices(plain, k=9)) for _ in range(3)]
        if i % 4 < 2:
            words[1] += "坏蛋混账" if i % 2 else " zorkface"
        rows.append((i, ("。" if i % 2 else ". ").join(words), int(i % 4 < 2)))
    weights = toxicity.learn(spark.createDataFrame([r[:2] for r in rows], DOCS), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"), F.lit(True))
    clean = "".join(rnd.choices(han, k=100))
    texts = [(1, f"{clean}坏蛋混账"), (2, "ban zorkface cor. dist dung. fan zorkface。gor"), (3, f"{clean}。{clean}"), (4, "ban　的x坏蛋混账。dor"), (5, "".join(rnd.choices("bcdfgl", k=100)) + "zorkface")]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(texts, DOCS), weights).collect()}
    assert [got[i].score >= 0.5 for i in (1, 2, 3, 4, 5)] == [True, True, False, True, True]
    assert [(s.sentence, s.text) for s in got[2].offending] == [(0, "ban zorkface cor"), (2, "fan zorkface")]
    assert got[2].n_sentences == 4 and got[3].n_sentences == 2 and got[3].offending == []
    assert [(s.sentence, s.text) for s in got[4].offending] == [(0, "ban　的x坏蛋混账")] and got[4].n_sentences == 2


def segmentations(word, model, lang):
    """Log of the sum over all segmentations, in plain Python."""
    piece = [dict(zip(k.tolist(), p[:, lang].tolist(), strict=True)) for k, p in zip(model.keys, model.logp, strict=True)]
    codes = np.frombuffer(word.encode("utf-32-le"), np.uint32)
    key = [h.tolist() for h in language_id.string_hashes(codes, len(model.keys))]
    logs = [0.0]
    for end in range(1, len(word) + 1):
        ways = []
        for size in range(1, min(end, len(piece)) + 1):
            p = piece[size - 1].get(key[size - 1][end - size], float(model.unknown[lang]) if size == 1 else None)
            if p is not None:
                ways.append(logs[end - size] + p)
        logs.append(float(np.logaddexp.reduce(ways)))
    return logs[-1]


def test_language_id_uses_all_pieces_and_whole_words():
    vocabulary = tokenizer_path(language_id.VOCABULARY)
    texts = language_id.piece_texts(vocabulary)
    assert "algorithm" in texts and "▁application" in texts and max(map(len, texts)) == language_id.LONGEST_PIECE
    model = language_id.fit({"a": Counter({"algorithm": 5, "application" * 30: 2, "漢" * 400: 1}), "b": Counter({"haus": 4})}, vocabulary)
    words = ["algorithm", "applicationalgorithm" * 20, "漢字x" * 300, "haus", "x" * 31, "algorithmalgorithmalgorithmalgor"]
    got = language_id.word_scores(words, model)
    for w, row in zip(words, got, strict=True):
        assert np.allclose(row[:2], [segmentations(language_id.MARK + w, model, j) for j in range(2)], rtol=1e-9)


def test_language_id_learns_every_language(spark):
    rows = [(i, f"{chr(0x4E00 + i)} {chr(0x4E00 + i)}", f"l{i:03}") for i in range(230)]
    docs = spark.createDataFrame(rows, DOCS + ", lang string")
    model = language_id.learn(docs, F.lit(True))
    assert model.langs == [r[2] for r in rows]
