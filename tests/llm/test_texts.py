"""Quality rules, toxicity, chat formatting, token counts, language ID, license scans and packing."""

import math
import random
import re
import zlib
from collections import Counter

import brute
import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from cadencia.llm import chat_format, language_id, license_scan, quality_rules, toxicity
from cadencia.llm.oracles import ORACLES
from cadencia.llm.packing import best_fit_decreasing, pack
from cadencia.llm.queries import QUERIES
from cadencia.llm.token_counts import batches_by_bytes, split_is_safe, token_counts, tokenizer_path

DOCS = "doc_id long, text string"
ODD = [None, "", " ", "\n\t \n", "word", "a  b", "  a", "a ", "▁a ▁ b", "é　x ﬁ", "</s> <s>", "<|endoftext|> x<|startoftext|>y", "\x01 a\x01b", "x́ ́y", "ΣΑΣ ß İ", "don't  we'll", "1234 ５６", "!!!???", "\x85 ", "😀 👩‍👩‍👧"]


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    rnd = random.Random(3)
    found = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    some = [*ODD, *("".join(rnd.choices([" ", "  ", "▁", "\t", "\n", "a", "é", "<|endoftext|>", "</s>", "b", "'s", "1", "#", " ", "Σ"], k=rnd.randint(0, 12))) for _ in range(400))]
    some.append(" ".join(f"long{i % 7000}" for i in range(25000)))
    return [*found, *((100_000 + i, t) for i, t in enumerate(some)), found[0]]


@pytest.fixture(scope="module")
def docs(spark, texts):
    # columns that clash with the results' names
    return spark.createDataFrame(texts, DOCS).repartition(4).withColumns({"n_tokens": F.lit(1), "score": F.lit("x"), "kept": F.lit(0), "lang_pred": F.lit(None)})


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    oracle.check(spark, sf_dir, QUERIES[name], ORACLES[name])


def test_token_counts(docs, texts):
    import sentencepiece

    model = tokenizer_path("piece_bpe_32k.model")
    assert split_is_safe(model)
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    want = sorted((i, len((t or "").encode()), len(sp.encode(t or ""))) for i, t in texts)
    assert sorted(tuple(r) for r in token_counts(docs).collect()) == want
    assert sorted(tuple(r) for r in token_counts(docs, batch_bytes=64, cache_words=50).collect()) == want
    assert list(batches_by_bytes(["aa", "b", "cccc", "d"], 3)) == [["aa", "b"], ["cccc"], ["d"]]


def test_packing_keeps_every_id_once_and_fills_sequences(docs, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    pieces, want = {}, {}
    rows = pack(docs).collect()
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    for i, t in texts:
        want.setdefault(i, []).append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])
    assert set(pieces) == set(want)
    for i, all_ids in want.items():
        ids = all_ids[0]
        assert all(r.doc_tokens == len(ids) for r in pieces[i])
        found = sorted((r.start, r.length, r.ids_crc32) for r in pieces[i])
        cut = [(s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes())) for s in range(0, len(ids), 2048)]
        assert found == sorted(cut * len(all_ids))
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_best_fit_decreasing_is_the_plain_one():
    rnd = random.Random(1)
    for _ in range(60):
        lengths = np.array([rnd.randint(1, 60) for _ in range(rnd.randint(0, 80))], np.int64)
        sequence, offset = best_fit_decreasing(lengths, 64)
        used: list[int] = []
        for i in np.argsort(-lengths, kind="stable").tolist():
            fits = [u for u in used if u + lengths[i] <= 64]
            level = max(fits, default=None)
            if level is None:
                used.append(0)
                level = 0
            assert offset[i] == level
            used[used.index(level)] += int(lengths[i])
        assert len(set(sequence.tolist())) == len(used)


def test_language_id_on_held_out_texts(spark, sf_dir):
    rows = QUERIES["op8_language_id"](spark, sf_dir.replace("0.001", "0.01"))
    truth = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "lang")
    hits = rows.filter("held_out").join(truth, "doc_id").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert hits > 0.98


def every_segmentation(word, probs, unknown):
    if not word:
        return 1.0
    total = 0.0
    for k in range(1, min(len(word), language_id.LONGEST_PIECE) + 1):
        p = probs.get(word[:k], unknown if k == 1 else 0.0)
        if p:
            total += p * every_segmentation(word[k:], probs, unknown)
    return total


def test_forward_algorithm_sums_all_segmentations():
    from collections import Counter

    vocabulary = tokenizer_path("piece_bpe_32k.model")
    model = language_id.fit({"a": Counter({"the": 5, "house": 3, "thehouse": 1}), "b": Counter({"das": 4, "haus": 2, "ß": 1})}, vocabulary)
    by_key = {}
    for p in language_id.piece_texts(vocabulary):
        by_key[int(list(language_id.string_hashes(np.frombuffer(p.encode("utf-32-le"), np.uint32)))[len(p) - 1][0])] = p
    words = ["the", "Haus", "thehaus", "qß漢x", "12"]
    got = language_id.word_scores(words, model)
    for j in range(2):
        probs = {by_key[int(k)]: float(np.exp(model.logp[n][i, j])) for n, keys in enumerate(model.keys) for i, k in enumerate(keys)}
        for w, row in zip(words[:4], got, strict=False):
            assert row[j] == pytest.approx(np.log(every_segmentation(language_id.MARK + w.lower(), probs, float(np.exp(model.unknown[j])))), rel=1e-9)
    assert got[4].tolist() == [0.0, 0.0, 0.0] and got[3, 2] == 1


def test_language_id_of_odd_texts(spark, docs):
    model = language_id.learn(spark.createDataFrame([(1, "le chat noir", "fr"), (2, "the black cat", "en"), (3, "x", None), (4, None, "de")], DOCS + ", lang string"), F.lit(True))
    assert model.langs == ["en", "fr"]
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    for i, t in enumerate(ODD):
        letter = any(c.isalpha() for c in t or "")
        assert (got[100_000 + i].lang_pred == "und") == (not letter)
        assert 0 <= got[100_000 + i].score <= 1
    nothing = language_id.learn(spark.createDataFrame([], DOCS + ", lang string"), F.lit(True))
    assert {r.lang_pred for r in language_id.predict(docs.limit(5), nothing).collect()} == {"und"}


def test_toxicity_finds_documents_and_sentences(spark):
    rnd = random.Random(4)
    plain = [f"{a}{b}" for a in "bcdfgl" for b in ("an", "or", "ist", "elle", "ung")]

    def text(bad):
        parts = [" ".join(rnd.choices(plain, k=9)) for _ in range(rnd.randint(2, 8))]
        if bad:
            k = rnd.randrange(len(parts))
            parts[k] += " " + rnd.choice(["zorkface", "zorkhead", "snarg"])
        return ". ".join(parts) + "."

    rows = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(900)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(5000, None), (5001, ""), (5002, "...")], DOCS)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(1, None)], "doc_id long, toxic int")
    weights = toxicity.learn(docs, labels, F.col("doc_id") % 3 != 0)
    got = {r.doc_id: r for r in toxicity.score(docs, weights).collect()}
    held = [r for r in rows if r[0] % 3 == 0]
    assert np.mean([(got[i].score >= 0.5) == bool(y) for i, _, y in held]) > 0.98
    found = [got[i].worst_text for i, _, y in held if y and got[i].score >= 0.5]
    assert np.mean([any(x in (t or "") for x in ("zork", "snarg")) for t in found]) > 0.95
    assert [got[i].score for i in (5000, 5001, 5002)] == [0.0, 0.0, 0.0]
    assert toxicity.learn(docs, labels.limit(0), F.lit(True)) is None
    assert {r.score for r in toxicity.score(docs.limit(9), None).collect()} == {0.0}


def test_quality_rules(spark, docs, texts):
    rows = quality_rules.apply_rules(docs)
    got = {r.doc_id: r for r in rows.collect()}
    lazy = {r.doc_id: r for r in quality_rules.apply_rules(docs, counts=False).collect()}
    assert {i: r.kept for i, r in got.items()} == {i: r.kept for i, r in lazy.items()} and "n_words" not in lazy[0].asDict()
    for i, t in texts:
        w, r = brute.words(t), got[i]
        triples = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        times = Counter(triples)
        covered = {k + o for k, g in enumerate(triples) if times[g] > 1 for o in range(3)}
        lines = [x for x in (t or "").split("\n") if brute.words(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(covered))
        assert (r.n_symbols, r.n_dup_lines) == (sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert r.kept == (r.rejected_by is None) and not (r.base_failed and r.kept)
    ordered = quality_rules.estimate(docs, quality_rules.rules(), "text", sample_rows=50, runs=1)
    rates = [e.rejects / e.cost for e in ordered]
    assert rates == sorted(rates, reverse=True) and len(ordered) == 7
    empty = quality_rules.apply_rules(docs.limit(0))
    assert empty.count() == 0


def test_chat_parts_are_flattened_and_read_back(spark):
    part = lambda **x: {"kind": None, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | x
    rows = [
        (1, 0, "user", [part(kind="text", text="look \\ <|image 1|> [INST]"), part(kind="image", ref="a.png", width=56, height=29), part(kind="audio", ref="b.wav", seconds=1.5)]),
        (1, 1, "assistant", [part(text="</s> yes"), part(kind="document", ref="c.pdf", pages=2)]),
        (1, None, "sys|<tem", [part(kind="text", text=None)]),
        (2, 0, None, None),
        (None, 5, "assistant", []),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")
    got = {r.conv_id: r for r in chat_format.format_chats(df).withColumn("loss", chat_format.read_loss(F.col("segments"))).withColumn("turns", chat_format.read_turns(F.col("formatted"))).collect()}
    one = got[1]
    assert [(t.role, t.text) for t in one.turns] == [("sys|<tem", ""), ("user", "look \\ <|image 1|> [INST]<|image 1|><|audio 2|>"), ("assistant", "</s> yes<|document 1|>")]
    assert one.loss == "</s> yes<|document 1|>" and one.expanded_tokens == 4 + 38 + 1024
    assert [(a.turn, a.place, a.kind, a.ref, a.tokens) for a in one.attachments] == [(0, 1, "image", "a.png", 4), (0, 2, "audio", "b.wav", 38), (1, 1, "document", "c.pdf", 1024)]
    assert "</s>" not in one.formatted and one.formatted.count("<|image 1|>") == 1
    assert [(t.role, t.text) for t in got[2].turns] == [("", "")] and got[None].loss == ""


def test_chat_round_trip_of_odd_texts(spark):
    rnd = random.Random(8)
    bits = ["\\", "<|", "|>", "<|end|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\n", " ", "a", "é", "<", "|", "/", "\\|"]
    rows = [(c, t, rnd.choice(["user", "assistant", "<|role|>"]), "".join(rnd.choices(bits, k=rnd.randint(0, 14)))) for c in range(60) for t in range(rnd.randint(1, 9))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat_format.text_parts(F.col("text")))
    for r in chat_format.format_chats(df).select("conv_id", chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.read_loss(F.col("segments")).alias("loss"), "formatted").collect():
        mine = [x for x in rows if x[0] == r.conv_id]
        assert [(x.role, x.text) for x in r.t] == [(x[2], x[3]) for x in mine]
        assert r.loss == "".join(x[3] for x in mine if x[2] == "assistant")


def test_chat_turns_of_one_number_are_ordered_by_raw_content(spark):
    rows = [(1, 0, "user", "<|z"), (1, 0, "user", "<az"), (1, 0, "user", "<az")] + [(2, k, "assistant" if k % 2 else "user", f"t{k} \\ <s>") for k in reversed(range(700))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"parts": chat_format.text_parts(F.col("text")), "formatted": F.lit(0)})
    got = {r.conv_id: r for r in chat_format.format_chats(df).select("conv_id", chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.read_loss(F.col("segments")).alias("loss")).collect()}
    assert [x.text for x in got[1].t] == ["<az", "<az", "<|z"]
    assert [x.text for x in got[2].t] == [f"t{k} \\ <s>" for k in range(700)] and got[2].loss == "".join(f"t{k} \\ <s>" for k in range(1, 700, 2))


def plain_toxicity(text, weights):
    """The noisy-or of a text of ASCII, in plain Python."""
    none = 1.0
    for sentence in re.split(r"[.!?\n]", text or ""):
        words = {w.lower() for w in re.findall(r"[A-Za-z0-9]+", sentence)}
        if words:
            x = sum(weights[f] for w in words for f in toxicity.word_features(w)) + weights[-1]
            none *= 1 - 1 / (1 + math.exp(-min(60, max(-60, x))))
    return 1 - none


def test_toxicity_is_the_plain_noisy_or(spark):
    rnd = random.Random(7)
    weights = np.append(np.random.default_rng(2).normal(0, 0.4, 1 << toxicity.BITS), -3.0)
    some = ["".join(rnd.choices(["ab ", "Cde", " ", ". ", "! ", "xyz1 ", "\n", "-"], k=rnd.randint(0, 40))) for _ in range(150)]
    long = " ".join(f"w{i}" for i in range(40_000)) + ". bad one."
    rows = [*enumerate(some), (900, None), (901, ""), (902, long), (902, long), (903, "same words. same words. same words")]
    df = spark.createDataFrame(rows, DOCS).withColumns({"score": F.lit("x"), "offending": F.lit(1)})
    got = toxicity.score(df, weights).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        assert r.score == pytest.approx(plain_toxicity(texts[r.doc_id], weights), abs=1e-9)
    assert next(r.worst_sentence for r in got if r.doc_id == 903) == 0  # of equals the first
    assert toxicity.score(df.limit(0), weights).count() == 0


def test_toxicity_learns_by_the_gradient_of_the_noisy_or():
    import pyarrow as pa

    texts, labels = pa.array(["good day. fine bad", "good day", "bad thing. day", "fine day. thing"] * 4), np.array([1, 0, 1, 0] * 4)

    def loss(weights):
        p = [min(max(plain_toxicity(t, weights), 1e-12), 1 - 1e-12) for t in texts.to_pylist()]
        return -np.mean([math.log(x if y else 1 - x) for x, y in zip(p, labels, strict=True)])

    losses = [loss(toxicity.train(texts, labels, rounds=n)) for n in (1, 5, 30, 120)]
    assert losses == sorted(losses, reverse=True) and losses[-1] < 0.2


def test_sample_for_toxicity_is_bounded_in_bytes(spark):
    rows = [(i, ("bad " if i % 2 else "good ") * (5 if i < 40 else 3000), i % 2) for i in range(60)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], DOCS), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    assert toxicity.learn(docs, labels, F.lit(True), most_bytes=64 * 1000) is not None  # the short ones
    assert toxicity.learn(docs, labels, F.lit(True), most_bytes=64) is None


def test_language_model_is_fitted_by_expectation_maximisation(spark):
    vocabulary = tokenizer_path("piece_bpe_32k.model")
    keys, counts = language_id.piece_keys(vocabulary), Counter({"the": 3, "hat": 2, "that": 1})
    pieces = {int(list(language_id.string_hashes(np.frombuffer(p.encode("utf-32-le"), np.uint32), len(p)))[len(p) - 1][0]): p for p in language_id.piece_texts(vocabulary)}
    flat = sum(map(len, keys))
    prob = dict.fromkeys(pieces.values(), 1 / flat)

    def ways(word):
        if not word:
            yield ()
        for k in range(1, len(word) + 1):
            if word[:k] in prob:
                yield from ((word[:k], *rest) for rest in ways(word[k:]))

    expected = dict.fromkeys(prob, 0.01)
    for word, n in counts.items():
        every = [(w, math.prod(prob[x] for x in w)) for w in ways(language_id.MARK + word)]
        total = sum(p for _, p in every)
        for w, p in every:
            for x in w:
                expected[x] += n * p / total
    whole = sum(expected.values())
    model = language_id.fit_one(counts, keys, rounds=1)
    for size, (k, logp) in enumerate(zip(model.keys, model.logp, strict=True)):
        want = [math.log(expected[pieces[x]] / whole) for x in k.tolist()]
        assert np.allclose(logp[:, 0], want), size
    # the same from a table, each language in a task of its own
    rows = [(i, w, "aa" if i % 2 else "bb") for i, w in enumerate(["the hat", "that", "das haus", "hut", "x" * 70_000])]
    learned = language_id.learn(spark.createDataFrame(rows, DOCS + ", lang string"), F.lit(True), most_bytes=64 * 60_000)
    plain = language_id.fit({"aa": Counter(["that", "hut"]), "bb": Counter(["the", "hat", "das", "haus"])}, vocabulary)
    assert learned.langs == plain.langs and all(np.allclose(a, b) for a, b in zip(learned.logp, plain.logp, strict=True)) and np.allclose(learned.unknown, plain.unknown)


def plain_licenses(text, templates, least=0.8):
    """License: best containment over all windows of twice its class, at every class length."""
    split = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    words, out = split(text), {}
    for name, t in templates.items():
        own, s = grams(split(t)), license_scan.FIRST_CLASS
        while s < len(split(t)):
            s *= 2
        best = max((len(own & grams(words[i : i + 2 * s])) / len(own) for i in range(0, max(1, len(words) - 4), s)), default=0)
        if best >= least:
            out[name] = best
    return out


def test_license_templates_of_any_length(spark):
    rnd = random.Random(6)
    long = " ".join(f"clause{rnd.randint(0, 400)}" for _ in range(1100))
    templates = {"long": long, "mit-text": license_scan.TEMPLATES["mit-text"], "bsd-3-clause-text": license_scan.TEMPLATES["bsd-3-clause-text"], "short": "granted under the tiny license"}
    filler = [f"w{i}" for i in range(900)]
    rows = []
    for i in range(24):
        w = templates[("long", "mit-text", "bsd-3-clause-text", "short")[i % 4]].split()
        for _ in range(rnd.randint(0, max(1, len(w) // 60))):
            w[rnd.randrange(len(w))] = "changed"
        a = rnd.randint(0, 300)
        rows.append((i, " ".join([*filler[:a], *(w[len(w) // 3 :] if i % 7 == 0 else w), *filler[a:]])))
    rows += [(100, " ".join(filler * 30) + " " + templates["mit-text"]), (100, rows[1][1]), (101, templates["short"] + " " + templates["short"]), (102, None)]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, DOCS).withColumn("containment", F.lit("x")), templates=templates).collect()
    assert sorted((r.doc_id, sorted((m.license, round(m.containment, 9)) for m in r.licenses)) for r in got) == sorted((i, sorted((k, round(x, 9)) for k, x in plain_licenses(t, templates).items())) for i, t in rows)
    assert any("long" in plain_licenses(t, templates) for _, t in rows)
    with pytest.raises(ValueError):
        license_scan.scan_licenses(spark.createDataFrame([], DOCS), templates={"x": "four words are few"})


def test_license_scan(spark, docs):
    gpl, mit = license_scan.TEMPLATES["gpl-3.0"], license_scan.TEMPLATES["mit-permission"]
    assert max(license_scan.word_count(t) for t in license_scan.TEMPLATES.values()) > 200
    filler = " ".join(f"w{i}" for i in range(300))
    cut = " ".join(mit.split()[3:])
    rows = [(1, f"{filler} {gpl.upper()} {filler}"), (2, f"{filler} {cut} {filler}"), (3, " ".join(mit.split()[12:])), (4, None), (5, "released under the MIT licence"), (6, f"{gpl} {filler} {mit}")]
    got = {r.doc_id: [m.license for m in r.licenses] for r in license_scan.scan_licenses(spark.createDataFrame(rows, DOCS).withColumn("licenses", F.lit(1))).collect()}
    assert got == {1: ["gpl-3.0"], 2: ["mit-permission"], 3: [], 4: [], 5: [], 6: ["gpl-3.0", "mit-permission"]}
    assert license_scan.scan_licenses(docs.limit(0)).count() == 0
    assert (1 - license_scan.least_similarity(9, 16)) ** license_scan.bands(license_scan.least_similarity(9, 16)) < 1e-6


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    assert token_counts(docs).count() == pack(docs).count() == toxicity.score(docs, None).count() == 0
    assert chat_format.format_chats(spark.createDataFrame([], f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")).count() == 0
