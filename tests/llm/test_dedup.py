"""Substring dedup, the n-gram join, decontamination and the pipeline against brute force."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cadencia.llm.components import components
from cadencia.llm.common import WRITTEN, drop_written, shared_folder
from cadencia.llm.decontamination import decontaminate, differs, packed_bits, radius, sums_of_bits
from cadencia.llm.ngram_join import keys, most_different, ngram_join, size_class
from cadencia.llm.queries import QUERIES
from cadencia.llm.substring_dedup import FingerprintIndex, remove_repeats
from cadencia.llm.wordhash import mix, rolling, sliding_min

ITEMS = "item_id long, text string"
DOCS = "doc_id long, text string"


def near_copies(n, seed=5, size=150):
    rnd = random.Random(seed)
    base = [f"w{rnd.randint(0, 400)}" for _ in range(size)]
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, 6)):
            w[rnd.randrange(len(w))] = f"z{rnd.randint(0, 10**6)}"
        yield "  ".join(w[rnd.randint(0, 12) :] if rnd.random() < 0.3 else w)


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    found = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    passage = " ".join(f"p{i}" for i in range(60))
    odd = ["x " * 100, passage + " a b c", "q " + passage, None, "", " \n\t", " ".join(f"p{i}" for i in range(34)), "ab cd " * 30, passage + " zz " + passage, " ".join(f"t{i % 7}" for i in range(40)), "one"]
    odd += list(near_copies(120))
    for n in range(1, 30):
        w = [f"y{n}_{i}" for i in range(n)]
        odd += [" ".join(w), " ".join([*w, "q"]), " ".join(w).upper()]
    odd.append(" ".join(f"long{i % 9000}" for i in range(30000)))
    found += [(100_000 + i, t) for i, t in enumerate(odd)]
    return [*found, found[0], found[0]]


def test_rolling_hash_is_that_of_the_window():
    x = mix(np.arange(40, dtype=np.uint64))
    for size in (1, 2, 3, 5, 7, 31, 35):
        r = rolling(np.tile(x, 3), size)
        assert (r[:40] == r[40:80]).all() and len(set(r[:40].tolist())) == 40
    y = np.random.default_rng(1).integers(0, 1000, 100)
    for size in (1, 2, 3, 27):
        assert (sliding_min(y, size) == [y[i : i + size].min() for i in range(101 - size)]).all()


def test_substring_dedup(spark, rows):
    got = remove_repeats(spark.createDataFrame(rows, DOCS).repartition(5))
    got = sorted(tuple(r) for r in got.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect())
    assert got == brute.substring_dedup(rows)


def thue_morse(n, letters="ab"):
    """Two words whose polynomial hashes modulo 2**64 are equal for every base."""
    word = "".join(letters[bin(i).count("1") % 2] for i in range(n))
    return word, word.translate(str.maketrans(letters, letters[::-1]))


def test_words_that_collide_in_polynomial_hashes(spark):
    one, other = thue_morse(1024)
    rows = [(i, " ".join([*(f"w{k}" for k in range(17)), x, *(f"v{k}" for k in range(17))])) for i, x in enumerate((one, other))]
    df = spark.createDataFrame(rows, DOCS)
    assert [(r.doc_id, r.n_removed) for r in remove_repeats(df).orderBy("doc_id").collect()] == [(0, 0), (1, 0)]
    assert [(r.doc_id, r.component_id) for r in ngram_join(df).orderBy("doc_id").collect()] == [(0, 0), (1, 1)]
    # the same with words in place of letters
    a, b = (" ".join(t) for t in thue_morse(2048, "xy"))
    df = spark.createDataFrame([(0, a), (1, b)], DOCS)
    assert sorted(tuple(r) for r in remove_repeats(df).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()) == brute.substring_dedup([(0, a), (1, b)])


def test_index_gives_what_a_batch_makes_known(spark, rows):
    passage = " ".join(f"p{i}" for i in range(60))
    index = FingerprintIndex(spark, most_runs=2)
    assert index.rows().count() == 0
    first = spark.createDataFrame([(1, "a " + passage)], DOCS)
    assert index.add(first).count() == 0
    new = spark.createDataFrame([(2, passage), (3, " ".join(f"n{i}" for i in range(80)))], DOCS)
    plan = index.known(new.select(F.xxhash64("text").alias("fp")))._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan
    places = index.add(new, texts=first.unionByName(new))
    # the late batch's text, and the earlier one, which occurred once so far
    assert places.select("s1", "s2").distinct().count() == 2
    assert len(index.runs) == 2
    index.add(spark.createDataFrame([(4, "b c d")], DOCS), texts=first.unionByName(new))
    assert len(index.runs) == 1  # all three
    fps = [r.fp for r in spark.read.parquet(index.runs[0]).collect()]
    assert fps == sorted(fps)
    index.drop()


def test_substring_dedup_is_the_same_for_any_number_of_batches(spark, rows):
    some = rows[-150:]
    want = brute.substring_dedup(some)
    for batches, most_runs in ((1, 1), (5, 1)):
        got = remove_repeats(spark.createDataFrame(some, DOCS).withColumns({"n_words": F.lit("x"), "Kept_Text": F.lit(0)}), batches=batches, most_runs=most_runs)
        assert sorted(tuple(r) for r in got.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()) == want


def test_ngram_join(spark, rows):
    df = spark.createDataFrame(rows, DOCS).repartition(5).withColumn("sig", F.lit("extra")).withColumn("n_shingles", F.lit(1))
    want = brute.ngram_join(rows)
    assert sum(d != c for d, _, c, _ in want) > 100
    for shingles, sets in ((1 << 20, 256), (1 << 20, 20), (2000, 1000)):
        assert sorted(tuple(r) for r in ngram_join(df, most_shingles=shingles, least_sets=sets).collect()) == want


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(3)
    for n in [*range(1, 60), 200, 800]:
        for _ in range(20):
            x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            gone = rng.integers(0, max(1, int(n * 0.15)) + 1)
            new = rng.integers(0, max(1, int(n * 0.1)) + 1)
            y = np.unique(np.concatenate([rng.permutation(x)[: len(x) - gone], rng.integers(0, 1 << 63, new, dtype=np.uint64)]))
            o = len(np.intersect1d(x, y))
            if len(y) and 100 * o >= 85 * (len(x) + len(y) - o):
                assert len(np.intersect1d(keys(x), keys(y)))
                assert len(x) + len(y) - 2 * o <= most_different(max(size_class(len(x)), size_class(len(y))))


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(160)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), shared_folder(spark), "t").collect()}
    assert got == {x: find(x) for x in got} and set(got) >= {x for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long"), shared_folder(spark), "t").count() == 0


@pytest.fixture(scope="module")
def items(spark, sf_dir):
    found = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    return [*found, (900, "one two"), (901, None), (902, ""), (903, "a b " * 10)]


def test_decontamination(spark, rows, items):
    rnd = random.Random(2)
    some = [r for r in rows if r[0] < 100_130 or r[0] == 100_000 + len(rows)]
    for i, (_, t) in enumerate(items[:40] * 4):
        w = (t or "").split()
        for _ in range(rnd.randint(0, 2)):
            k, kind = rnd.randrange(len(w)), rnd.random()
            w[k : k + (kind < 0.7)] = ["zzz"] if kind < 0.4 or kind >= 0.7 else []
        around = [f"f{rnd.randint(0, 99)}" for _ in range(rnd.randint(0, 60))]
        some.append((200_000 + i, " ".join([*around, *w, *around]).upper() if i % 2 else " ".join(w)))
    some += [(300_000, "xx one two yy"), (300_001, "a b " * 40)]
    df, bench = spark.createDataFrame(some, DOCS).withColumn("matches", F.lit(0)), spark.createDataFrame(items, ITEMS)
    want = brute.contaminated(some, items)
    assert sum(map(bool, want.values())) > 60
    got = {r.doc_id: r for r in decontaminate(df, bench).collect()}
    for d, hits in want.items():
        assert set(got[d].item_ids) == set(hits)
        assert {m.item_id: round(m.similarity, 9) for m in got[d].matches} == {i: round(s, 9) for i, s in hits.items()}
    blocks = decontaminate(df, bench, block_items=7)
    assert {r.doc_id: r.item_ids for r in blocks.collect()} == {d: r.item_ids for d, r in got.items()}


def test_decontamination_by_ids_of_any_kind_with_several_texts(spark):
    one, two = "alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight nine"
    items = spark.createDataFrame([("q-1", one), ("q-1", two), ("q-2", one), (None, two), ("q-1", one)], "item_id string, text string")
    long = " ".join(f"w{i % 7001}" for i in range(60_000))
    rows = [(1, f"x {one} y"), (2, f"{long} {two} {long}"), (3, long), (4, None), (4, f"a {two}"), (5, f"{two} and {two}")]
    df = spark.createDataFrame(rows, DOCS).withColumns({"n_items": F.lit("x"), "best_item": F.lit(1)})
    for n in (20_000, 1):
        got = decontaminate(df, items, block_items=n).orderBy("doc_id", F.col("n_items").desc()).collect()
        assert [(r.doc_id, r.n_items, r.item_ids, r.best_item) for r in got] == [(1, 2, ["q-1", "q-2"], "q-1"), (2, 2, ["q-1", None], "q-1"), (3, 0, [], None), (4, 2, ["q-1", None], "q-1"), (4, 0, [], None), (5, 2, ["q-1", None], "q-1")]
        assert [m.start for m in got[1].matches] == [60_000, 60_000] and {m.start for m in got[5].matches} == {0}  # of equal windows the first


def test_radius_goes_by_the_items_length():
    assert [radius(n) for n in (1, 2, 4)] == [0, 0, 0] and all(10 < radius(n) < 24 for n in (5, 8, 20, 100, 5000))
    assert differs(9, 9, 9) == 0 and differs(1, 1, 0) == pytest.approx(0.5)
    rnd = np.random.default_rng(1)
    for n, common in ((9, 8), (45, 40)):  # similarity 0.8 at the least
        far = []
        for _ in range(400):
            x = rnd.integers(0, 1 << 63, 2 * n - common, dtype=np.uint64) * np.uint64(2) + rnd.integers(0, 2, 2 * n - common, dtype=np.uint64)
            a, b = (packed_bits(sums_of_bits(y)[-1:])[0] for y in (x[:n], x[n - common :]))
            far.append(int(np.bitwise_count(a ^ b)))
        assert np.mean(np.array(far) <= radius(n)) >= 0.99


@pytest.mark.parametrize("name", ["op3_substring_dedup", "op4_decontamination", "op6_ngram_join"])
def test_query_equals_brute_force(spark, sf_dir, name):
    read = lambda t: [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").select(*(("doc_id", "text") if t == "documents" else ("item_id", "text"))).collect()]
    rows, got = read("documents"), [tuple(r) for r in QUERIES[name](spark, sf_dir).collect()]
    if name == "op4_decontamination":
        assert {r[0]: set(r[3]) for r in got} == {d: set(hits) for d, hits in brute.contaminated(rows, read("benchmark")).items()}
    else:
        assert sorted(got) == {"op3_substring_dedup": brute.substring_dedup, "op6_ngram_join": brute.ngram_join}[name](rows)


def test_pipeline(spark, rows, items, tmp_path):
    rows = [(i, t) for i, t in rows if i < 100_060 or i > 100_200]
    extra = {"score": F.lit("s"), "kept_text": F.lit(7), "matches": F.col("doc_id") + 1, "sig": F.lit(None).cast("string")}
    en = [(i, t, "en" if i % 2 else "fr", f"s{i % 3}", len(t or "")) for i, t in rows]
    spark.createDataFrame(en, "doc_id long, text string, lang string, source string, n_chars long").withColumns(extra).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = [(i, t) for i, t in dict.fromkeys(rows) if any(c.isalpha() for c in t or "")]
    least = {i: c for i, _, c, _ in brute.ngram_join(kept)}
    kept = [(i, t) for i, t in kept if least[i] == i]
    left = {i: w for i, _, w in brute.kept_words(kept)}
    kept = [(i, t if len(left[i]) == len(brute.words(t)) else " ".join(left[i])) for i, t in kept if left[i]]
    bad = brute.contaminated(kept, items)
    want = {i: t for i, t in kept if not bad[i]}

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
    got = {r.doc_id: r for r in docs.collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all((r.n_chars, r.source, r.lang, r.score, r.kept_text, r.matches) == (len(r.text), f"s{i % 3}", "en" if i % 2 else "fr", "s", 7, i + 1) for i, r in got.items())


def test_pipeline_runs_over_a_small_and_an_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    passage = " ".join(f"p{i}" for i in range(60))
    own = lambda x: " ".join(f"{x}{i}" for i in range(40)) + " "
    rows = [(1, "le chat noir dort " + own("chat") + passage, "fr", "a", 1), (2, "the black cat sleeps", "en", "b", 1), (3, None, None, None, None), (4, "... 123", "en", "b", 1), (5, "the dog " + own("dog") + passage, "en", "a", 1), (6, "the black cat sleeps", "en", "b", 1), (7, "what is the answer to all of it", "en", "b", 1)]
    for k, some in enumerate((rows, [])):
        at = f"{tmp_path}/{k}"
        spark.createDataFrame(some, schema).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(1, "What is the answer to all of it?")], ITEMS).write.parquet(f"{at}/benchmark.parquet")
        before = len(WRITTEN)
        pieces = corpus_pipeline.run(spark, at)
        assert {r.doc_id for r in pieces.collect()} == ({1, 2, 5} if some else set())
        assert len(WRITTEN) == before + 1  # the result's folder alone is left
    drop_written(spark, before)


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert remove_repeats(docs).count() == 0
    assert ngram_join(docs).count() == 0
    assert decontaminate(docs, bench).count() == 0
    some = spark.createDataFrame([(1, "a b"), (None, None)], DOCS)
    assert [r.n_items for r in decontaminate(some, bench).collect()] == [0, 0]
    assert {(r.doc_id, r.n_removed) for r in remove_repeats(some).collect()} == {(1, 0), (None, 0)}
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join(some).collect()} == {(1, 1, 1), (None, 0, None)}


def test_queries_are_registered():
    assert [f"op{n}_" for n in range(1, 11)] == [f"{q.split('_')[0]}_" for q in sorted(QUERIES, key=lambda q: int(q.split("_")[0][2:]))]
