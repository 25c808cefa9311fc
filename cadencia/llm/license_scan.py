"""License scans (method: MinHash bands over overlapping text windows).

Words are lower-cased runs of letters and digits. Templates, notices and whole licenses of any length from 5 words on, are
sorted by length into classes that double up to the longest; for a class of templates
of at most `s` words, windows of 2 s words begin at every s-th word, so that every place of s words lies wholly in one.
The window's MinHash values, one for each of `bands` hash functions, are its band keys (bands of one row); a template is
retrieved if it shares one. With similarity j the chance of that is 1 - (1 - j)^bands, and a window that holds 4/5 of a
template has at least the j of least_similarity(); bands() takes as many bands as make the chance of a miss less than
one in a million. Retrieved templates are verified by exact containment: the share of the template's distinct 5-word
shingles that are in the window must be at least 0.8.

Windows without any template's shingle have containment 0 and aren't hashed, which drops nothing. All happens in one row,
with DataFrame functions only, so nothing is shuffled.

Null and empty texts, and those shorter than a shingle, match nothing; very long texts are scanned whole; repeated rows are scanned each; ties in the best
containment go to the first template by id; an empty table gives no rows; columns named like a result are replaced.
Shingles are compared by 64-bit hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_texts import TEMPLATES
from .quality_rules import let

SIZE, CONTAINMENT, MISS = 5, 0.8, 1e-6
#: Words of the templates of the first class.
FIRST_CLASS = 8
RESULTS = ("licenses", "n_licenses", "containment")

def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def shingles(w: Column, size: int = SIZE) -> Column:
    """Hashes of the shingles, in order; null if there are fewer words."""
    return F.when(F.size(w) >= size, F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(size)))))


def least_similarity(n_words: int, s: int, size: int = SIZE, containment: float = CONTAINMENT) -> float:
    """The least Jaccard similarity of a window of 2 s words that holds the share of a template of n_words words."""
    template, window = n_words - size + 1, 2 * s - size + 1
    common = math.ceil(containment * template)
    return common / (window + template - common)


def bands(j: float, miss: float = MISS) -> int:
    """Bands of one row that miss a pair of similarity j with at most that chance."""
    return 1 if j >= 1 else math.ceil(math.log(miss) / math.log1p(-j))


def min_hash(some: Column, n: int) -> Column:
    """Band keys: for each of n hash functions the least hash of the shingles, tagged with the function's number."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.xxhash64(k, F.array_min(F.transform(some, lambda h: F.xxhash64(h, k)))))


def constants(docs: DataFrame, some: dict[str, Column]) -> dict[str, list]:
    """The values of Columns over no input, which Spark would otherwise compute for each row."""
    row = docs.sparkSession.range(1).select(*(c.alias(name) for name, c in some.items())).first()
    return row.asDict()


def longs(values: list[int]) -> Column:
    """An array of constants, as one string that the optimizer folds, not a Column for each."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def classes(longest: int) -> list[int]:
    """Lengths, in words, of the classes of templates, up to the longest."""
    out = [FIRST_CLASS]
    while out[-1] < longest:
        out.append(2 * out[-1])
    return out


def word_count(text: str) -> int:
    return len([w for w in "".join(c if c.isalnum() else " " for c in text.lower()).split() if w])


def scan_licenses(docs: DataFrame, text_col: str = "text", templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """The rows with licenses (license, containment: the best of its windows, by license), n_licenses and containment (the best)."""
    templates = TEMPLATES if templates is None else templates
    sized = {name: word_count(text) for name, text in templates.items()}
    if not all(n >= SIZE for n in sized.values()):
        raise ValueError(f"templates have {SIZE} words or more")
    kept = [c for c in docs.columns if c.lower() not in (*RESULTS, "__shingles", "__licenses")]
    rows = docs.select(*kept, words(F.col(text_col)).alias("__words"))
    rows = rows.select(*kept, shingles(F.col("__words")).alias("__shingles"))
    found: list[Column] = []
    by_class, low = [], SIZE - 1
    for s in classes(max(sized.values(), default=0)):
        some = sorted(name for name, n in sized.items() if low < n <= s)
        if some:
            by_class.append((s, some, max(bands(least_similarity(sized[x], s, containment=containment)) for x in some)))
        low = s
    own = constants(docs, {x: F.array_distinct(shingles(words(F.lit(templates[x])))) for x in sized}) if sized else {}
    keys_of = constants(docs, {x: min_hash(longs(own[x]), n) for _, some, n in by_class for x in some}) if sized else {}
    for s, some, n in by_class:
        every = longs(sorted({h for x in some for h in own[x]}))
        known = F.array(*(F.struct(F.lit(x).alias("license"), longs(own[x]).alias("shingles"), longs(keys_of[x]).alias("keys")) for x in some))
        width = 2 * s - SIZE + 1

        def scan(all_shingles: Column, s: int = s, n: int = n, every: Column = every, known: Column = known, width: int = width) -> Column:
            windows = F.transform(F.sequence(F.lit(0), F.greatest(F.size(all_shingles) - 1, F.lit(0)), F.lit(s)), lambda i: F.slice(all_shingles, i + 1, width))
            windows = F.filter(windows, lambda w: F.arrays_overlap(w, every))
            verify = lambda w, t: F.struct(t.license.alias("license"), (F.size(F.array_intersect(w, t.shingles)) / F.size(t.shingles)).alias("containment"))
            retrieved = lambda w: let(min_hash(w, n), lambda keys: F.filter(known, lambda t: F.arrays_overlap(t.keys, keys)))
            return F.flatten(F.transform(windows, lambda w: F.transform(retrieved(w), lambda t: verify(w, t))))

        found.append(scan(F.col("__shingles")))
    none = F.array().cast("array<struct<license:string,containment:double>>")
    if found:
        found = [F.when(F.arrays_overlap("__shingles", longs(sorted({h for x in own.values() for h in x}))), F.concat(*found))]
    hits = F.filter(F.coalesce(*found, none), lambda m: m.containment >= containment - 1e-12)
    rows = rows.withColumn("__licenses", hits)
    names = F.array_sort(F.array_distinct(F.transform("__licenses", lambda m: m.license)))
    best = lambda name: F.struct(name.alias("license"), F.array_max(F.transform(F.filter("__licenses", lambda m: m.license == name), lambda m: m.containment)).alias("containment"))
    return rows.withColumn("licenses", F.transform(names, best)).select(*kept, "licenses", F.size("licenses").cast("bigint").alias("n_licenses"), F.array_max(F.transform("licenses", lambda m: m.containment)).alias("containment"))
