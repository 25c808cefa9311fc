"""Quality rules (method: a short-circuit cascade, ordered by rejection per cost).

Each rule is a Column that is true where a text fails. On a bounded sample each rule's share of failing texts and its
marginal cost (the least time of a few runs, less that of a trivial rule) are estimated; all rules, the base ones too, go
in order of rejection per cost into one CASE, which Spark leaves at the first that holds, so that later rules are
evaluated only for texts that pass the earlier ones. The order changes the time, never the verdict: a text is kept if no
rule holds.

With `counts` the base counts are columns of the result and made for every row; a rule that needs only those costs a
comparison, and that is what is estimated. Without `counts` each rule makes the counts that it needs behind the CASE.

Only DataFrame functions run. Words are `[^\\x20\\x09-\\x0D]+`. A null text counts as empty, which has no words; texts,
also very long ones, are looked at whole; repeated rows are judged each; rules of equal rejection per cost go by cost, then name; an empty
table gives no rows; columns named like a result are replaced. Equal word triples are found by a 64-bit hash within one text.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Rows of the sample that costs and selectivities are estimated on, and runs for each rule.
SAMPLE_ROWS, RUNS = 1000, 2
LEAST_WORDS, MOST_REPEATED = 50, 50
MOST_SYMBOLS, MOST_DUP_LINES, SHORTEST_WORDS, LONGEST_WORDS, MOST_CAPITALS, LEAST_LETTERS = 10, 40, 2.0, 14.0, 60, 40
BASE = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of the value, which is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def word_chars(w: Column) -> Column:
    return F.length(F.array_join(w, "")).cast("bigint")


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint")


def lines(text: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))


def n_dup_lines(found: Column) -> Column:
    return (F.size(found) - F.size(F.array_distinct(found))).cast("bigint")


def n_repeat_words(w: Column) -> Column:
    """Words under a window of 3 words that occurs at least twice: triples are sorted by hash, those with an equal neighbour kept, and their places merged."""
    triples = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))
    twice = lambda s: F.filter(s, lambda x, j: (x.h == F.get(s, j - 1).h) | (x.h == F.get(s, j + 1).h))
    places = F.sort_array(F.transform(let(F.sort_array(triples), twice), lambda x: x.i))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n"))
    covered = F.aggregate(places, start, lambda a, p: F.struct(p.alias("last"), (a.n + F.least(F.lit(3), p - a.last)).alias("n")), lambda a: a.n)
    return F.coalesce(covered, F.lit(0).cast("bigint"))


def capitals(text: Column) -> Column:
    return F.regexp_count(text, F.lit("\\p{Lu}"))


def letters(text: Column) -> Column:
    return F.regexp_count(text, F.lit("\\p{L}"))


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Column
    base: bool = False


def features() -> dict[str, Column]:
    """The base counts, from the text in __text and its __words and __lines."""
    text, w, found = F.col("__text"), F.col("__words"), F.col("__lines")
    size = lambda x: F.size(x).cast("bigint")
    return {"n_words": size(w), "word_chars": word_chars(w), "n_symbols": n_symbols(text), "n_lines": size(found), "n_dup_lines": n_dup_lines(found), "n_repeat_words": n_repeat_words(w)}


def rules(counts: bool = True) -> list[Rule]:
    """Over the columns that with_features() adds, the base counts among them or not, and the text itself in __text."""
    text, w = F.col("__text"), F.col("__words")
    c = F.col if counts else features().__getitem__
    return [
        Rule("few_words", c("n_words") < LEAST_WORDS, base=True),
        Rule("repeated_words", 100 * c("n_repeat_words") > MOST_REPEATED * c("n_words"), base=True),
        Rule("symbols", 100 * c("n_symbols") > MOST_SYMBOLS * c("n_words")),
        Rule("duplicate_lines", 100 * c("n_dup_lines") > MOST_DUP_LINES * c("n_lines")),
        Rule("word_length", (c("word_chars") < SHORTEST_WORDS * c("n_words")) | (c("word_chars") > LONGEST_WORDS * c("n_words"))),
        Rule("capitals", 100 * capitals(text) > MOST_CAPITALS * letters(text)),
        Rule("few_letters", 100 * F.size(F.filter(w, lambda x: x.rlike("\\p{L}"))) < LEAST_LETTERS * c("n_words")),
    ]


def with_features(docs: DataFrame, text_col: str, counts: bool = True) -> DataFrame:
    kept = [c for c in docs.columns if c.lower() not in (*BASE, "base_failed", "kept", "rejected_by", "__text", "__words", "__lines")]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(*kept, text.alias("__text")).withColumns({"__words": words(F.col("__text")), "__lines": lines(F.col("__text"))})
    return rows.withColumns(features()) if counts else rows


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    rejects: float
    cost: float


def estimate(docs: DataFrame, some: list[Rule], text_col: str, sample_rows: int = SAMPLE_ROWS, runs: int = RUNS, counts: bool = True) -> list[Estimate]:
    """The rules by falling rejection per marginal cost, estimated on at most sample_rows rows whose words, and counts, are made before."""
    total = docs.count()
    texts = docs.select(text_col).sample(min(1.0, 1.5 * sample_rows / max(1, total)), seed=1).limit(sample_rows).coalesce(1)
    rows = with_features(texts, text_col, counts).persist()

    def seconds(fails: Column) -> tuple[float, float]:
        best, share = float("inf"), 0.0
        for _ in range(runs):
            began = time.perf_counter()
            share = rows.agg(F.avg(F.coalesce(fails, F.lit(False)).cast("int"))).first()[0] or 0.0
            best = min(best, time.perf_counter() - began)
        return best, share

    try:
        seconds(F.lit(False))  # fills the cache
        nothing, _ = seconds(F.length("__text") < 0)
        out = [Estimate(r, share, max(t - nothing, 1e-4)) for r in some for t, share in [seconds(r.fails)]]
    finally:
        rows.unpersist()
    return sorted(out, key=lambda e: (-e.rejects / e.cost, e.cost, e.rule.name))


def cascade(ordered: list[Rule]) -> Column:
    """The name of the first rule that a text fails, null if none."""
    out = F.when(F.coalesce(ordered[0].fails, F.lit(False)), ordered[0].name)
    for r in ordered[1:]:
        out = out.when(F.coalesce(r.fails, F.lit(False)), r.name)
    return out


def apply_rules(docs: DataFrame, text_col: str = "text", some: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS, counts: bool = True) -> DataFrame:
    """The rows with kept, and rejected_by: the first rule of the cascade that rejects the text; with counts also the base counts and base_failed."""
    some = rules(counts) if some is None else some
    ordered = [e.rule for e in estimate(docs, some, text_col, sample_rows, counts=counts)]
    rows = with_features(docs, text_col, counts).withColumn("rejected_by", cascade(ordered))
    if counts:
        failed = F.lit(False)
        for r in some:
            failed = (failed | F.coalesce(r.fails, F.lit(False))) if r.base else failed
        rows = rows.withColumn("base_failed", failed)
    return rows.withColumn("kept", F.col("rejected_by").isNull()).drop("__text", "__words", "__lines")
