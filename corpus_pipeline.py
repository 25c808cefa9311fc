"""From raw documents to packed sequences: each stage works on all that the one before it kept.

All stages but the last keep the columns of documents, extra ones too, whatever their names. Null and empty texts go in the
first stage; very long texts are taken whole; of equal rows one stays (the second stage), of linked documents the one with
the least id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadencia.llm import language_id
from cadencia.llm.common import WRITTEN, by_bucket, drop_written, heaps_trimmed, removed, saved, shared_folder, table
from cadencia.llm.decontamination import RESULTS, decontaminate
from cadencia.llm.ngram_join import ngram_join
from cadencia.llm.packing import pack
from cadencia.llm.substring_dedup import remove_repeats

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Input columns that are named like a column of an operator wait under this and their name.
KEPT = "__kept_"


def like(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows with the columns of docs, whatever they are."""
    return rows.select(*(F.col(KEPT + c if KEPT + c in rows.columns else c).alias(c) for c in docs.columns))


def aside(docs: DataFrame, *names: str) -> DataFrame:
    """docs whose columns of these names wait."""
    return docs.withColumnsRenamed({c: KEPT + c for c in docs.columns if c.lower() in names})


def fresh(stage: Stage) -> Stage:
    """The stage, which begins with the heap given back that the stages before it have left in the executors."""

    @wraps(stage)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        heaps_trimmed(spark)
        return stage(spark, docs, sf_dir)

    return begun


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the corpus's languages: null texts and texts without a letter go, and those that no language has
    at least half of the probability of."""
    model = language_id.learn(docs, F.lit(True))
    verdict = language_id.judge(aside(docs, "lang_pred", "score"), model)
    known = verdict.filter((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= 0.5))
    return like(known, docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of linked documents; of repeated rows (same id and text), one."""
    groups = saved(ngram_join(docs).select("doc_id", "component_id"), shared_folder(spark), "groups")
    gone = groups.filter("component_id <> doc_id").select("doc_id").distinct()
    repeated = groups.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    # only rows whose id falls into the bucket of one of these are shuffled
    some, rest = by_bucket(docs, gone.unionByName(repeated), "doc_id")
    return like(rest.unionByName(some.join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"])), docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur elsewhere too; those of which nothing is left go."""
    rows = remove_repeats(aside(docs, "n_words", "n_removed", "kept_text"))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    rows = rows.filter("kept_text <> ''").withColumn("text", text)
    return like(rows.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else rows, docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no near copy of a benchmark item."""
    rows = decontaminate(aside(docs, *RESULTS), table(spark, sf_dir, "benchmark"))
    return like(rows.filter("n_items = 0"), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", fresh(known_language)),
    ("ngram_join", fresh(one_of_each_group)),
    ("substring_dedup", fresh(without_repeats)),
    ("decontamination", fresh(without_benchmark)),
    ("packing", fresh(packed)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written and read again. A stage's input and what it wrote on the way are
    deleted when its output is written; the last one's output stays, until common.drop_written()."""
    folder = shared_folder(spark)
    before = len(WRITTEN)
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), folder, name)
        drop_written(spark, before)
        if last:
            removed(spark, f"{folder}/{last}")
        last = name
    return docs


#: Language models, connected components and packing aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
