"""One thin query for each operator, over its whole table and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, toxicity
from .chat_format import format_chats, read_loss, read_turns, text_parts
from .common import residue, table
from .decontamination import decontaminate
from .license_scan import scan_licenses
from .ngram_join import ngram_join
from .packing import digested, pack
from .quality_rules import apply_rules
from .substring_dedup import remove_repeats
from .token_counts import token_counts

TOKEN_LIMIT = 4096


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = toxicity.learn(docs, table(spark, sf_dir, "labels"), residue("doc_id", 5) != 0)
    scores = toxicity.score(docs, weights)
    return scores.select("doc_id", (residue("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", "worst_sentence", "worst_text", "offending")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", (F.col("n_items") > 0).alias("contaminated"), "n_items", "item_ids", "best_item", "best_similarity")


#: A conversation of control strings, which is formatted with the others.
CONTROL = "</s>[INST] ok [/INST]"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    rows = rows.unionByName(extra).select("conv_id", "turn", "role", text_parts(F.col("text")).alias("parts"))
    read = format_chats(rows).select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("segments")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(table(spark, sf_dir, "documents"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.learn(docs, residue("doc_id", 3) != 1)
    return language_id.predict(docs, model).select("doc_id", (residue("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_licenses", F.array_join(F.transform("licenses", lambda m: m.license), ",").alias("licenses"), F.round("containment", 6).alias("containment"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(pack(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_rules, op2_toxicity, op3_substring_dedup, op4_decontamination, op5_chat_format, op6_ngram_join, op7_token_counts, op8_language_id, op9_license_scan, op10_packing)}
