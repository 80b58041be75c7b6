"""The operators over the driver's tables: name -> function of (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    conversation_repair, decontaminate, kneser_ney, language, line_crf, line_templates, mixing, prefix_trie, privacy,
    secret_scan, simhash, suffix_dedup, url_filter)
from .common import is_remainder, read


def op1_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = privacy.sanitise(read(spark, sf_dir, "documents"))
    return privacy.report(found).withColumnRenamed("id", "doc_id")


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = kneser_ney.learn(kneser_ney.training_rows(docs))
    return kneser_ney.score(docs, model).select(
        F.col("id").alias("doc_id"), is_remainder("id", 10, 0).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score", "perplexity")


def op3_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines dropped from every document, and a hash of what is left."""
    cut = line_templates.drop_recurring(read(spark, sf_dir, "documents"))
    return cut.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"),
                      F.col("__kept").alias("kept"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(read(spark, sf_dir, "documents"))
    return secret_scan.report(found).withColumnRenamed("id", "doc_id")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language.learn(language.training_rows(docs))
    return language.identify(docs, model).select(
        F.col("id").alias("doc_id"), is_remainder("id", 4, 2).alias("held_out"), "lang_pred", "score",
        F.size("mixture").alias("n_languages"))


def op6_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    field = line_crf.learn(docs, read(spark, sf_dir, "labels"))
    return line_crf.rate(docs, field).drop("key").withColumnRenamed("id", "doc_id")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return mixing.mix(docs).select("doc_id", "source", "epoch", "block_order", "doc_order")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "cosine", "common", "answer")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"),
                        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = read(spark, sf_dir, "conversations")
    ids = convs.select(F.col("conv_id").alias("conv")).distinct()
    return conversation_repair.audit(conversation_repair.damaged(convs), ids)


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_spans(read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return found.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"),
                        F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.turn_rows(read(spark, sf_dir, "conversations"))
    return prefix_trie.trie(prefix_trie.with_shared_starts(turns), turns.select("conv").distinct())


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run
    return run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_privacy, op2_kneser_ney, op3_line_templates, op4_secrets, op5_language, op6_line_quality,
    op7_mixing, op8_url_filter, op9_decontamination, op10_simhash, op11_conversation_repair, op12_suffix_dedup, op13_prefix_trie, pipeline)}

# Statistics, hashes and models that SQL can't state; tests/llm compares them with plain Python.
ORACLES: dict[str, str] = {}
