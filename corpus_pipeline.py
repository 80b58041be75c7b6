"""From raw documents to a training mix: five stages, each written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language, line_templates, mixing, simhash
from tidemark.llm.common import read
from tidemark.session import shared_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language that holds a third of the text go; NULL and empty texts have none."""
    model = language.learn(language.training_rows(docs))
    return language.keep_identified(docs, model)


def drop_template_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, and documents of which hardly anything is left.

    Needs a column ``n_chars``, set anew where lines went.  NULL and empty texts stay as they
    are; repeated rows are one document.
    """
    cut = line_templates.drop_recurring(docs).filter("__kept")
    changed = F.col("__n_dropped") > 0
    return cut.withColumn("n_chars", F.when(changed, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))) \
        .select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by fingerprints at three bits or fewer, that with the smallest id stays.

    NULL and empty texts have one fingerprint, so one of them stays; so does one of equal rows.
    """
    return simhash.keep_one(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; NULL and empty texts stay, as do all without items."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass that takes a document, with its place in the order.

    Texts without a word are never taken by a budget; repeated rows are taken alike.
    """
    return mixing.mix(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_template_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("source_mixing", mix_sources),
]

# Trained models, hashes and a latent space: not SQL. Tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return docs
