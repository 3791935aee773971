"""The corpus pipeline: stages over the documents table, each written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pagerisk.llm import bpe, lines, minhash, mixing, repetition
from pagerisk.session import attach, gathered, materialise

#: Partitions of texts that a task writes, and tasks a core that stay; the next stage reads file by file.
_EACH, _PER_CORE = 4, 8


def reject_repetitive(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    attach(spark)
    return repetition.judge(docs, drop_rejected=True)


def drop_line_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs; those with no line left go.

    n_chars follows the text.
    """
    attach(spark)
    out = lines.dedup_lines(docs)
    out = out.filter("n_lines = 0 OR n_deleted < n_lines")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return gathered(out.select(*[F.col(f"`{name}`") for name in docs.columns]), _EACH, _PER_CORE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four in five five-word shingles."""
    attach(spark)
    return gathered(minhash.drop_near_duplicates(docs), _EACH, _PER_CORE)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the fair mix of their sources takes them."""
    attach(spark)
    return gathered(mixing.mix(docs), _EACH, _PER_CORE)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document; the text gives way to its decoded form."""
    attach(spark)
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = bpe.encode_decode(docs, path, ("ids", "n_tokens", "decoded"))
    return out.drop("text").withColumnRenamed("decoded", "text")


STAGES = [
    ("quality_rules", reject_repetitive),
    ("line_dedup", drop_line_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode),
]
# Banding, suffix arrays and BPE are not expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = len(STAGES) - 1
    for place, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < last:
            docs = materialise(docs, f"pipeline-{name}")
    return docs
