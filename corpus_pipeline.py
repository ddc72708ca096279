"""A corpus pipeline: quality, exact copies, near copies, benchmark leaks, mixing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps of docs, with
the columns of documents; the last adds how often each document is used.

Defined cases: what the operators define for nulls, empty and very long texts, ties
and repeated rows holds for each stage; equal rows are exact copies, of which one
stays; an empty table gives an empty result; extra columns of documents pass through
all stages, and the last stage's column is _epochs where epochs is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import decontam, exact_dedup, mixing, omh, quality
from palimpsest.llm.common import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what is probably of low quality or toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = quality.classify(docs, labels)
    return out.where(F.col(out.columns[-1])).select(docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one of equal texts."""
    return exact_dedup.deduplicate(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one of each class of near-duplicates."""
    return omh.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each leaf's share of half the tokens, by the target weights; adds epochs."""
    return mixing.mix(docs, targets=mixing.TARGETS, domain=mixing.numbered_domain(F.col("source")))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("order MinHash near-dedup", near_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: The models and the alignment have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
