"""Fusion of ranked lists (qid, doc_id, score, rank), rank from 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ranked(scores: DataFrame, k: int | None = None, score: str = "score") -> DataFrame:
    """Adds rank, best first, ties by doc_id; keeps the first k of each query.

    The bare row number is filtered, so that each task keeps its first k before the shuffle.
    """
    out = scores.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc(score), F.asc_nulls_last("doc_id"))))
    out = out if k is None else out.where(F.col("rank") <= k)
    return out.withColumn("rank", F.col("rank") - 1)


def minmax(scores: DataFrame, name: str = "norm") -> DataFrame:
    """Scores scaled to 0..1 within each query; 1 where all are equal."""
    w = W.partitionBy("qid")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return scores.withColumn(name, F.when(hi - lo < 1e-12, F.lit(1.0)).otherwise((F.col("score") - lo) / (hi - lo)))


def rrf(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (k + rank)."""
    parts = [x.select("qid", "doc_id", (1.0 / (F.col("rank") + k)).alias("part")) for x in lists]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return ranked(both.groupBy("qid", "doc_id").agg(F.round(F.sum("part"), 12).alias("score")))


def linear(first: DataFrame, second: DataFrame, alpha: float = 0.5) -> DataFrame:
    """alpha of the first list's scaled score and the rest of the second's; a missing one is 0."""
    a = minmax(first, "a").select("qid", "doc_id", "a")
    b = minmax(second, "b").select("qid", "doc_id", "b")
    both = a.join(b, ["qid", "doc_id"], "full_outer")
    return ranked(both.select("qid", "doc_id", (F.coalesce("a", F.lit(0.0)) * alpha + F.coalesce("b", F.lit(0.0)) * (1 - alpha)).alias("score")))


def blend(first: DataFrame, second: DataFrame, alpha: float = 0.5) -> DataFrame:
    """The first list re-ranked: scaled scores blended, and a hundredth of each reciprocal rank.

    second holds scores for the documents of first only.
    """
    rr = lambda c: 0.01 / (F.col(c) + 60)
    a = minmax(first, "a").select("qid", "doc_id", "a", F.col("rank").alias("ra"))
    b = minmax(ranked(second), "b").select("qid", "doc_id", "b", F.col("rank").alias("rb"))
    both = a.join(b, ["qid", "doc_id"], "left")
    score = F.col("a") * alpha + F.coalesce("b", F.lit(0.0)) * (1 - alpha) + rr("ra") + F.coalesce(rr("rb"), F.lit(0.0))
    return ranked(both.select("qid", "doc_id", score.alias("score")))


def rescored(first: DataFrame, second: DataFrame | None, sources: DataFrame, alpha: float = 0.7, cap: int | None = 1, k: int | None = None) -> DataFrame:
    """The evaluation's fusion: hits are capped by source before the second scores are scaled, and no rank counts.

    Without second scores, or with alpha 1 or more, the first list's order stays.
    """
    named = first.join(sources.select("doc_id", "source"), "doc_id")
    kept = per_source(named, cap)
    if second is not None and alpha < 1:
        a = minmax(first, "a").select("qid", "doc_id", "a")
        held = second.join(kept.select("qid", "doc_id"), ["qid", "doc_id"], "left_semi")
        b = minmax(held, "b").select("qid", "doc_id", "b")
        both = kept.select("qid", "doc_id").join(a, ["qid", "doc_id"]).join(b, ["qid", "doc_id"], "left")
        kept = ranked(both.select("qid", "doc_id", F.round(F.col("a") * alpha + F.coalesce("b", F.lit(0.0)) * (1 - alpha), 9).alias("score")))
    out = kept.select("qid", "doc_id", "score", "rank")
    return out if k is None else out.where(F.col("rank") < k)


def per_source(hits: DataFrame, cap: int | None = 1, by: str = "source") -> DataFrame:
    """The first cap hits of each source in each query, in the same order; 0 or None for all."""
    if not cap:
        return hits
    seen = F.row_number().over(W.partitionBy("qid", by).orderBy("rank"))
    kept = hits.withColumn("_seen", seen).where(F.col("_seen") <= cap).drop("_seen")
    return kept.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("rank")) - 1)
