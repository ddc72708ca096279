"""Retrieval quality: ranks of gold sources, MRR, hits, recall, NDCG, gates and displacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KS = (1, 3, 5, 10)
#: Passages are broadcast up to this many.
BROADCAST_ROWS = 20_000


def relevance(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """(arm, qid, rank, g): hits whose source contains a gold string. gold is (qid, gold array)."""
    wanted = gold.select("qid", F.posexplode("gold").alias("g", "needle"))
    return hits.join(wanted, "qid").where(F.contains(F.col("source"), F.col("needle"))).select("arm", "qid", "rank", "g")


def containing(docs: DataFrame, passages: DataFrame, words: int = 3) -> DataFrame:
    """(qid, doc_id): texts that contain a passage. docs is (doc_id, text), passages (qid, passage).

    A passage's second to fourth word (at blanks) are whole words of the text, too,
    so that both are joined by their hash and then compared. Shorter passages are
    compared with all texts.
    """
    p = passages.withColumn("w", F.split("passage", " ", -1)).withColumn("long", F.size("w") >= words + 2)
    anchor = lambda w, i: F.xxhash64(*[F.get(w, i + j) for j in range(words)])
    keyed = p.where("long").select("qid", "passage", anchor(F.col("w"), F.lit(1)).alias("key"))
    w = F.col("w")
    runs = F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - words, F.lit(0))), lambda i: anchor(w, i)))
    d = docs.where(F.col("text").isNotNull())
    if keyed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        keyed = F.broadcast(keyed)
    maybe = d.select("doc_id", F.split("text", " ", -1).alias("w")).select("doc_id", F.explode(runs).alias("key")).join(keyed.select("qid", "key"), "key").select("qid", "doc_id").distinct()
    found = maybe.join(d, "doc_id").join(p.select("qid", "passage"), "qid").where(F.contains("text", F.col("passage"))).select("qid", "doc_id")
    few = p.where("not long").select("qid", "passage")
    short = d.join(few, F.contains(F.col("text"), F.col("passage"))).select("qid", "doc_id")
    return found.unionByName(short).distinct()


def evaluate(hits: DataFrame, gold: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """A row for each arm: MRR, hit@k and recall@k over all queries of gold, found or not.

    hits is (arm, qid, rank from 0, source).
    """
    found = relevance(hits, gold)
    per = found.groupBy("arm", "qid").agg(F.min("rank").alias("first"), *[F.size(F.collect_set(F.when(F.col("rank") < k, F.col("g")))).alias(f"c{k}") for k in ks])
    arms = hits.select("arm").distinct()
    all_ = arms.crossJoin(gold.select("qid", F.size("gold").alias("n_gold"))).join(per, ["arm", "qid"], "left")  # arms are a handful
    out = all_.groupBy("arm").agg(
        F.round(F.avg(F.coalesce(1.0 / (F.col("first") + 1), F.lit(0.0))), 6).alias("mrr"),
        *[F.round(F.avg(F.when(F.col("first") < k, 1.0).otherwise(0.0)), 6).alias(f"hit_{k}") for k in ks],
        *[F.round(F.avg(F.coalesce(F.col(f"c{k}") / F.col("n_gold"), F.lit(0.0))), 6).alias(f"recall_{k}") for k in ks],
        F.count(F.lit(1)).alias("n_queries"),
    )
    return out


def gate(results: DataFrame, coverage: Column, min_mrr: float = 0.875, min_hit10: float = 0.917, min_coverage: float = 0.95) -> DataFrame:
    """PASS or FAIL by MRR and hit@10; DEFER while too little of the corpus is indexed."""
    ok = (F.col("mrr") >= min_mrr) & (F.col("hit_10") >= min_hit10)
    return results.withColumn("verdict", F.when(coverage < min_coverage, "DEFER").when(ok, "PASS").otherwise("FAIL"))


def ndcg(graded: DataFrame, k: int = 10) -> DataFrame:
    """(qid, dcg, ndcg) of rows (qid, doc_id, rank from 0, rel); an ideal of 0 gives 0."""
    gain = F.pow(F.lit(2.0), F.col("rel")) - 1
    best = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("rel"), "doc_id")) - 1
    rows = graded.withColumn("best", best)
    part = lambda at: F.sum(F.when(F.col(at) < k, gain / F.log2(F.col(at) + 2)).otherwise(0.0))
    out = rows.groupBy("qid").agg(part("rank").alias("dcg"), part("best").alias("ideal"))
    return out.select("qid", "dcg", F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0).alias("ndcg"))


def displacement(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """(qid, displaced): how many of the first k documents of two arms differ."""
    top = lambda x, name: x.where(F.col("rank") < k).groupBy("qid").agg(F.collect_set("doc_id").alias(name))
    both = top(a, "x").join(top(b, "y"), "qid", "full_outer")
    none = F.array().cast("array<bigint>")
    x, y = F.coalesce("x", none), F.coalesce("y", none)
    return both.select("qid", F.floor((F.size(F.array_except(x, y)) + F.size(F.array_except(y, x))) / 2).cast("long").alias("displaced"))


def coverage(indexed: DataFrame, pages: DataFrame, key: str, prefer: str | None = None) -> DataFrame:
    """One row: pages, indexed pages, their share, and which engine to use; prefer (new or legacy) decides if given."""
    if prefer not in (None, "new", "legacy"):
        raise ValueError(f"unknown engine {prefer!r}")
    n = pages.select(key).distinct().join(indexed.select(key).distinct().withColumn("in", F.lit(1)), key, "left")
    out = n.agg(F.count(F.lit(1)).alias("n_pages"), F.count("in").alias("n_indexed"))
    share = F.when(F.col("n_pages") > 0, F.col("n_indexed") / F.col("n_pages")).otherwise(0.0)
    out = out.withColumn("coverage", F.round(share, 6))
    if prefer:
        return out.withColumn("engine", F.lit(prefer))
    return out.withColumn("engine", F.when(F.col("n_indexed") == 0, "nothing_built").when(F.col("coverage") >= 0.95, "new").otherwise("legacy"))
