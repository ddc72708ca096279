"""The inverted index as four tables.

postings(term, doc_id, tf), terms(term, df, cf), doc_stats(doc_id, dl) and
coll(n, n_docs, avgdl, total), the last with one row. Words are expanded to terms
once for each distinct word of the corpus and joined back, and counts are combined
before every shuffle. The counts are written once; all four tables derive from them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.shared import materialize

#: A table is broadcast up to this many rows.
BROADCAST_ROWS = 100_000


@dataclass
class Index:
    """Tables of an inverted index; docs has doc_id, source and text."""

    docs: DataFrame
    postings: DataFrame
    terms: DataFrame
    doc_stats: DataFrame
    coll: DataFrame

    def cache(self) -> Index:
        for name in ("postings", "terms", "doc_stats", "coll"):
            setattr(self, name, getattr(self, name).cache())
        return self

    def save(self, path: str, buckets: int = 32) -> None:
        """Write as Parquet, postings sorted by term within ranges of terms."""
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        self.postings.repartitionByRange(buckets, "term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
        self.terms.repartitionByRange(max(1, buckets // 8), "term").write.mode("overwrite").parquet(f"{path}/terms")
        self.doc_stats.write.mode("overwrite").parquet(f"{path}/doc_stats")
        self.coll.coalesce(1).write.mode("overwrite").parquet(f"{path}/coll")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        return cls(*[spark.read.parquet(f"{path}/{t}") for t in ("docs", "postings", "terms", "doc_stats", "coll")])


def term_counts(docs: DataFrame, text: Column | None = None, strip_trailing_dot: bool = False) -> DataFrame:
    """(doc_id, term, tf) of the texts' terms."""
    text = F.col("text") if text is None else text
    words = docs.select("doc_id", F.explode(T.raw_words(text, strip_trailing_dot)).alias("word")).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    words = materialize(words, "words")
    terms = words.select("word").distinct().select("word", F.explode(T.expand_word(F.col("word"))).alias("term")).where(T.is_term(F.col("term")))
    return words.join(terms, "word").groupBy("doc_id", "term").agg(F.sum("n").alias("tf"))


def path_counts(docs: DataFrame, boost: int) -> DataFrame:
    """(doc_id, term, tf) of the terms of the sources, each so many times."""
    return docs.select("doc_id", F.explode(T.path_terms(F.col("source"))).alias("term")).select("doc_id", "term", F.lit(boost).cast("long").alias("tf"))


def build(docs: DataFrame, path_boost: int = 3, text: Column | None = None, max_share: float = 0.5, prune_df: int | None = None, strip_trailing_dot: bool = False) -> Index:
    """Index docs (doc_id, source, text).

    Lengths count every term; terms in over max_share of the documents, or of
    punctuation only, or over prune_df documents, are then left out.
    """
    counts = term_counts(docs, text, strip_trailing_dot)
    if path_boost:
        counts = counts.unionByName(path_counts(docs, path_boost)).groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"))
    counts = materialize(counts, "counts")
    stats = docs.select("doc_id").join(counts.groupBy("doc_id").agg(F.sum("tf").alias("dl")), "doc_id", "left").select("doc_id", F.coalesce("dl", F.lit(0)).cast("long").alias("dl"))
    all_terms = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    keep = (F.col("df") <= F.col("n") * max_share) & ~F.col("term").rlike(r"^\p{P}+$")
    if prune_df is not None:
        keep = keep & (F.col("df") <= prune_df)
    stats = materialize(stats, "doc_stats")
    coll = stats.agg((F.max("doc_id") + 1).alias("n"), F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"), F.sum("dl").alias("total"))
    terms = all_terms.join(F.broadcast(coll.select("n")), F.lit(True)).where(keep).select("term", "df", "cf")  # coll is one row
    terms = materialize(terms, "terms")
    return Index(docs, counts.join(terms.select("term"), "term"), terms, stats, coll)
