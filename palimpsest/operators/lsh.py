"""Candidates among 64-bit signatures by bands, and classes of near signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def band_values(h: Column, bands: int = 16, bits: int = 4) -> Column:
    """The values of a signature's bands, lowest bits first."""
    mask = (1 << bits) - 1
    return F.array(*[F.shiftrightunsigned(h, bits * i).bitwiseAND(mask) for i in range(bands)])


def banded(signatures: DataFrame, bands: int = 16, bits: int = 4) -> DataFrame:
    """(doc_id, h, band, value): the index that candidates() joins. New rows are added by a union."""
    return signatures.select("doc_id", "h", F.posexplode(band_values(F.col("h"), bands, bits)).alias("band", "value"))


def removed(index: DataFrame, ids: DataFrame) -> DataFrame:
    """The index without some documents."""
    return index.join(ids.select("doc_id"), "doc_id", "left_anti")


def candidates(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, doc_id): other documents that share a band with a query. queries is banded(), too."""
    q = queries.select(F.col("doc_id").alias("qid"), "band", "value")
    return q.join(index.select("doc_id", "band", "value"), ["band", "value"]).where(F.col("qid") != F.col("doc_id")).select("qid", "doc_id").distinct()


def near_signatures(signatures: DataFrame, most: int = 3) -> DataFrame:
    """(a, b, distance): different signatures (h) that differ in so many bits at most.

    Of most + 1 bands one agrees. Equal signatures are one row, so that groups of
    copies make no pairs.
    """
    bits = 64 // (most + 1)
    keys = banded(signatures.select("h").distinct().withColumn("doc_id", F.col("h")), most + 1, bits)
    a = keys.select(F.col("h").alias("a"), "band", "value").alias("x")
    b = keys.select(F.col("h").alias("b"), "band", "value").alias("y")
    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    same = (F.col("x.band") == F.col("y.band")) & (F.col("x.value") == F.col("y.value"))
    return a.join(b, same & (F.col("a") < F.col("b")) & (distance <= most)).select("a", "b", distance.alias("distance")).distinct()


def simhash_classes(signatures: DataFrame, most: int = 3) -> DataFrame:
    """(doc_id, class_id, h, n_links): the first document of equal signatures, and how many other signatures are near."""
    pairs = near_signatures(signatures, most)
    links = pairs.select(F.explode(F.array("a", "b")).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n_links"))
    groups = signatures.groupBy("h").agg(F.min("doc_id").alias("class_id")).join(links, "h", "left")
    return signatures.join(groups, "h").select("doc_id", "class_id", "h", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
