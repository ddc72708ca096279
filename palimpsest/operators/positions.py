"""Consecutive numbers over a global order without one task holding all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.shared import materialize


def numbered(df: DataFrame, order: list[str], name: str, parts: int | None = None) -> DataFrame:
    """Adds the row's place in the order, from 0.

    Rows are dealt out by ranges of the order, numbered in their range, and moved
    on by the sizes of the ranges before.
    """
    parts = parts or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = materialize(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row for each range.
    starts = sizes.select("_part", (F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("_start"))
    local = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn("_local", local).join(F.broadcast(starts), "_part").withColumn(name, (F.col("_start") + F.col("_local")).cast("long")).drop("_part", "_local", "_start")


def numbered_within(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Adds the row's place within its group, from 0, however large a group is."""
    rows = materialize(numbered(df, [group, *order], "_at"), "numbered")
    first = rows.groupBy(group).agg(F.min("_at").alias("_first")).withColumnRenamed(group, "_group")
    joined = rows.join(first, F.col(group).eqNullSafe(F.col("_group")))
    return joined.withColumn(name, F.col("_at") - F.col("_first")).drop("_at", "_first", "_group")


def page_sizes(chunks: DataFrame, page: str = "source") -> DataFrame:
    """(page, n_chunks, chars) of chunks (page, text)."""
    return chunks.groupBy(page).agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("text")).alias("chars"))


def read_pages(chunks: DataFrame, wanted: DataFrame, max_chars: int, page: str = "source", gap: str = "\n\n") -> DataFrame:
    """(page, missing, body): pages put together from their chunks, cut after max_chars.

    chunks is (page, doc_id, text). Only as many chunks as can show are gathered,
    each being at least as long as the gap after it.
    """
    own = chunks.join(F.broadcast(wanted.select(page).distinct()), page, "left_semi")
    sizes = own.groupBy(page).agg((F.sum(F.length("text")) + (F.count(F.lit(1)) - 1) * len(gap)).alias("size"))
    head = numbered_within(own.select(page, "doc_id", "text"), page, ["doc_id"], "_pos").where(F.col("_pos") * len(gap) <= max_chars)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", F.substring("text", 1, max_chars + 1).alias("text")))), lambda x: x.text), gap)
    body = head.groupBy(page).agg(text.alias("body")).join(sizes, page)
    more = F.format_string("\n[... page truncated: %d more chars not shown ...]", F.col("size") - max_chars)
    cut = F.when(F.col("size") > max_chars, F.concat(F.substring("body", 1, max_chars), more)).otherwise(F.col("body"))
    return wanted.join(body, page, "left").select(page, F.col("size").isNull().alias("missing"), cut.alias("body"))
