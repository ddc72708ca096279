"""Structured Streaming: incremental ingest of pages and search of a stream of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.operators import fusion, search
from palimpsest.operators.index import Index


def upsert_pages(state_path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: keeps the latest text of each page in a Parquet table of versions.

    A batch that comes again writes the same folder, so nothing is doubled.
    """

    def write(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy("rel").agg(F.max(F.struct("ts", "text")).alias("m")).select("rel", "m.ts", "m.text", F.md5("m.text").alias("md5"))
        latest.write.mode("overwrite").parquet(f"{state_path}/batch={number}")

    return write


def current(spark: SparkSession, state_path: str) -> DataFrame:
    """(rel, text, md5): the newest version of each page."""
    rows = spark.read.option("basePath", state_path).parquet(state_path)
    return rows.groupBy("rel").agg(F.max(F.struct("ts", "batch", "text", "md5")).alias("m")).select("rel", "m.text", "m.md5")


def ingest(pages: DataFrame, state_path: str, checkpoint: str) -> StreamingQuery:
    """Run a stream of (rel, ts, text) into the table until its input is used up."""
    return pages.writeStream.foreachBatch(upsert_pages(state_path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def search_stream(queries: DataFrame, index: Index, out: str, checkpoint: str, k: int = 8) -> StreamingQuery:
    """Answer a stream of (qid, query): each micro-batch is searched as one."""

    def answer(batch: DataFrame, number: int) -> None:
        found = search.bm25(index, batch.select("qid", "query"))
        hits = fusion.per_source(found.join(index.docs.select("doc_id", "source"), "doc_id")).where(F.col("rank") < k)
        hits.write.mode("overwrite").json(f"{out}/batch={number}")

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts by window and event type with a watermark; the source's timestamps have no zone."""
    e = events.withColumn("at", F.col("ts").cast("timestamp"))
    e = e.withWatermark("at", late) if events.isStreaming else e
    return e.groupBy(F.window("at", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
