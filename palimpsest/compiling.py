"""The compile run: scan pages, find what changed, generate chunks in batches, keep the state.

A batch's chunks are written, then its state; a run that is interrupted loses the
batch at work only, and the next one goes on with what has no stored result.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import reports
from palimpsest.operators import generation, incremental
from palimpsest.operators.manifest import now_iso
from palimpsest.sources import markdown, store

STATE = "rel string, md5 string, gen_key string, needs_regen boolean"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def state(spark: SparkSession, path: str) -> DataFrame:
    """The newest entry of each page."""
    if not _exists(spark, f"{path}/state"):
        return spark.createDataFrame([], STATE)
    rows = spark.read.schema(f"{STATE}, at long").parquet(f"{path}/state")
    return rows.groupBy("rel").agg(F.max_by(F.struct("md5", "gen_key", "needs_regen"), "at").alias("s")).select("rel", "s.*").where("md5 is not null")


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """The newest chunks of each page: (source, chunk_idx, chunk_uid, text, needs_regen, problems, calls)."""
    rows = spark.read.parquet(f"{path}/chunks")
    last = rows.groupBy("source").agg(F.max("at").alias("at"))
    return rows.join(last, ["source", "at"], "left_semi").drop("at")


def plan(pages: DataFrame, path: str, gen_key: str, regen: bool = False, force: bool = False, only: str | None = None, max_files: int | None = None) -> DataFrame:
    """(rel) of the pages to do: changed ones, those of another gen_key, and with regen those to be made anew."""
    spark = pages.sparkSession
    old = state(spark, path)
    stale = F.col("gen_key") != gen_key
    done = old.where(~stale & ~F.col("needs_regen") if regen else ~stale)
    return incremental.plan_work(incremental.diff(pages.select("rel", "md5"), old), done, force, only, max_files)


def run(pages: DataFrame, path: str, gen_key: str, make_client: Callable = lambda: generation.local_client, batches: int = 4, workers: int | None = None, progress: Callable[[str], None] | None = None, stop_after: int | None = None, **what) -> dict:
    """Compile pages (rel, md5, html) into the corpus at path; the totals of the run.

    workers bounds the tasks that ask a model at a time.
    """
    spark, began = pages.sparkSession, time.time()
    todo = plan(pages, path, gen_key, **what)
    work = pages.join(todo, "rel", "left_semi").withColumn("batch", F.pmod(F.xxhash64("rel"), F.lit(batches)))
    total, at, n_done, n_chunks = todo.count(), int(began * 1000), 0, 0
    for k in range(batches if stop_after is None else min(stop_after, batches)):
        part = work.where(F.col("batch") == k)
        rendered = markdown.extract(part, "rel").select(F.col("rel").alias("source"), "markdown")
        rendered = rendered.repartition(workers) if workers else rendered
        rows = generation.generate(rendered, make_client).withColumn("at", F.lit(at))
        rows.write.mode("append").parquet(f"{path}/chunks")
        made = spark.read.parquet(f"{path}/chunks").where(F.col("at") == at).groupBy("source").agg(F.max("needs_regen").alias("needs_regen"))
        fresh = part.join(made, part.rel == made.source).select("rel", "md5", F.lit(gen_key).alias("gen_key"), "needs_regen", F.lit(at).alias("at"))
        fresh.write.mode("append").parquet(f"{path}/state")
        if progress:
            n_done, n_chunks = n_done + part.count(), spark.read.parquet(f"{path}/chunks").where(F.col("at") == at).count()
            progress(reports.progress_line(min(n_done, total), total, time.time() - began, n_chunks, f"batch {k + 1} of {batches}"))
    gone = incremental.diff(pages.select("rel", "md5"), state(spark, path)).where("status = 'removed'").select("rel")
    gone.select("rel", *[F.lit(None).cast(t).alias(c) for c, t in (("md5", "string"), ("gen_key", "string"), ("needs_regen", "boolean"))], F.lit(at).alias("at")).write.mode("append").parquet(f"{path}/state")
    out = totals(spark.read.parquet(f"{path}/chunks").where(F.col("at") == at)).first().asDict() if _exists(spark, f"{path}/chunks") else {}
    return {"planned": total, "seconds": round(time.time() - began, 3), "at": now_iso(), **out}


def totals(rows: DataFrame) -> DataFrame:
    """One row: pages, first_try, repaired, fallback, chunks and calls of generated rows."""
    per = rows.groupBy("source").agg(F.max("needs_regen").alias("regen"), F.max("calls").alias("calls"), F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(~F.col("regen") & (F.col("calls") <= 1)).alias("first_try"), F.count_if(~F.col("regen") & (F.col("calls") > 1)).alias("repaired"),
        F.count_if("regen").alias("fallback"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"),
    )


def store_corpus(rows: DataFrame, path: str) -> None:
    """Chunks as nested JSON pages, in the form of store.PAGE."""
    none = F.array().cast("array<string>")
    chunk = F.struct("chunk_uid", none.alias("heading_path"), "text", F.lit("").alias("summary"), none.alias("keywords"), none.alias("synonyms"), F.array().cast("array<struct<q:string,a:string>>").alias("qa"))
    pages = rows.groupBy("source").agg(F.max("needs_regen").alias("needs_regen"), F.transform(F.array_sort(F.collect_list(F.struct("chunk_idx", chunk.alias("c")))), lambda x: x.c).alias("chunks"))
    store.save(pages, path)


def wipe(spark: SparkSession, folders: list[str], base: str) -> list[str]:
    """Delete generated folders, after all of them are known not to be the base, the working folder or a root."""
    guarded = {Path(base).resolve(), Path.cwd().resolve()}
    for f in folders:
        p = Path(f.removeprefix("file://")).resolve()
        if p in guarded or p == p.parent or any(g.is_relative_to(p) for g in guarded):
            raise ValueError(f"refusing to delete {f}: it must be a folder of generated files alone")
    done = []
    for f in folders:
        if _exists(spark, f):
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
            done.append(f)
    return done


def audit(rows: DataFrame, pages: DataFrame) -> dict:
    """What the corpus lacks: pages without chunks, chunks of pages that are gone, chunks to be made anew."""
    have, want = rows.select("source").distinct(), pages.select(F.col("rel").alias("source"))
    return {"pages": want.count(), "without_chunks": want.join(have, "source", "left_anti").count(), "gone": have.join(want, "source", "left_anti").count(), "needs_regen": rows.where("needs_regen").select("source").distinct().count()}


def to_json(report: dict) -> str:
    return json.dumps(report, ensure_ascii=False, sort_keys=True)
