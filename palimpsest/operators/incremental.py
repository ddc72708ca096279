"""Incremental processing: what changed between two snapshots, and what to do about it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(now: DataFrame, before: DataFrame) -> DataFrame:
    """(rel, status): added, changed, removed or unchanged, of snapshots (rel, md5)."""
    b = before.select("rel", F.col("md5").alias("old"))
    both = now.select("rel", "md5").join(b, "rel", "full_outer")
    status = F.when(F.col("old").isNull(), "added").when(F.col("md5").isNull(), "removed").when(F.col("old") != F.col("md5"), "changed").otherwise("unchanged")
    return both.select("rel", status.alias("status"))


def plan_work(changes: DataFrame, stored: DataFrame, force: bool = False, only: str | None = None, max_files: int | None = None) -> DataFrame:
    """(rel): pages to process: added, changed, and unchanged ones without a stored result.

    force takes every page that is there. only takes one, and fails if it isn't there.
    """
    there = changes.where(F.col("status") != "removed")
    if only is not None:
        one = there.where(F.col("rel") == only).select("rel")
        if one.isEmpty():
            raise ValueError(f"no such page: {only}")
        return one
    if force:
        work = there.select("rel")
    else:
        lost = there.where("status = 'unchanged'").join(stored.select("rel"), "rel", "left_anti").select("rel")
        work = there.where("status in ('added', 'changed')").select("rel").unionByName(lost)
    return work if max_files is None else work.orderBy("rel").limit(max_files)


def merge_state(old: DataFrame, new: DataFrame) -> DataFrame:
    """State rows (rel, md5, gen_key, needs_regen): new ones replace those of the same page."""
    return old.join(new.select("rel"), "rel", "left_anti").select("rel", "md5", "gen_key", "needs_regen").unionByName(new.select("rel", "md5", "gen_key", "needs_regen"))


def finalize(state: DataFrame, stored: DataFrame, changes: DataFrame) -> DataFrame:
    """The state without removed pages and without entries that have no stored result."""
    gone = changes.where("status = 'removed'").select("rel")
    return state.join(gone, "rel", "left_anti").join(stored.select("rel"), "rel", "left_semi")


def missing_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks (chunk_uid, text) without a vector of the same text; vectors has (chunk_uid, text_md5)."""
    want = chunks.withColumn("text_md5", F.md5("text"))
    return want.join(vectors.select("chunk_uid", "text_md5"), ["chunk_uid", "text_md5"], "left_anti")
