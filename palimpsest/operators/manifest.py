"""What an index was made of, and whether it still fits: manifests, guards and rebuilds."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import index as ix


def now_iso() -> str:
    """The time in UTC to the second, as manifests state it."""
    return datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def of_chunks(chunks: DataFrame, key: str = "chunk_uid", page: str = "source") -> DataFrame:
    """One row: n_chunks, n_pages and sha, a digest that doesn't depend on the order of rows.

    Digests of (key, text) are combined by exclusive or, in partial sums.
    """
    each = F.md5(F.concat(F.col(key).cast("string"), F.lit(":"), F.coalesce("text", F.lit(""))))
    part = F.conv(F.substring(each, 1, 15), 16, 10).cast("long")
    out = chunks.agg(F.count(F.lit(1)).alias("n_chunks"), F.countDistinct(page).alias("n_pages"), F.bit_xor(part).alias("x"))
    return out.select("n_chunks", "n_pages", F.lpad(F.lower(F.hex(F.coalesce("x", F.lit(0)))), 15, "0").alias("sha"))


def read(spark: SparkSession, path: str) -> dict | None:
    """The manifest of an index, or None if there is none."""
    try:
        row = spark.read.json(f"{path}/manifest").first()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return json.loads(row.body)


def write(spark: SparkSession, path: str, body: dict) -> None:
    spark.range(1).select(F.lit(json.dumps(body)).alias("body")).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def differences(saved: dict, now: dict, keys: tuple[str, ...] = ("n_chunks", "n_pages", "sha")) -> list[str]:
    """What a manifest states otherwise than the chunks that are there."""
    return [f"{k}: the index has {saved.get(k)}, the corpus {now.get(k)}" for k in keys if saved.get(k) != now.get(k)]


def drift(saved: dict, params: dict) -> list[str]:
    """Settings that were others when the index was built: warnings, not errors."""
    old = saved.get("params", {})
    return [f"{k} was {old[k]!r} when the index was built and is {v!r} now" for k, v in sorted(params.items()) if k in old and old[k] != v]


def misaligned(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """(key, missing): vectors without a chunk and chunks without a vector, all of them and not a sample."""
    v, c = vectors.select("key", F.lit(True).alias("v")), chunks.select("key", F.lit(True).alias("c"))
    both = v.join(c, "key", "full_outer").where(F.col("v").isNull() | F.col("c").isNull())
    return both.select("key", F.when(F.col("c").isNull(), "no chunk").otherwise("no vector").alias("missing"))


def vector_errors(meta: dict | None, n_chunks: int) -> list[str]:
    """Why vectors can't be used: none, partly built, or not one for each chunk."""
    if meta is None:
        return ["there are no vectors"]
    if not meta.get("complete", False):
        return [f"the vectors are built in part: {meta.get('count', 0)} of {n_chunks}"]
    return [f"{meta['count']} vectors for {n_chunks} chunks"] if meta["count"] != n_chunks else []


def build(docs: DataFrame, path: str, gen_key: str, params: dict | None = None, force: bool = False) -> str:
    """Build an index at path if it isn't up to date: "built" or "up to date".

    An index of another gen_key isn't overwritten without force. docs is (doc_id,
    source, text); params go to index.build().
    """
    spark, params = docs.sparkSession, params or {}
    now = of_chunks(docs, "doc_id").first().asDict()
    saved = read(spark, path)
    if saved and saved["gen_key"] != gen_key and not force:
        raise ValueError(f"the index at {path} is of {saved['gen_key']!r}, not of {gen_key!r}; force replaces it")
    if saved and not force and not differences(saved, now) and saved.get("params") == params:
        return "up to date"
    ix.build(docs, **params).save(path)
    write(spark, path, {**now, "gen_key": gen_key, "params": params, "built_at": now_iso()})
    return "built"
