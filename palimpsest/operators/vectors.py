"""Embeddings: models as functions, stores with what they are made of, and builds that resume.

An embedder is a function from a column of texts to a column of vectors. One of
hashed trigrams is shipped; others are models of the caller's or need a package or a
server that is looked for.
"""

from __future__ import annotations

import importlib.util
import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import udfs

#: Texts that a model gets at a time.
BATCH = 64


@dataclass
class Embedder:
    """A model: its name, its length of vectors and what makes them. Queries get a prefix, documents none."""

    model: str
    dim: int
    embed: Callable[[Column], Column]
    query_prefix: str = ""


def of_function(model: str, dim: int, make: Callable[[], Callable[[list[str]], np.ndarray]], query_prefix: str = "") -> Embedder:
    """An embedder of a function from texts to rows; make() is called once in each task."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = make()
        for texts in batches:
            said = texts.fillna("").tolist()
            rows = [r for i in range(0, len(said), BATCH) for r in np.asarray(f(said[i : i + BATCH]), dtype="float32")]
            yield pd.Series(rows, dtype=object)

    return Embedder(model, dim, lambda c: F.pandas_udf(run, "array<float>")(c), query_prefix)


def get_embedder(name: str, dim: int = 384, model: str = "", url: str = "http://127.0.0.1:11434", timeout: float = 2.0) -> Embedder | None:
    """none, hash, st (a sentence-transformers model) or server (an embedding server); None if it can't be had."""
    if name == "none":
        return None
    if name == "hash":
        return Embedder("hash", dim, udfs.hash_embedder(dim))
    if name == "st":
        if importlib.util.find_spec("sentence_transformers") is None:
            return None

        def load():
            from sentence_transformers import SentenceTransformer

            return SentenceTransformer(model).encode

        return of_function(model, dim, load)
    if name == "server":

        def ask(texts: list[str]) -> np.ndarray:
            body = json.dumps({"model": model, "input": texts}).encode()
            with urllib.request.urlopen(urllib.request.Request(f"{url}/api/embed", body, {"Content-Type": "application/json"}), timeout=300) as r:
                return np.array(json.load(r)["embeddings"])

        try:
            urllib.request.urlopen(url, timeout=timeout).close()
        except (urllib.error.URLError, OSError):
            return None
        return of_function(model, dim, lambda: ask)
    raise ValueError(f"unknown embedder {name!r}")


def unit(v: Column) -> Column:
    """A vector scaled to length one; a vector of zeros stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0).cast("float"))


def encode(rows: DataFrame, embedder: Embedder, text: str = "text", queries: bool = False, normalize: bool = True) -> DataFrame:
    """rows with a column embedding."""
    said = F.concat(F.lit(embedder.query_prefix), F.coalesce(text, F.lit(""))) if queries else F.coalesce(text, F.lit(""))
    out = rows.withColumn("embedding", embedder.embed(said))
    return out.withColumn("embedding", unit(F.col("embedding"))) if normalize else out


def save(vectors: DataFrame, path: str, model: str, dim: int, normalized: bool, complete: bool = True, mode: str = "overwrite") -> dict:
    """Write vectors, then what they are; a store whose meta is missing or not complete is a part."""
    spark = vectors.sparkSession
    vectors.write.mode(mode).parquet(f"{path}/rows")
    meta = {"model": model, "dim": dim, "count": spark.read.parquet(f"{path}/rows").count(), "normalized": normalized, "complete": complete}
    spark.range(1).select(F.lit(json.dumps(meta)).alias("body")).coalesce(1).write.mode("overwrite").json(f"{path}/meta")
    return meta


def load_meta(spark: SparkSession, path: str) -> dict | None:
    try:
        return json.loads(spark.read.json(f"{path}/meta").first().body)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def load(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(vectors, meta) of a complete store."""
    meta = load_meta(spark, path)
    if meta is None or not meta["complete"]:
        raise ValueError(f"no complete vectors at {path}")
    return spark.read.parquet(f"{path}/rows"), meta


def build(chunks: DataFrame, path: str, embedder: Embedder, batches: int = 8, progress: Callable[[int, int], None] | None = None, stop_after: int | None = None) -> dict:
    """Embed chunks (chunk_uid, text) into the store at path; what is there already is kept.

    Work is cut into batches by hash, each written at once. A build that broke off
    goes on where it stopped: chunks whose text has a vector are left out. Vectors of
    another model or length are thrown away, and so are, at the end, those of chunks
    that are gone or changed. stop_after ends the build after so many batches.
    """
    spark = chunks.sparkSession
    meta = load_meta(spark, path)
    want = chunks.select("chunk_uid", "text", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))
    keep = meta is not None and (meta["model"], meta["dim"]) == (embedder.model, embedder.dim)
    if not keep:
        empty = encode(want.limit(0), embedder).select("chunk_uid", "text_md5", "embedding")
        save(empty, path, embedder.model, embedder.dim, True, complete=False)
    for k in range(batches if stop_after is None else min(stop_after, batches)):
        have = spark.read.parquet(f"{path}/rows").select("chunk_uid", "text_md5")
        part = want.where(F.pmod(F.xxhash64("chunk_uid"), F.lit(batches)) == k).join(have, ["chunk_uid", "text_md5"], "left_anti")
        meta = save(encode(part, embedder).select("chunk_uid", "text_md5", "embedding"), path, embedder.model, embedder.dim, True, complete=False, mode="append")
        if progress:
            progress(k + 1, batches)
    if stop_after is not None and stop_after < batches:
        return meta
    rows = spark.read.parquet(f"{path}/rows")
    current = rows.join(want.select("chunk_uid", "text_md5"), ["chunk_uid", "text_md5"], "left_semi")
    n = want.count()
    if meta["count"] != n:  # vectors of chunks that are gone
        save(current, f"{path}/next", embedder.model, embedder.dim, True)
        rows = spark.read.parquet(f"{path}/next/rows")
        return save(rows, path, embedder.model, embedder.dim, True)
    return save(rows.limit(0), path, embedder.model, embedder.dim, True, mode="append")
