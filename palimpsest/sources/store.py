"""Page corpora as JSON: one nested row for each page, corrupt records set aside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = "struct<chunk_uid:string,heading_path:array<string>,text:string,summary:string,keywords:array<string>,synonyms:array<string>,qa:array<struct<q:string,a:string>>>"
PAGE = f"source string, title string, html_md5 string, gen_key string, generated_at string, schema_version string, needs_regen boolean, chunks array<{CHUNK}>"


def save(pages: DataFrame, path: str, mode: str = "overwrite") -> None:
    pages.write.mode(mode).json(path)


def replace(pages: DataFrame, path: str) -> None:
    """Put pages in the place of those of the same source, all at once.

    The new corpus is written beside the old one and takes its name when it is whole.
    """
    spark = pages.sparkSession
    jvm = spark.sparkContext._jvm
    there, fresh, old = (jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}{x}") for x in ("", "-next", "-old"))
    fs = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(there):
        kept = spark.read.schema(PAGE).json(path).join(pages.select("source"), "source", "left_anti")
        pages = kept.select(pages.columns).unionByName(pages)
    save(pages, fresh.toString())
    fs.delete(old, True)
    if fs.exists(there):
        fs.rename(there, old)
    fs.rename(fresh, there)
    fs.delete(old, True)


def load(spark: SparkSession, path: str, multiline: bool = False) -> tuple[DataFrame, DataFrame]:
    """(pages, corrupt): rows of PAGE in the order of their source, and the records that aren't any."""
    raw = spark.read.schema(f"{PAGE}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", multiline).json(path)
    bad = F.col("_corrupt").isNotNull() | F.col("source").isNull()
    return raw.where(~bad).drop("_corrupt").orderBy("source"), raw.where(bad).select("_corrupt")


def flatten(pages: DataFrame) -> DataFrame:
    """A row for each chunk: page columns, chunk_idx and the chunk's fields. Pages without chunks give none."""
    return pages.select("source", "title", F.posexplode("chunks").alias("chunk_idx", "c")).select("source", "title", "chunk_idx", "c.*")


def missing(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """(source): wanted pages that aren't stored."""
    return wanted.select("source").join(pages.select("source"), "source", "left_anti")


def log_failures(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)
