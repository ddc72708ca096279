"""Reading HTML pages: directories of files or a table, capped and filtered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(rel, md5, html) of all *.html files below the folders; those that don't exist are left out."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = [p for p in paths if jvm.org.apache.hadoop.fs.Path(p).getFileSystem(conf).exists(jvm.org.apache.hadoop.fs.Path(p))]
    if not there:
        return spark.createDataFrame([], "rel string, md5 string, html string")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").option("recursiveFileLookup", True).load(there)
    return files.select(F.col("path").alias("rel"), F.md5("content").alias("md5"), F.decode("content", "UTF-8").alias("html"))


def count(spark: SparkSession, paths: list[str]) -> int:
    """Number of pages; no file is opened."""
    return scan(spark, paths).select("rel").count()


def cap(text: Column, most: int = 24000) -> Column:
    """The text cut to so many characters, with a line that says how many are missing."""
    n = F.length(text)
    note = F.concat(F.lit("\n[... page truncated: "), (n - most).cast("string"), F.lit(" more chars not shown ...]"))
    return F.when(n > most, F.concat(F.substring(text, 1, most), note)).otherwise(text)


def load_chunks(spark: SparkSession, paths: list[str], max_files: int | None = None, least: int = 50, most: int = 800, overlap: int = 120) -> DataFrame:
    """(source, chunk_idx, text) of HTML folders without a compile run: plain text of pages, packed.

    Pages of fewer than so many characters are left out; max_files takes the first by path.
    """
    from palimpsest.functions import text as T
    from palimpsest.sources import markdown

    found = scan(spark, paths)
    found = found if max_files is None else found.orderBy("rel").limit(max_files)
    clean = F.pandas_udf(lambda x: x.map(markdown.clean), "string")
    rows = found.select(F.col("rel").alias("source"), clean("html").alias("text")).where(F.length("text") >= least)
    return rows.select("source", F.posexplode(T.pack_paragraphs(F.col("text"), most, overlap)).alias("chunk_idx", "text"))
