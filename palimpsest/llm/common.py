"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of ASCII letters, digits or any non-ASCII characters.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The complement of WORD, to split at.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    The cluster names it in spark.checkpoint.dir. Only where that is unset (a
    local test session) a temporary folder is made and set.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by the cluster")
        named = tempfile.mkdtemp(prefix="palimpsest-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/palimpsest/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write to the shared folder and read back, which cuts the lineage."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized frame that nothing needs any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/palimpsest/" in folder:
            delete(df.sparkSession, folder)


def _path(spark: SparkSession, name: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, name: str) -> None:
    """Delete a folder of any store that Spark reads."""
    path, store = _path(spark, name)
    store.delete(path, True)


def files_exist(spark: SparkSession, name: str) -> bool:
    path, store = _path(spark, name)
    return store.exists(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, so that lengths and other letters stay."""
    return F.translate(text, _UPPER, _LOWER)


def words(text: Column) -> Column:
    """The words of a text, A-Z lowered; null counts as empty.

    Splitting at the gaps leaves an empty first or last piece where the text
    begins or ends with a gap; those are dropped.
    """
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP)
    return F.filter(parts, lambda w: w != "")


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like the wanted ones that the frame doesn't have yet."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out
