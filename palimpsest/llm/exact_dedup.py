"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest. New documents are digested,
grouped by digest, anti-joined to the index by sort-merge and appended; groups that
the index has are logged beside it, in the same buckets, so that sizes and the best
row of a group can be told over all batches without a shuffle. All of it is
DataFrame code. The tables lie at a path of their own and are registered again by a
session that doesn't know them. A batch that is ingested again adds nothing to the
index itself.

Documents without an index of theirs go through a new one in BATCHES batches.

Defined cases: a null text counts as empty; texts are equal when identical after
deleting the characters space and U+0009 to U+000D; of equal texts the row with
the most code points stays, then the smallest doc_id (nulls last). Rows that
repeat a whole document (same doc_id and text) form one group like any copies,
and each of them gets its row of the assignment; exactly one of them is kept. An
empty table gives an empty result. Extra columns pass through.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import delete, files_exist, free_name, materialize, new_path

BLANKS = " \t\n\x0b\x0c\r"


def digest(text: Column) -> Column:
    """SHA-256 (hex) of the text without white space."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), BLANKS, "").cast("binary"), 256)


_ROW = "digest binary, keep_id {id}, n_chars bigint, keep_row bigint, group_size bigint"
#: Batches in which documents without an index are ingested.
BATCHES = 2


class DigestIndex:
    """Digests seen so far: (digest, keep_id, n_chars, keep_row, group_size).

    One row for each digest. The table is bucketed and sorted by digest, so an
    ingest shuffles only the new digests and merges them with the buckets.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = (path or new_path(spark, "digest-index")).rstrip("/")
        self.table = f"digest_index_{hashlib.md5(self.path.encode()).hexdigest()}"
        self.copies = f"{self.table}_copies"
        self.buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self._register()

    def _folder(self, table: str) -> str:
        return f"{self.path}/{'copies' if table == self.copies else 'digests'}"

    def _register(self) -> None:
        """Tables over files that another session has written."""
        if not files_exist(self.spark, f"{self.path}/buckets"):
            return
        self.buckets, kind = self.spark.read.parquet(f"{self.path}/buckets").first()
        for table in (self.table, self.copies):
            if not self.spark.catalog.tableExists(table) and files_exist(self.spark, self._folder(table)):
                self.spark.sql(f"CREATE TABLE {table} ({_ROW.format(id=kind)}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self._folder(table)}'")

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def _write(self, groups: DataFrame, table: str) -> None:
        if not files_exist(self.spark, f"{self.path}/buckets"):
            kind = groups.schema["keep_id"].dataType.simpleString()
            self.spark.range(1).select(F.lit(self.buckets).alias("buckets"), F.lit(kind).alias("kind")).coalesce(1).write.parquet(f"{self.path}/buckets")
        writer = groups.repartition(self.buckets, "digest").write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
        if self.spark.catalog.tableExists(table):
            writer.mode("append").saveAsTable(table)
        else:
            writer.option("path", self._folder(table)).saveAsTable(table)

    def ingest(self, digests: DataFrame) -> DataFrame:
        """Add (doc_id, n_chars, digest, row) rows; return the new groups.

        Groups whose digest the index already has are left out: their rows are
        copies of documents taken in earlier.
        """
        groups = _best(digests.withColumnsRenamed({"doc_id": "keep_id", "row": "keep_row"}).withColumn("group_size", F.lit(1).cast("long")))
        if not self.exists():
            self._write(groups, self.table)
            return self.spark.table(self.table)
        groups = materialize(groups, "groups")
        old = self.spark.table(self.table).select("digest").hint("merge")
        fresh = materialize(groups.join(old, "digest", "left_anti"), "fresh")
        known = materialize(groups.join(old, "digest", "left_semi"), "known")
        self._write(fresh, self.table)
        self._write(known, self.copies)
        return fresh

    def groups(self) -> DataFrame:
        """The groups over all batches, merged bucket by bucket."""
        rows = self.spark.table(self.table)
        if self.spark.catalog.tableExists(self.copies):
            more = _best(self.spark.table(self.copies)).select([F.col(c).alias(f"c_{c}") for c in rows.columns])
            both = rows.join(more.hint("merge"), F.col("digest") == F.col("c_digest"), "left")
            own, other = (F.struct((-F.col(f"{x}n_chars")).alias("n"), F.col(f"{x}keep_id").isNull().alias("z"), F.col(f"{x}keep_id").alias("id"), F.col(f"{x}keep_row").alias("row")) for x in ("", "c_"))
            best = F.when(F.col("c_digest").isNull() | (own <= other), own).otherwise(other)
            rows = both.select("digest", best.alias("best"), (F.col("group_size") + F.coalesce("c_group_size", F.lit(0))).alias("group_size"))
            rows = rows.select("digest", F.col("best.id").alias("keep_id"), (-F.col("best.n")).alias("n_chars"), F.col("best.row").alias("keep_row"), "group_size")
        return rows

    def drop(self) -> None:
        """Forget the index and delete its files."""
        for table in (self.table, self.copies):
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        delete(self.spark, self.path)


def _best(rows: DataFrame) -> DataFrame:
    """A row for each digest: the longest text, then the smallest id (nulls last)."""
    # Map-side combined: a digest gives one row a task, however many copies it has.
    order = F.struct((-F.col("n_chars")).alias("n"), F.col("keep_id").isNull().alias("z"), "keep_id", "keep_row")
    groups = rows.groupBy("digest").agg(F.min(order).alias("best"), F.sum("group_size").alias("group_size"))
    return groups.select("digest", "best.keep_id", (-F.col("best.n")).alias("n_chars"), "best.keep_row", "group_size")


def digests_of(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, digest and a row number that lasts, as it is written at once."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.length(text).cast("long").alias("n_chars"), F.unhex(digest(text)).alias("digest"))
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()), "digests")


def _ingested(rows: DataFrame, index: DigestIndex | None) -> DataFrame:
    """The groups of rows that weren't in the index before, as plain files.

    Both sides of a join with them are then dealt out anew, so that Spark can split
    a digest with very many rows.
    """
    if index is not None:
        old = index.exists()
        groups = index.ingest(rows)
        return groups if old else materialize(groups, "groups")
    index = DigestIndex(rows.sparkSession)
    for k in range(BATCHES):
        index.ingest(rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(BATCHES)) == k))
    groups = materialize(index.groups(), "groups")
    index.drop()
    return groups


def assign(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """A row for each document: which row of its group stays.

    Returns doc_id, keep_id, group_size, kept, text_sha256. Without an index the
    documents are judged among themselves, through a new index; with one, copies
    of what it holds have a null keep_id, group_size 0 and aren't kept.
    """
    rows = digests_of(docs)
    groups = _ingested(rows, index).drop("n_chars")
    return rows.join(groups.hint("merge"), "digest", "left").select(
        "doc_id",
        "keep_id",
        F.coalesce("group_size", F.lit(0)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The whole rows that stay, with the columns of docs."""
    rows = digests_of(docs)
    groups = _ingested(rows, index)
    same = rows.groupBy("digest", "doc_id", "n_chars").count()
    d, k, c, n, own = free_name(docs, "best_digest", "best_id", "best_chars", "n_same", "own_digest")
    best = groups.select(F.col("digest").alias(d), F.col("keep_id").alias(k), F.col("n_chars").alias(c))
    best = materialize(
        best.join(same, (F.col(d) == same.digest) & F.col(k).eqNullSafe(same.doc_id) & (F.col(c) == same.n_chars)).select(d, k, c, F.col("count").alias(n)),
        "best",
    )
    text = F.coalesce("text", F.lit(""))
    tagged = docs.withColumn(own, F.unhex(digest(text)))
    kept = tagged.join(best.hint("merge"), (F.col(own) == F.col(d)) & F.col("doc_id").eqNullSafe(F.col(k)) & (F.length(text) == F.col(c)))
    # A row that is there several times over, doc_id and all, stays once.
    once = kept.where(F.col(n) == 1).select(docs.columns)
    again = kept.where(F.col(n) > 1).dropDuplicates([d]).select(docs.columns)
    return once.unionByName(again)
