"""Exact deduplication against a persistent digest index (built-in functions only).

The index is a Parquet table, bucketed and sorted by digest, with one row per distinct text ever
seen: ``digest`` (SHA-256), ``keep_id`` (the row that stays) and ``batch`` (the batch that brought
it). A batch is reduced to one row per digest, anti-joined to the index by sort-merge (the index
side is not shuffled) and what is new is appended.

The number of buckets belongs to the index: it is stored beside the data and read when an index is
opened, whatever the session's settings are; asking for another is an error. A batch has a name:
a run that is repeated under the same name, after a loss at any point, gives the same answers and
appends nothing twice; the same rows under another name are all known. Batches are added one after
the other, not at the same time.

Defined results: a null text counts as empty; a null id is never preferred to another; of equal
texts inside a batch the largest id stays; a text that an earlier batch brought keeps the id stored
there and no row of this batch is kept, even one that bears that id; rows that repeat both id and
text all carry ``kept`` (:func:`deduplicate` leaves one of them); an empty batch changes nothing.
Extra columns, whatever their names, are ignored here and kept by :func:`deduplicate`.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._runtime import durable, join_unique, partitions, read_table, unused

VERSION = 1
#: Beside the data; names with an underscore are no data files to Spark.
ABOUT = "_digest_index.json"


class DigestIndex:
    """A digest index under a table name; ``path`` places it outside the warehouse and outlives the session's catalog."""

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None, path: str | None = None):
        self.spark, self.name, self.path = spark, name, path
        stored = self._of_table() if spark.catalog.tableExists(name) else self._of_folder() if path else None
        if stored is not None and buckets is not None and stored != buckets:
            raise ValueError(f"the index {name} has {stored} buckets, not {buckets}")
        self.buckets = stored or buckets or partitions(spark)
        if path and stored is None:
            self._describe()
        place = f"LOCATION '{path}'" if path else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS {place}")

    def _of_table(self) -> int:
        rows = self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.name}").collect()
        found = [r["data_type"] for r in rows if r["col_name"].strip().lower() == "num buckets"]
        if not found or not {"digest", "keep_id", "batch"} <= {r["col_name"] for r in rows}:
            raise ValueError(f"the table {self.name} is no digest index")
        return int(found[0])

    def _file(self, name: str):
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), folder, jvm.org.apache.hadoop.fs.Path(folder, name)

    def _of_folder(self) -> int | None:
        """Buckets of an index that lies at the path; None if nothing does."""
        fs, folder, file = self._file(ABOUT)
        if not fs.exists(folder) or not len(fs.listStatus(folder)):
            return None
        if not fs.exists(file):
            raise ValueError(f"{self.path} holds files, but no digest index")
        stream = fs.open(file)
        try:
            about = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        if about["version"] != VERSION:
            raise ValueError(f"the index at {self.path} is of version {about['version']}, not {VERSION}")
        return int(about["buckets"])

    def _describe(self) -> None:
        fs, _, file = self._file(ABOUT)
        out = fs.create(file, False)
        out.write(bytearray(json.dumps({"version": VERSION, "buckets": self.buckets}).encode()))
        out.close()

    def read(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def append(self, rows: DataFrame, batch: str) -> None:
        """Add digest, keep_id as of ``batch``; what is added appears as a whole."""
        out = rows.select("digest", F.col("keep_id").cast("long").alias("keep_id"), F.lit(batch).alias("batch"))
        # One file per bucket and batch: the shuffle already deals rows by digest.
        out.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def dedup_batch(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """Deduplicate a batch and append what is new to ``index``.

    One row per input row: doc_id, digest, keep_id, group_size (rows of this batch with that text)
    and kept: the text is new with this batch, and the row is the one that stays. ``batch`` names the
    batch (by default it gets a new name).
    """
    batch = batch or uuid.uuid4().hex
    rows = durable(docs.select(F.col(id_col).alias("doc_id"), digest_of(F.col(text_col)).alias("digest")))
    groups = durable(rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    # An earlier attempt at this batch may have appended its digests already; they stay as they are.
    index.append(groups.hint("merge").join(index.read().select("digest").hint("merge"), "digest", "left_anti"), batch)
    known = index.read().select("digest", F.col("keep_id").alias("stays"), (F.col("batch") == batch).alias("is_new"))
    settled = durable(groups.hint("merge").join(known.hint("merge"), "digest").select("digest", F.col("stays").alias("keep_id"), "group_size", "is_new"))
    out = join_unique(rows, settled, ["digest"], groups.select("digest", F.col("group_size").alias("n")))
    return out.select("digest", "doc_id", "keep_id", "group_size", (F.col("is_new") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"))


def deduplicate(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """``docs`` without the rows whose text another row (or an earlier batch) has; all columns stay as they are."""
    own = index or DigestIndex(docs.sparkSession, f"quire_digests_{uuid.uuid4().hex}")
    decided = dedup_batch(docs, own, id_col, text_col, batch)
    digest, stays, number = unused(docs.columns, "digest", "stays", "number")
    kept = durable(decided.where("kept").groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias(number)))
    if index is None:
        own.drop()
    repeated = not kept.where(F.col(number) > 1).isEmpty()
    kept = kept.select(F.col("digest").alias(digest), F.col("doc_id").alias(stays))
    out = docs.alias("d").join(kept.alias("k"), (digest_of(F.col(f"d.`{text_col}`")) == F.col(f"k.{digest}")) & F.col(f"d.`{id_col}`").eqNullSafe(F.col(f"k.{stays}")), "left_semi")
    if repeated:  # rows that repeat both id and text
        out = out.withColumn(digest, digest_of(F.col(text_col))).dropDuplicates([digest, id_col]).drop(digest)
    return out


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = DigestIndex(spark, f"quire_digests_{uuid.uuid4().hex}")
    out = durable(
        dedup_batch(read_table(spark, sf_dir, "documents"), index).select(
            "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
        )
    )
    index.drop()
    return out


OP10_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
