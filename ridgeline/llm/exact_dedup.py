"""Exact dedup against a persistent digest index, in DataFrame operations only.

The index is a table bucketed and sorted by the SHA-256 of the normalised text. New rows are hashed once; their
digests are grouped (with map-side partial aggregation, so a digest shared by a third of all rows reaches its reducer
as a handful of partial rows) and met with the index by one sort-merge join, which reads the index in its buckets,
without a shuffle. The digests that have no partner there, its anti-join, are appended in the same layout.

Every entry names the batch that brought it. A batch that is run again under its name, after a driver was lost between
the append and the output or in the midst of the append, finds its own entries and gives the verdicts that it would have
given. Without a name every call is new data, so documents that are delivered again are duplicates.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.shared import fresh_path, join_hot, materialize, same

#: Lets a scan of one file a bucket count as sorted, so that the join does not sort the index again.
_SORTED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


#: Entries that a bucket of a new index is made for, about (48 bytes each).
BUCKET_ROWS = 2_000_000


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


class DigestIndex:
    """A digest index at ``path``; ``buckets`` must stay the same over the life of an index. One writer at a time.

    Columns: ``digest`` (32 bytes), ``keep_id`` (id of the row that stays for it), ``batch`` (number of the batch that
    brought it). Any session opens an index by its path. Each batch adds a file to each bucket; with several files the
    scan still needs no shuffle but Spark sorts what it reads, until ``compacted`` writes one file a bucket again.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 32):
        self.spark, self.buckets = spark, buckets
        self.path = path or fresh_path(spark, "digest-index")
        self.table = "digest_index_" + hashlib.sha256(self.path.encode()).hexdigest()[:24]
        if not spark.catalog.tableExists(self.table):
            spark.sql(
                f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT, batch BIGINT) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'"
            )

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, novel: DataFrame) -> None:
        """Add entries, one file a bucket and sorted in it."""
        out = novel.select("digest", "keep_id", "batch").repartition(self.buckets, "digest")
        out.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.table)
        self.spark.catalog.refreshTable(self.table)

    def compacted(self, path: str | None = None) -> DigestIndex:
        """The same index with one file a bucket, at a new place; this one stays as it is until its owner drops it."""
        new = DigestIndex(self.spark, path, self.buckets)
        new.append(self.read())
        return new

    def dedup(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """Drop-or-keep verdicts for every row of ``docs``; digests new to the index are appended to it.

        Returns ``id_col, keep_id, group_size, kept, text_sha256``. ``group_size`` counts the rows of this batch with
        the digest. A digest that the index has from another batch keeps its old ``keep_id`` and none of this batch's
        rows stay. Of equal texts the smallest id stays; of rows that repeat even the id exactly one stays; a null id
        sorts first. Null and empty texts are equal to each other. Other columns of ``docs`` are not read. An empty
        table gives an empty result and leaves the index as it is.

        ``batch`` names the batch; give one, and the same one, to run it again. A batch without a name is new data.
        """
        rows = materialize(
            docs.select(
                F.col(id_col).cast("long").alias("id"),
                F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"),
                F.monotonically_increasing_id().alias("row"),
            ),
            "digests",
        )
        total = rows.count()
        name = batch if batch is not None else uuid.uuid4().hex
        number = int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "big", signed=True)
        groups = rows.groupBy("digest").agg(F.min(F.struct("id", "row")).alias("first"), F.count(F.lit(1)).alias("group_size"))
        index = self.read().select("digest", F.col("keep_id").alias("old_id"), F.col("batch").alias("old_batch"))
        before = self.spark.conf.get(_SORTED)
        self.spark.conf.set(_SORTED, "true")
        try:
            met = materialize(groups.join(index.hint("merge"), "digest", "left"), "digest-groups")
        finally:
            self.spark.conf.set(_SORTED, before)
        self.append(met.where("old_batch is null").select("digest", F.col("first.id").alias("keep_id"), F.lit(number).cast("long").alias("batch")))
        verdicts = met.select(
            "digest", "group_size", "first",
            F.when(F.col("old_batch").isNull(), F.col("first.id")).otherwise(F.col("old_id")).alias("keep_id"),
            F.coalesce(F.col("old_batch") == number, F.lit(True)).alias("own"),
        )
        return join_hot(rows, verdicts, "digest", "group_size", total).select(
            F.col("id").alias(id_col),
            "keep_id",
            "group_size",
            (F.col("own") & same(F.col("id"), F.col("first.id")) & (F.col("row") == F.col("first.row"))).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """``DigestIndex.dedup`` on the given index, or on a new one in the shared folder with buckets for as many rows."""
    if index is None:
        size = docs.select(id_col).count()
        index = DigestIndex(docs.sparkSession, buckets=max(32, -(-size // BUCKET_ROWS)))
    return index.dedup(docs, id_col, text_col, batch)
