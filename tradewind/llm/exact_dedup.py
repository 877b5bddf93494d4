"""Exact dedup by a persistent digest index.

The index is a Parquet table bucketed and sorted by digest, with one row for each
distinct text ever seen. New rows are aggregated to distinct digests (map-side first, so
a group of copies that holds a third of all rows shuffles as a few partial rows) and
written; the groups are anti-joined to the index by a sort-merge join that does not move
the index, and appended. A batch then reads back its own groups' entries by such a join:
however large the index is, only rows of the batch shuffle.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm.common import dropped_at_exit, shared_dir, staged

#: Buckets of a new index; about one for each 256 MB of index rows at the target size.
BUCKETS = 64


class DigestIndex:
    """Distinct text digests at `path`, in buckets sorted by digest.

    Rows: digest (SHA-256, binary), keep_id (the row that stays), group_size (rows of the
    batch that brought the text). The folder alone holds the state; any later session
    opens it again under a name of its own.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT, group_size BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        """The index, read by its buckets: joins on digest need no shuffle of it."""
        return self.spark.table(self.table)

    def append(self, groups: DataFrame) -> None:
        """Add those groups (digest, keep_id, group_size) whose digest the index lacks."""
        new = groups.hint("merge").join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        ready = new.repartition(self.buckets, "digest").sortWithinPartitions("digest")
        ready.select("digest", "keep_id", "group_size").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)

    def lookup(self, groups: DataFrame) -> DataFrame:
        """(digest, keep_id, group_size) of those groups that the index has; groups hold each
        digest once. The index is read in its buckets and order, groups are brought to them."""
        return groups.select("digest").hint("merge").join(self.rows().hint("merge"), "digest")


def text_digest(text: str = "text") -> F.Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Decide for each row of docs whether it stays, and add its text to the index.

    Texts are equal when all bytes are; null counts as the empty text. Of equal new texts
    the largest id stays (null ids count as smallest; with no id at all the keep_id is
    null). A text that the index had before stays with the id kept then, and all new rows
    of it go. Rows with the same id and text stay or go together. Empty input gives no
    rows. Returns doc_id, keep_id, group_size, kept, text_sha256; other columns of docs
    are not read.
    """
    spark = docs.sparkSession
    if index is None:
        index = DigestIndex(spark, f"{shared_dir(spark)}/digests-{uuid.uuid4().hex}", _buckets(spark))
        dropped_at_exit(spark, index.path, index.table)
    digests = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_digest(text).alias("digest"))
    groups = digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # Written first: the anti-join would otherwise move below the aggregation, and all rows of
    # a digest would meet in one task.
    groups = staged(groups, "groups")
    index.append(groups)
    # Written too: rows join a plain table, so that adaptive execution can split a digest
    # which holds much of the input. Buckets would fix the partitions of that join.
    found = staged(index.lookup(groups), "found")
    return digests.join(found, "digest", "left").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _buckets(spark: SparkSession) -> int:
    """As many buckets as shuffle partitions, so that a first load writes one file each."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
