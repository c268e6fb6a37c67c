"""Exact deduplication against a persistent digest index (operator 4, DataFrame functions only).

The index is a table bucketed and sorted by digest. A batch of documents is
reduced to one candidate per digest (map-side combined, so a group of copies
that holds a third of the batch is one row per map task), candidates already in
the index are removed by an anti join on the bucketed digest (the index side is
neither shuffled nor sorted again), and the rest are appended.

Defined cases: null text counts as empty; texts are equal when they are identical
once every character of ``[\\x20\\x09-\\x0D]`` is deleted; of equal texts in a batch the
row with most code points stays, then the smallest doc_id (null ids last). A
digest that an earlier batch holds keeps the earlier row. Rows repeated with the
same doc_id and text share one fate in ``decisions``; ``kept_documents`` returns
one of them. An empty batch gives no rows. Other columns pass through unread.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, prepare, text_or_empty, written

# The bytes deleted before texts are compared: space, \t \n \v \f \r.
BLANKS = " \t\n\x0b\x0c\r"
# Groups of at least this many copies may be looked up by broadcast, and at most HOT_GROUPS of them.
HOT_SIZE = 256
HOT_GROUPS = 1000

INDEX_SCHEMA = "digest string, keep_id bigint, n_chars bigint, group_size bigint, batch bigint"


def text_digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the text without blanks, over its UTF-8 bytes."""
    return F.sha2(F.translate(text, BLANKS, "").cast("binary"), 256)


class DigestIndex:
    """A bucketed table ``(digest, keep_id, n_chars, group_size, batch)`` in the session's warehouse."""

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None):
        self.spark = prepare(spark)
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        if not spark.catalog.tableExists(self.name):
            self.buckets = buckets or partitions(spark)
            self._append(spark.createDataFrame([], INDEX_SCHEMA))
        else:
            detail = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {self.name}").collect()}
            self.buckets = int(detail["Num Buckets"])

    def _append(self, rows: DataFrame) -> None:
        (
            rows.repartition(self.buckets, "digest")
            .write.mode("append")
            .format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .saveAsTable(self.name)
        )

    def entries(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, digests: DataFrame, batch: int) -> None:
        """Append the digests of ``(doc_id, n_chars, digest)`` that the index does not hold yet.

        A batch number that is already in the index is not applied again, so a
        repeated call after a failure changes nothing.
        """
        if not self.entries().where(F.col("batch") == batch).isEmpty():
            return
        candidates = digests.groupBy("digest").agg(
            F.max(
                F.struct(F.col("n_chars"), F.col("doc_id").isNotNull().alias("has"), (-F.col("doc_id")).alias("neg"))
            ).alias("best"),
            F.count(F.lit(1)).alias("group_size"),
        )
        fresh = candidates.join(self.entries().select("digest").hint("merge"), "digest", "left_anti")
        self._append(
            fresh.select(
                "digest",
                (-F.col("best.neg")).alias("keep_id"),
                F.col("best.n_chars").alias("n_chars"),
                "group_size",
                F.lit(batch).cast("bigint").alias("batch"),
            )
        )

    def lookup(self, digests: DataFrame) -> DataFrame:
        """``digests`` with the entry of each row's digest.

        Digests of very many copies would put all their rows in one task of a
        join; there can be only a few of them (size at least a thousandth of the
        index's rows, so at most ``HOT_GROUPS``), and those are broadcast.
        """
        entries = self.entries().select("digest", "keep_id", "group_size", "batch")
        total = entries.agg(F.sum("group_size")).first()[0] or 0
        least = max(HOT_SIZE, -(-int(total) // HOT_GROUPS))
        hot = F.col("group_size") >= least
        named = entries.withColumnRenamed("digest", "d")
        marked = digests.join(
            F.broadcast(named.where(hot)), F.col("digest") == F.col("d"), "left"
        )
        frequent = marked.where(F.col("d").isNotNull()).drop("d")
        rest = marked.where(F.col("d").isNull()).select(*digests.columns)
        return frequent.unionByName(rest.join(entries.where(~hot).hint("merge"), "digest"))


def digest_table(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_chars, digest)`` of every document, written once."""
    text = text_or_empty()
    return written(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.length(text).cast("bigint").alias("n_chars"),
            text_digest(text).alias("digest"),
        ),
        "digests",
    )


def decisions(docs: DataFrame, index: DigestIndex, batch: int = 0) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, one row per document, dropped ones too."""
    digests = digest_table(docs)
    index.add(digests, batch)
    return index.lookup(digests.select("doc_id", "digest")).select(
        "doc_id",
        "keep_id",
        "group_size",
        ((F.col("batch") == batch) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def kept_documents(docs: DataFrame, index: DigestIndex, batch: int = 0) -> DataFrame:
    """The documents of this batch that stay, with all their columns, one row per digest."""
    index.add(digest_table(docs), batch)
    winners = index.entries().where(F.col("batch") == batch).select(
        F.col("digest").alias("__w"), F.col("keep_id").alias("__keep")
    )
    rows = docs.withColumn("__digest", text_digest(text_or_empty()))
    # joined on digest and id together: copies of one digest are not one join key
    same = (rows["__digest"] == winners["__w"]) & rows["doc_id"].cast("bigint").eqNullSafe(winners["__keep"])
    return rows.join(winners.hint("merge"), same).dropDuplicates(["__w", "__keep"]).select(*docs.columns)
