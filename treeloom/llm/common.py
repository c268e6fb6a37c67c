"""What the operators of this subpackage share: session preparation, tables, cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package


def prepare(spark: SparkSession) -> SparkSession:
    """Shared checkpoint folder set and the package importable in Python workers."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet below ``spark.checkpoint.dir`` and read back.

    Cuts the lineage on storage that every executor reaches, so a lost executor
    never recomputes what stands before, and columns are still pruned when the
    rows are read again. Only narrow tables are kept this way.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/treeloom-llm-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def row_key(*names: Column) -> Column:
    """Digest of a row's doc_id (null or not), text and ``names``, never null: equal for copies only."""
    text = F.md5(text_or_empty().cast("binary"))
    parts = [F.col("doc_id").cast("bigint"), text, *names]
    marked = F.to_json(F.struct(*[p.cast("string").alias(f"k{i}") for i, p in enumerate(parts)]))
    return F.md5(marked.cast("binary"))


def let(value: Column, body) -> Column:
    """``body`` over ``value`` evaluated once per row (a lambda variable, not a repeated expression)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions that the session asks for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
