"""Join helpers: broadcast only behind a measured size."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Bytes (of the rows as JSON) above which a side is never broadcast; beyond it the join shuffles both sides.
BROADCAST_MAX_BYTES = 64 * 1024 * 1024


def checked_broadcast(small: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Materialise ``small`` in the shared checkpoint folder, measure it, broadcast it when bounded.

    The checkpoint keeps the measure and the join on the same rows (no second
    evaluation) and survives executor loss. Above ``max_bytes`` the plain
    DataFrame is returned and Spark picks a shuffle join (AQE may still
    switch strategy at run time).
    """
    frozen = freeze(small)
    size = frozen.agg(F.sum(F.octet_length(F.to_json(F.struct(*frozen.columns))))).first()[0] or 0
    return F.broadcast(frozen) if size <= max_bytes else frozen


def freeze(df: DataFrame) -> DataFrame:
    """Materialise a narrow intermediate that several branches of one plan reuse.

    Written once to the shared checkpoint folder (reliable, survives executor
    loss); the lineage is cut, so each branch reads the written rows instead of
    recomputing (and re-shuffling) them.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet below ``spark.checkpoint.dir`` and read back.

    For rows with long columns that several branches read: each branch reads only
    its own columns, and no branch computes them again.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/treeloom-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
