"""Per-root statistics (ops 31, 32): one partial+final hash aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as TX
from .inspect import ContentOptions, windowed


def project_stats(inspected: DataFrame, nodes: DataFrame, opts: ContentOptions | None = None,
                  roots: DataFrame | None = None) -> DataFrame:
    """(root, files, dirs, lines, size).

    lines = lines of the windowed text of text files (markers count as lines);
    size = bytes of every kept file, binary and oversize ones too; dirs = kept
    directories including empty ones. ``roots`` (e.g. the input files' root
    column) adds zero rows so that roots with nothing kept are reported too. File rows and directory rows are unioned
    and summed in a single aggregation keyed by root (map-side partial sums, so
    a hot root costs one row per task before the shuffle).
    """
    lines = F.when(F.col("kind") == "text", TX.line_count(windowed(F.col("text"), opts))).otherwise(F.lit(0))
    per_file = inspected.select(
        "root",
        F.lit(1).cast("bigint").alias("f"),
        F.lit(0).cast("bigint").alias("d"),
        lines.cast("bigint").alias("l"),
        F.col("size").cast("bigint").alias("s"),
    )
    per_dir = nodes.filter(F.col("is_dir")).select(
        "root",
        F.lit(0).cast("bigint").alias("f"),
        F.lit(1).cast("bigint").alias("d"),
        F.lit(0).cast("bigint").alias("l"),
        F.lit(0).cast("bigint").alias("s"),
    )
    parts = per_file.unionByName(per_dir)
    if roots is not None:  # roots whose files were all excluded still report zeros
        zero = F.lit(0).cast("bigint")
        parts = parts.unionByName(
            roots.select("root", zero.alias("f"), zero.alias("d"), zero.alias("l"), zero.alias("s"))  # collapses map-side
        )
    return (
        parts
        .groupBy("root")
        .agg(
            F.sum("f").alias("files"),
            F.sum("d").alias("dirs"),
            F.sum("l").alias("lines"),
            F.coalesce(F.sum("s"), F.lit(0)).cast("bigint").alias("size"),
        )
    )
