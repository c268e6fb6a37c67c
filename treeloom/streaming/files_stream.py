"""The operators on a streaming ``files`` table (Structured Streaming).

The reference makes one bounded pass; here files keep arriving (new Parquet
parts of a ``files`` table). Row-wise operators need no change: path filters
(hidden names, globs), inspection, content windows and the credential scan
are stateless. Per-root statistics are stateful aggregations kept in the
state store (checkpointed, so a restarted query resumes exactly):

* files / lines / size: ``groupBy(root).agg(sum ...)`` in update mode;
* directories: every file's ancestor paths, de-duplicated by
  ``dropDuplicates(root, dir)`` (stateful), then counted per root.

Directories come from the file paths (and explicit directory rows), so an
arriving file can add directories but never remove one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import rules
from ..operators.inspect import ContentOptions, inspect_files, windowed
from ..operators.secrets import secret_findings

FILES_SCHEMA = (
    "root string, path array<string>, is_dir boolean, is_symlink boolean, size bigint, content binary, error string"
)


def read_files_stream(spark: SparkSession, source: str, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(FILES_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.parquet(source)


def kept_files(files: DataFrame, include_hidden: bool = False, all_: bool = False, exclude=()) -> DataFrame:
    """Stateless path filters (ops 8-10) on file rows."""
    keep = rules.keep_predicate(F.col("path"), F.lit(False), include_hidden, all_, list(exclude))
    return files.filter(~F.col("is_dir") & keep)


def findings_stream(files: DataFrame, opts: ContentOptions | None = None, **walk) -> DataFrame:
    """(root, path, line, rule, kind) for every arriving file — append-only."""
    return secret_findings(inspect_files(kept_files(files, **walk)), opts)


def file_stats_stream(files: DataFrame, opts: ContentOptions | None = None, **walk) -> DataFrame:
    """(root, files, lines, size): running totals per root (update mode)."""
    insp = inspect_files(kept_files(files, **walk))
    lines = F.when(F.col("kind") == "text", TX.line_count(windowed(F.col("text"), opts))).otherwise(F.lit(0))
    return insp.groupBy("root").agg(
        F.count("*").cast("bigint").alias("files"),
        F.sum(lines).cast("bigint").alias("lines"),
        F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("size"),
    )


def dir_counts_stream(files: DataFrame, include_hidden: bool = False, all_: bool = False, exclude=()) -> DataFrame:
    """(root, dirs): distinct kept directories per root (update mode)."""
    anc = files.select(
        "root",
        "path",
        "is_dir",
        F.explode(F.sequence(F.lit(1), F.size("path"))).alias("k"),
    ).select(
        "root",
        F.slice("path", 1, F.col("k")).alias("dir"),
        ((F.col("k") < F.size("path")) | F.col("is_dir")).alias("is_dir"),
    ).filter(F.col("is_dir"))
    keep = rules.keep_predicate(F.col("dir"), F.lit(True), include_hidden, all_, list(exclude))
    return anc.filter(keep).dropDuplicates(["root", "dir"]).groupBy("root").agg(F.count("*").cast("bigint").alias("dirs"))


def start(df: DataFrame, sink: str, checkpoint: str, mode: str = "append", available_now: bool = True, fmt: str = "parquet"):
    """Start a query writing to ``sink`` (a path, or a query name for the memory sink)."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w
    if fmt == "memory":
        return w.format("memory").queryName(sink).start()
    return w.format(fmt).option("path", sink).start()
