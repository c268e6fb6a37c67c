"""Writing snapshots (op 5): one document per root, addressable by byte ranges.

A document is the folder ``snapshot=<output name>`` below the target: text files
that are the document when they are joined in name order. Pieces are
range-partitioned by (output name, seq, path), so a huge root is spread over many
tasks and files. ``_index`` beside the documents lists (root, output, file, offset,
size), the running sums of the files' sizes, so ``read_ranges`` opens only files
that a range touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import checked_broadcast

INDEX = "_index"
# Ranges and files meet by blocks of a document of so many bytes.
BLOCK = 4 * 1024 * 1024


def output_name(root: str = "root", suffix: str = ".md", fallback: str = "snapshot"):
    """Per-root output name '<root name><suffix>'; '<fallback><suffix>' for '', '.' or '..'
    (the command-line tool uses its own name as the fallback; pass it here)."""
    trimmed = F.regexp_replace(F.col(root), "/+$", "")
    last = F.element_at(F.split(trimmed, "/"), -1)
    return F.when(last.isin("", ".", "..") | last.isNull(), F.lit(fallback + suffix)).otherwise(F.concat(last, F.lit(suffix)))


def output_names(roots: DataFrame, suffix: str = ".md", fallback: str = "snapshot") -> DataFrame:
    """(root, output): the roots' output names; roots that share one get a digest of the root behind it."""
    named = roots.select("root").distinct().withColumn("output", output_name("root", suffix, fallback))
    shared = named.groupBy("output").count().filter("count > 1").select("output", F.lit(True).alias("shared"))
    own = F.concat(F.col("output"), F.lit("~"), F.substring(F.md5(F.col("root").cast("binary")), 1, 8))
    return named.join(shared, "output", "left").select("root", F.when(F.col("shared"), own).otherwise(F.col("output")).alias("output"))


def write_pieces(pieces: DataFrame, target: str, suffix: str = ".md", partitions: int | None = None,
                 roots: DataFrame | None = None) -> DataFrame:
    """(root, seq, path, text) -> one document per root below ``target``; returns the index.

    Every text ends with a newline or is empty (as those of all render modes do).
    ``roots``: roots that get an index row also without any piece.
    """
    spark = pieces.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    names = checked_broadcast(output_names(pieces if roots is None else roots, suffix))
    ended = F.when(F.col("text").endswith("\n"), F.expr("substring(text, 1, length(text) - 1)")).otherwise(
        F.raise_error(F.lit("a piece of a written document must end with a newline"))
    )
    (
        pieces.filter(F.col("text") != "")
        .join(names, "root")
        .repartitionByRange(n, "output", "seq", "path")
        .sortWithinPartitions("output", "seq", "path")
        .select(F.col("output").alias("snapshot"), ended.alias("value"))
        .write.mode("overwrite")
        .partitionBy("snapshot")
        .text(target)
    )
    files = _files(spark, target).select("output", "file", F.col("length").alias("size"))
    # a document has at most one file per writing task
    before = Window.partitionBy("output").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("bigint"))
    index = names.join(files, "output", "left").select("root", "output", "file", "offset", "size")
    index.write.mode("overwrite").parquet(f"{target.rstrip('/')}/{INDEX}")
    return spark.read.parquet(f"{target.rstrip('/')}/{INDEX}")


def _files(spark: SparkSession, target: str) -> DataFrame:
    """(path, length, content, output, file) of the written files; the content is read only where it is selected."""
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*.txt").load(target)
    )
    return found.withColumns({"output": _output_of(F.col("path")), "file": F.element_at(F.split("path", "/"), -1)})


def _output_of(path: Column) -> Column:
    """The output name in a folder name, without its percent escapes."""
    name = F.regexp_extract(path, r"snapshot=([^/]*)/[^/]*$", 1)
    return F.url_decode(F.regexp_replace(name, r"\+", "%2B"))


def read_ranges(spark: SparkSession, target: str, ranges: DataFrame) -> DataFrame:
    """(root, start, length, content): the bytes of each of ``ranges(root, start, length)``.

    Only files that a range touches are read, each once. What lies beyond a
    document's end is not there; a range of an unknown root has no row; equal
    ranges are one.
    """
    index = spark.read.parquet(f"{target.rstrip('/')}/{INDEX}")
    blocks = lambda at, n: F.explode(F.sequence(F.floor(at / BLOCK), F.floor((at + F.greatest(n, F.lit(1)) - 1) / BLOCK)))
    wanted = ranges.select("root", "start", "length").distinct()
    asked = wanted.withColumn("block", blocks(F.col("start"), F.col("length")))
    held = index.filter("size > 0").withColumn("block", blocks(F.col("offset"), F.col("size")))
    low, high = F.greatest("start", "offset"), F.least(F.col("start") + F.col("length"), F.col("offset") + F.col("size"))
    pairs = asked.join(held, ["root", "block"]).filter((F.floor(low / BLOCK) == F.col("block")) & (high > low))
    cuts = pairs.groupBy("output", "file").agg(
        F.collect_list(F.struct("root", "start", "length", low.alias("at"), (low - F.col("offset")).alias("skip"), (high - low).alias("n"))).alias("cuts")
    )
    files = _files(spark, target).select("output", "file", "content").join(checked_broadcast(cuts), ["output", "file"])
    # the content is bound once a file, then each cut takes its own bytes
    parts = F.transform(
        F.array("content"),
        lambda c: F.transform(
            "cuts",
            lambda x: F.struct(
                x["root"].alias("root"), x["start"].alias("start"), x["length"].alias("length"), x["at"].alias("at"),
                F.substr(c, (x["skip"] + 1).cast("int"), x["n"].cast("int")).alias("bytes"),
            ),
        ),
    )
    found = files.select(F.inline(F.element_at(parts, 1)))
    whole = found.groupBy("root", "start", "length").agg(F.array_sort(F.collect_list(F.struct("at", "bytes"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda all_, p: F.concat(all_, p["bytes"]))
    empty = wanted.join(index.select("root").distinct(), "root", "left_semi")
    return empty.join(whole, ["root", "start", "length"], "left").select(
        "root", "start", "length", F.coalesce(joined, F.lit(b"")).alias("content")
    )


def write_snapshots(files: DataFrame, target: str, mode: str = "markdown", opts=None, meta=None,
                    partitions: int | None = None) -> DataFrame:
    """Op 5 end to end for mode in {markdown, structure, raw, reverse}: one walk, one ordered write; returns the index.

    ``reverse`` writes blueprints, whose output name ends in ``.tree``. A root
    with nothing kept is in the index too.
    """
    pieces, suffix = snapshot_pieces(files, mode, opts, meta)
    return write_pieces(pieces, target, suffix, partitions, roots=files)


def snapshot_pieces(files: DataFrame, mode: str = "markdown", opts=None, meta=None) -> tuple[DataFrame, str]:
    """The ordered pieces of a mode's documents, and the suffix of their output names."""
    from ..operators.blueprint import blueprint_pieces
    from ..operators.render import RenderOptions, render_pieces
    from ..operators.snapshot import walk

    if mode == "reverse":
        opts = opts or RenderOptions()
        w = walk(files, opts.walk)
        return blueprint_pieces(w.files, w.nodes, opts.content, opts.walk.max_size, roots=files), ".tree"
    return render_pieces(files, mode, opts, meta), ".md"
