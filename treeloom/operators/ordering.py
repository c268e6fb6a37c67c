"""Order-dependent helpers that never put a whole key into one task.

``ordinal_within`` numbers rows inside a key by an order column, like
``row_number() over (partition by key order by ...)``, but a hot key (one root
holding a third of all rows) is spread over many range partitions instead of
one window task. ``concatenated`` joins the ordered pieces of a text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .joins import freeze, stored


def _partitions(df: DataFrame) -> int:
    spark = df.sparkSession
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def ordinal_within(df: DataFrame, key: str, order: str, out: str = "ordinal", partitions: int | None = None) -> DataFrame:
    """1-based ordinal of each row inside ``key`` by ``order`` (ties: arbitrary, keys are unique here).

    1. range-partition by (key, order) and sort inside partitions: a hot key spans
       many partitions, each bounded;
    2. tag partition id and position, and checkpoint to the shared folder so the
       tags are stable even when tasks are retried;
    3. counts per (partition, key) form a small table; their running sum over
       earlier partitions of the same key is the offset.
    """
    ensure_checkpoint_dir(df.sparkSession)
    n = partitions or _partitions(df)
    ranged = (
        df.repartitionByRange(n, key, order)
        .sortWithinPartitions(key, order)
        .withColumn("__pid", F.spark_partition_id())
        .withColumn("__pos", F.monotonically_increasing_id())
    ).checkpoint(eager=True)
    stats = ranged.groupBy("__pid", key).agg(F.count("*").alias("__n"), F.min("__pos").alias("__first"))
    w = Window.partitionBy(key).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stats.withColumn("__off", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    return (
        ranged.join(offsets.select("__pid", key, "__first", "__off"), ["__pid", key])
        .withColumn(out, (F.col("__pos") - F.col("__first") + 1 + F.col("__off")).cast("bigint"))
        .drop("__pid", "__pos", "__first", "__off")
    )


def prefix_sums(df: DataFrame, key: str, order: list[str], value: str, out: str, partitions: int | None = None) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows of the same ``key`` that ``order`` puts before.

    Meant for narrow rows. They are range-partitioned by (key, order) and frozen with
    their partition's number; sums inside a partition and the running sums of the
    partitions' totals (one row per partition and key) add up to the result, so a
    hot key is spread over many partitions.
    """
    n = partitions or _partitions(df)
    ranged = freeze(df.repartitionByRange(n, key, *order).withColumn("__pid", F.spark_partition_id()))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.sum(value).over(before(Window.partitionBy(key, "__pid").orderBy(*order)))
    totals = ranged.groupBy(key, "__pid").agg(F.sum(value).alias("__total"))
    earlier = F.sum("__total").over(before(Window.partitionBy(key).orderBy("__pid")))
    offsets = totals.select(key, "__pid", F.coalesce(earlier, F.lit(0)).alias("__earlier"))
    summed = ranged.withColumn("__inside", F.coalesce(inside, F.lit(0))).join(offsets, [key, "__pid"])
    return summed.withColumn(out, (F.col("__inside") + F.col("__earlier")).cast("bigint")).drop("__pid", "__inside", "__earlier")


def with_starts(pieces: DataFrame, at_rest: bool = False) -> DataFrame:
    """Pieces with ``start`` and ``length``: where each stands in its root's document, in bytes of UTF-8.

    The pieces are written once unless they are ``at_rest`` (cheap to read again);
    the sums see no text.
    """
    rows = pieces.select(*PIECES, F.octet_length("text").cast("bigint").alias("length"))
    rows = rows if at_rest else stored(rows, "pieces")
    starts = prefix_sums(rows.select("root", "seq", "path", "length"), "root", ["seq", "path"], "length", "start")
    return rows.join(starts.drop("length"), ["root", "seq", "path"])


# Ordered pieces of a text per root: concatenated by (seq, path) they are the whole text.
PIECES = ("root", "seq", "path", "text")


def concatenated(pieces: DataFrame, out: str) -> DataFrame:
    """(root, out): the pieces of each root as one string, in (seq, path) order.

    The explicit last step for callers who want a string: it gathers a root's
    text in one task. A text that cannot be one string is an error, never a null.
    """
    whole = F.expr("listagg(text, '') WITHIN GROUP (ORDER BY struct(seq, path))")
    size = F.sum(F.octet_length("text"))
    joined = pieces.groupBy("root").agg(whole.alias("__whole"), size.alias("__size"))
    lost = F.coalesce(F.col("__whole"), F.lit(""))
    checked = F.when(F.octet_length(lost) == F.coalesce("__size", F.lit(0)), lost).otherwise(
        F.raise_error(F.lit("the text of a root does not fit one string; use its pieces"))
    )
    return joined.select("root", checked.alias(out))
