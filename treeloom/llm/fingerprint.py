"""Document fingerprints from closed syncmers (operator 1, DataFrame functions only).

A text is a sequence of symbols: letter-and-digit runs cut every ``PIECE``
characters, single ideographs, single other marks; blanks part symbols and are
not symbols. Of the windows of ``K`` symbols (k-mers) those are chosen whose least
hashed ``S``-symbol substring is the first or the last one. The choice depends on
the k-mer alone, so equal passages choose the same anchors wherever they stand.

The fingerprint is every anchor with its position (symbol number), in the order
of positions, so a text has the same density of anchors whatever its length.
Likeness of two fingerprints is the Jaccard likeness of their sets of anchor
hashes; the shift is the median distance of the first positions of common
anchors, 0 for an edit in place.

An edited text shares all symbols up to the last blank before the place of the
edit with the text itself. As the choice is context-free, the windows that end
there are taken over, and only the seam and the new tail are looked at again;
likeness and shift use the common part in the same way.

Defined cases: null text counts as empty and has the empty fingerprint; a text of
fewer than ``K`` symbols has each symbol as an anchor; two empty
fingerprints are alike (1.0), an empty and another one are not (0.0). The next
document is the one with the next doc_id, the first after the last one, itself in
a table of one row; rows of one doc_id follow each other by text, null ids come
first. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, partitions, prepare, text_or_empty

PIECE = 6
K = 5
S = 2
SYMBOL = rf"[\p{{IsIdeographic}}\p{{IsHiragana}}\p{{IsKatakana}}]|[\p{{L}}\p{{M}}\p{{N}}]{{1,{PIECE}}}|[^\s\p{{L}}\p{{M}}\p{{N}}]"


def symbols(text: Column) -> Column:
    """Hashes of a text's symbols in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(SYMBOL), F.lit(0)), lambda s: F.xxhash64(s))


def _hash_of(hashes: Column, i: Column, width: int) -> Column:
    """Hash of the ``width`` symbols from ``i`` on: each step joins the next one to what is there."""
    out = F.get(hashes, i)
    for step in range(1, width):
        out = F.xxhash64(out, F.get(hashes, i + step))
    return out


def anchor_places(hashes: Column) -> Column:
    """Where the chosen windows of ``K`` symbols begin; every symbol of a shorter sequence."""
    n, inner = F.size(hashes), K - S

    def closed(smers: Column, i: Column) -> Column:
        ends = F.least(F.get(smers, i), F.get(smers, i + inner))
        return ends <= F.least(*[F.get(smers, i + step) for step in range(1, inner)])

    def chosen(smers: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), n - K), lambda i: closed(smers, i))

    smers = F.transform(F.sequence(F.lit(0), F.greatest(n - S, F.lit(0))), lambda i: _hash_of(hashes, i, S))
    short = F.transform(hashes, lambda _, i: i)
    return F.when(n < K, short).otherwise(let(smers, chosen))


def anchor_hashes(hashes: Column, places: Column) -> Column:
    whole = F.transform(places, lambda i: _hash_of(hashes, i, K))
    return F.when(F.size(hashes) < K, hashes).otherwise(whole)


def tokens(found: Column, places: Column) -> Column:
    """``HASH@position`` of every anchor, hash as sixteen hex digits."""
    return F.zip_with(found, places, lambda h, p: F.concat(F.lpad(F.hex(h), 16, "0"), F.lit("@"), p.cast("string")))


def fingerprint_text(parts: Column) -> Column:
    return F.lower(F.array_join(parts, ","))


def likeness(own: Column, other: Column, both: Column) -> Column:
    """Common hashes as a share of all, from the sizes of both sets and of their union."""
    return F.when(both == 0, F.lit(1.0)).otherwise((own + other - both).cast("double") / both)


def shift(head: Column, zeros: Column, tail: Column, tail_at: Column, new: Column, new_at: Column) -> Column:
    """Median distance of the first positions of common anchors; null without any.

    Hashes of the common ``head`` (``zeros`` different ones) keep their places. Those
    of the old and the new tail are sorted together by hash, side and position, with
    the head's hashes among them as a side before both: the first of each hash and
    side stays, and a hash common to the tails alone is two neighbours.
    """

    def sided(hashes: Column, places: Column, side: int) -> Column:
        return F.zip_with(hashes, places, lambda h, p: F.struct(h.alias("h"), F.lit(side).alias("side"), p.alias("p")))

    def firsts(every: Column) -> Column:
        before = lambda i: F.get(every, i - 1)
        return F.filter(every, lambda x, i: (i == 0) | (before(i)["h"] != x["h"]) | (before(i)["side"] != x["side"]))

    def distances(first: Column) -> Column:
        def apart(x: Column, i: Column) -> Column:
            old, kept = F.get(first, i - 1), F.get(first, i - 2)
            alone = (i < 2) | (kept["h"] != x["h"])
            common = (i > 0) & (x["side"] == 2) & (old["side"] == 1) & (old["h"] == x["h"])
            return F.when(common & alone, x["p"] - old["p"])

        return F.filter(F.transform(first, apart), lambda d: d.isNotNull())

    def middle(d: Column) -> Column:
        at = F.floor((zeros + F.size(d) - 1) / 2).cast("int")
        below = F.size(F.filter(d, lambda x: x < 0))
        return F.when(at < below, F.get(d, at)).when(at < below + zeros, F.lit(0)).otherwise(F.get(d, at - zeros))

    in_head = F.transform(
        F.array_intersect(F.array_union(tail, new), head),
        lambda h: F.struct(h.alias("h"), F.lit(0).alias("side"), F.lit(0).alias("p")),
    )
    every = F.sort_array(F.concat(in_head, sided(tail, tail_at, 1), sided(new, new_at, 2)))
    found = let(every, lambda e: let(firsts(e), distances))
    return let(F.sort_array(found), lambda d: F.when(zeros + F.size(d) > 0, middle(d)))


def dealt_in_ring(rows: DataFrame, buckets: int):
    """``rows(doc_id, text)`` dealt out by ranges of doc_id, and the window in which each row's next one follows it.

    Rows are dealt once into ``buckets`` ranges of doc_id whose lower ends are
    approximate quantiles (a bounded list, each an id of the table). The row at a
    lower end is also sent to the range before, whose last row it follows, so a
    window within each range sees every neighbour.
    """
    shares = [i / buckets for i in range(1, buckets)]
    ends = rows.agg(
        F.min("doc_id").alias("lo"),
        F.percentile_approx("doc_id", shares or [0.5], max(10_000, 10 * buckets)).alias("ends"),
        F.max(F.col("doc_id").isNull()).alias("nulls"),
    ).first()
    lower = sorted({x for x in [ends["lo"], *((ends["ends"] or []) if shares else [])] if x is not None})
    if ends["nulls"]:
        lower = [None, *lower]
    lower = lower or [None]
    groups = max(1, int(len(lower) ** 0.5))
    blocks = [lower[i : i + groups] for i in range(0, len(lower), groups)]

    def at_least(block: list) -> Column:
        """How many lower ends of the block are at most the row's id (a null end is below every id)."""
        known = [x for x in block if x is not None]
        held = F.array(*[F.lit(x).cast("bigint") for x in known])
        return F.lit(len(block) - len(known)) + F.when(
            F.col("doc_id").isNull() | F.lit(not known), F.lit(0)
        ).otherwise(F.size(F.filter(held, lambda e: e <= F.col("doc_id"))))

    block_of = let(
        F.greatest(F.lit(1), at_least([b[0] for b in blocks])),
        lambda j: (j - 1) * groups + F.element_at(F.array(*[at_least(b) for b in blocks]), j) - 1,
    )
    first = F.col("doc_id").isin([x for x in lower if x is not None])
    if None in lower:
        first = F.col("doc_id").isNull() | F.coalesce(first, F.lit(False))
    ring = len(lower)
    dealt = rows.withColumn("bucket", block_of.cast("int"))
    dealt = dealt.withColumn(
        "copy",
        F.explode(
            F.when(
                first,
                F.array(
                    F.struct(F.col("bucket").alias("b"), F.lit(False).alias("tail")),
                    F.struct(((F.col("bucket") + ring - 1) % ring).cast("int").alias("b"), F.lit(True).alias("tail")),
                ),
            ).otherwise(F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("tail"))))
        ),
    ).select(*rows.columns, "copy.b", "copy.tail")
    return dealt, Window.partitionBy("b").orderBy("tail", F.col("doc_id").asc_nulls_first(), "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edited_shift)``.

    Texts are shuffled once. The fingerprint of each text is computed after that
    shuffle and handed to its predecessor by the same window that hands over the
    text.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    buckets = 4 * partitions(spark)
    dealt, window = dealt_in_ring(rows, buckets)
    n = F.length("text")
    marked = (
        dealt.repartition(partitions(spark), "b")
        .withColumn("n", n)
        .withColumn("k", F.floor(F.col("n") / 4).cast("int"))
        # the head ends with the last blank before the place of the edit (without one it is empty)
        .withColumn("stays", F.substr("text", F.lit(1), F.col("n") - F.col("k")))
        .withColumn("seam", F.substring_index("stays", " ", -1))
        .withColumn("cut", F.col("n") - F.col("k") - F.length("seam"))
        .withColumn("head", symbols(F.substr("text", F.lit(1), F.col("cut"))))
        .withColumn("whole", F.concat("head", symbols(F.substr("text", F.col("cut") + 1, F.col("n")))))
        .withColumn("at", anchor_places(F.col("whole")))
        .withColumn("found", anchor_hashes(F.col("whole"), F.col("at")))
        .withColumn("distinct", F.size(F.array_distinct("found")))
        .withColumn("m", F.size("head"))
        .withColumn("joint", F.slice("head", F.greatest(F.col("m") - (K - 2), F.lit(1)), F.lit(K - 1)))
        .drop("head", "whole")
    )
    follow = (
        marked.withColumn("next_text", F.lead("text").over(window))
        .withColumn("next_found", F.lead("found").over(window))
        .withColumn("next_distinct", F.lead("distinct").over(window))
        .where(~F.col("tail"))
    )
    # windows that begin up to m - K lie in the head; the next ones begin with its last K - 1 symbols
    kept = F.size(F.filter("at", lambda p: p <= F.col("m") - K))
    kept = F.when(F.col("m") >= K, kept).otherwise(0)
    out = (
        follow.withColumn("begins", F.substr("next_text", F.lit(1), F.col("k")))
        .withColumn("edited", F.concat("stays", "begins"))
        .withColumn("fresh", F.concat("joint", symbols(F.concat("seam", "begins"))))
        # behind a head of K symbols fewer than K symbols make no window
        .withColumn("fresh", F.when((F.col("m") >= K) & (F.size("fresh") < K), F.slice("fresh", 1, 0)).otherwise(F.col("fresh")))
        .withColumn("fresh_at", anchor_places(F.col("fresh")))
        .withColumn("new", anchor_hashes(F.col("fresh"), F.col("fresh_at")))
        .withColumn("new_at", F.transform("fresh_at", lambda i: i + F.greatest(F.lit(0), F.col("m") - (K - 1))))
        .withColumn("kept", kept)
        .withColumn("held", F.array_distinct(F.slice("found", F.lit(1), F.col("kept"))))
        .withColumn("edited_distinct", F.size(F.array_union("held", "new")))
        .withColumn("tokens", tokens(F.col("found"), F.col("at")))
    )
    from_kept = lambda c: F.slice(c, F.col("kept") + 1, F.size(c))
    return out.select(
        "doc_id",
        F.col("n").cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint_text(F.col("tokens")).alias("fingerprint"),
        fingerprint_text(
            F.concat(F.slice("tokens", F.lit(1), F.col("kept")), tokens(F.col("new"), F.col("new_at")))
        ).alias("edited_fingerprint"),
        likeness(F.col("distinct"), F.col("edited_distinct"), F.size(F.array_union("found", "new"))).alias("near_edited"),
        likeness(F.col("distinct"), F.col("next_distinct"), F.size(F.array_union("found", "next_found"))).alias("near_next"),
        shift(F.col("held"), F.size("held"), from_kept("found"), from_kept("at"), F.col("new"), F.col("new_at"))
        .cast("bigint")
        .alias("edited_shift"),
    )
