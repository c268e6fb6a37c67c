"""Merkle manifest of a document table with a proof for every row (operator 11).

A row's leaf is the digest of its fields; the leaves of a language ascend by
doc_id and are joined two by two up to the language's root (``subroot``), and the
subroots, ordered by language, likewise up to the root of the whole table.

Trees are built in blocks of ``2**BLOCK`` consecutive nodes: one group holds a
block (a bounded list, whatever a language's share of the rows is) and makes
``BLOCK`` levels of it, so a tree of n leaves takes log(n) / BLOCK shuffles of
ever fewer nodes. Every node leaves the block with the segment to its parent: its
sibling.

Proofs come by pointer jumping. At the start of round r a node on a level that
2**r divides holds the segment to its ancestor 2**r levels above; a self-join
with that ancestor's own segment doubles the distance. Only nodes on such levels
go on, so the joined tables shrink geometrically, and the leaves, which take part
in every round, reach the root after log(height) joins. A join's right side is
broadcast only while its rows, known from the counts of leaves, stay below
``BROADCAST_BYTES``; beyond it Spark shuffles both sides, and no key has more
than 2**distance rows on the left.

Digests: ``H`` is SHA-256 in lowercase hex of its inputs, concatenated as text. A
node without a sibling is digested alone. A segment is an array with one entry a
level, from below: empty (no sibling), ``L`` or ``R`` and the sibling's digest.

Defined cases: a null field counts as ``-``; a null doc_id comes first and is
never tampered with; rows of one doc_id are ordered by their leaves; a lone leaf
is its tree's root and has no siblings; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import checked_broadcast
from ..operators.ordering import ordinal_within
from .common import prepare, written

BLOCK = 8
# A joined side is broadcast while this many bytes bound it.
BROADCAST_BYTES = 4 * 1024 * 1024
ENTRY_BYTES = 96  # of one segment entry in memory
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the bytes' count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame) -> DataFrame:
    """``(doc_id, lang, leaf, tampered)``: tampered is the changed row's leaf, null where nothing is changed.

    Rows whose decimal doc_id has a CRC-32 that 7 divides are tampered with: one is added to n_chars.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        F.col("n_chars").cast("bigint").alias("n_chars"),
        F.col("text").cast("string").alias("text"),
    )
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")  # no overflow at the largest bigint
    whole = lambda n: digest(*[field(n if name == "n_chars" else F.col(name)) for name in FIELDS])
    return rows.select(
        "doc_id", "lang", whole(F.col("n_chars")).alias("leaf"), F.when(hit, whole(more)).alias("tampered")
    )


def _paired(below: Column) -> Column:
    """The level above ``below``: every two consecutive digests joined, a last single one digested alone."""
    firsts = F.sequence(F.lit(0), F.size(below) - 1, F.lit(2))
    return F.transform(firsts, lambda i: digest(F.get(below, i), F.coalesce(F.get(below, i + 1), F.lit(""))))


def _levels(nodes: DataFrame, base: int) -> DataFrame:
    """The nodes of levels ``base`` .. ``base + BLOCK`` above ``nodes``, all of level ``base``.

    ``(tree, height, level, pos, digest, sibling, payload)``; ``sibling`` is null at
    a tree's root and on level ``base + BLOCK``, which the next block takes on.
    """
    rows = nodes.groupBy("tree", "height", F.shiftright("pos", BLOCK).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "digest", "payload"))).alias("members")
    )
    rows = rows.withColumn("d0", F.transform("members", lambda m: m["digest"]))
    for j in range(BLOCK):
        rows = rows.withColumn(f"d{j + 1}", F.when(F.col("height") > base + j, _paired(F.col(f"d{j}"))))

    def entry(j: int) -> Column:
        level = F.col(f"d{j}")
        beside = lambda i: F.get(level, i + 1 - 2 * (i % 2))
        sibling = lambda i: F.when(
            F.col("height") > base + j,
            F.coalesce(F.concat(F.when(i % 2 == 0, F.lit("R")).otherwise(F.lit("L")), beside(i)), F.lit("")),
        )
        nothing = F.lit(None).cast(nodes.schema["payload"].dataType)
        made = F.transform(
            level,
            lambda d, i: F.struct(
                F.lit(base + j).alias("level"),
                (F.shiftleft("block", BLOCK - j) + i).alias("pos"),
                d.alias("digest"),
                (sibling(i) if j < BLOCK else F.lit(None).cast("string")).alias("sibling"),
                (F.get(F.col("members"), i)["payload"] if j == 0 and base == 0 else nothing).alias("payload"),
            ),
        )
        return F.coalesce(made, F.array().cast(_entry_type(nodes)))

    every = F.flatten(F.array(*[entry(j) for j in range(BLOCK + 1)]))
    return rows.select("tree", "height", F.inline(every))


def _entry_type(nodes: DataFrame) -> str:
    payload = nodes.schema["payload"].dataType.simpleString()
    return f"array<struct<level:int,pos:bigint,digest:string,sibling:string,payload:{payload}>>"


def proofs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Proofs of all leaves of the trees in ``rows(tree, order, digest, payload)``.

    Returns ``(tree, payload, digest, segment)`` for each row, the segment up to its
    tree's root, and ``(tree, digest)`` of the roots. ``tree`` must not be null; the
    leaves of a tree ascend by ``order``.
    """
    placed = ordinal_within(rows, "tree", "order", "nth")
    counts = placed.groupBy("tree").agg(F.count("*").alias("n"))
    size = written(counts.withColumn("height", F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0)), "heights")
    total = size.agg(F.sum("n"), F.count("*"), F.max("height")).first()
    n, trees, highest = total[0] or 0, total[1], total[2] or 0
    sized = placed.join(checked_broadcast(size.select("tree", "height")), "tree")
    nodes = sized.select("tree", "height", (F.col("nth") - 1).alias("pos"), "digest", "payload")
    base, parts = 0, []
    while True:
        made = written(_levels(nodes, base), f"levels{base}")
        parts.append(made.where(F.col("level") < base + BLOCK))
        base += BLOCK
        if highest < base:
            break
        nodes = made.where(F.col("level") == base).drop("level", "sibling")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    roots = every.where(F.col("level") == F.col("height")).select("tree", "digest")
    first = lambda c: F.when(c.isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))
    leaf = parts[0].where("level = 0").select("tree", "pos", "payload", "digest", first(F.col("sibling")).alias("segment"))
    inner = every.where("level > 0 AND level < height").select(
        "tree", "level", "pos", first(F.col("sibling")).alias("segment")
    )
    far = 1
    while far < highest:
        above = inner.where(F.col("level") % (2 * far) == far).select(
            "tree", F.col("level").alias("up"), F.col("pos").alias("ancestor"), F.col("segment").alias("onward")
        )
        nearest = above.where(F.col("up") == far).drop("up")
        if ((n >> far) + trees) * far * ENTRY_BYTES <= BROADCAST_BYTES:
            nearest = F.broadcast(nearest)
        leaf = _extended(leaf.withColumn("ancestor", F.shiftright("pos", far)), nearest, ["tree", "ancestor"])
        if 2 * far < highest:
            go_on = inner.where(F.col("level") % (2 * far) == 0)
            go_on = go_on.withColumn("up", (F.col("level") + far).cast("int")).withColumn("ancestor", F.shiftright("pos", far))
            inner = written(_extended(go_on, above, ["tree", "up", "ancestor"]), f"segments{far}")
        far *= 2
    return leaf.select("tree", "payload", "digest", "segment"), roots


def _extended(nodes: DataFrame, above: DataFrame, keys: list[str]) -> DataFrame:
    """Each node's segment with its ancestor's behind it; nodes that stand at the root have no such ancestor."""
    joined = nodes.join(above, keys, "left")
    longer = F.concat("segment", F.coalesce("onward", F.array().cast("array<string>")))
    return joined.withColumn("segment", longer).drop("onward", "ancestor", "up")


def folded(start: Column, segment: Column) -> Column:
    """The root that ``start`` gives with the siblings of ``segment``."""

    def up(own: Column, s: Column) -> Column:
        left, right = s.startswith("L"), s.startswith("R")
        other = F.substr(s, F.lit(2), F.lit(64))
        return digest(F.when(left, other).otherwise(F.lit("")), own, F.when(right, other).otherwise(F.lit("")))

    return F.aggregate(segment, start, up)


def manifest(docs: DataFrame) -> DataFrame:
    """``(doc_id, lang, leaf, subroot, root, segment, proof_sha256, folded_root, verified)`` of every row.

    ``segment`` is the whole proof; ``folded_root`` starts at the tampered leaf where there is one.
    """
    prepare(docs.sparkSession)
    found = written(leaves(docs), "leaves")
    tree = F.when(F.col("lang").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("lang")))
    rows = found.select(
        tree.alias("tree"),
        F.struct("doc_id", "leaf").alias("order"),
        F.col("leaf").alias("digest"),
        F.struct("doc_id", "lang", "tampered").alias("payload"),
    )
    below, subroots = proofs(rows)
    tops = subroots.select(
        F.lit("").alias("tree"), F.col("tree").alias("order"), "digest", F.struct(F.col("tree").alias("of")).alias("payload")
    )
    above, roots = proofs(tops)
    rooted = above.join(F.broadcast(roots.select("tree", F.col("digest").alias("root"))), "tree")  # the root is one row
    onward = rooted.select(
        F.col("payload.of").alias("tree"), F.col("digest").alias("subroot"), F.col("segment").alias("onward"), "root"
    )
    whole = below.join(checked_broadcast(onward), "tree").withColumn("segment", F.concat("segment", "onward"))
    siblings = F.transform(F.filter("segment", lambda s: s != ""), lambda s: F.substr(s, F.lit(2), F.lit(64)))
    start = F.coalesce(F.col("payload.tampered"), F.col("digest"))
    return whole.select(
        F.col("payload.doc_id").alias("doc_id"),
        F.col("payload.lang").alias("lang"),
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        "segment",
        F.sha2(F.array_join(siblings, "").cast("binary"), 256).alias("proof_sha256"),
        folded(start, F.col("segment")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
