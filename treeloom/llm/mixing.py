"""Mixing sources to target weights by hierarchical budgets (operator 9).

Documents are leaves' rows of a tree domain -> language -> source. A budget of
tokens is propagated from the root: the children of a node share its tokens in
proportion to their weights, none beyond its capacity (its supply times the
epochs allowed); what a child cannot take goes to its siblings by their weights,
and since a node never gets more than its children can hold, only what a whole
family cannot take reaches the family's own siblings. In closed form: with the
children sorted by capacity / weight, a child is full exactly if its capacity is
at most its share of what is left after the fuller ones; the rest share by
weight. All budgets are integers and sum up exactly.

Each leaf then takes whole epochs of its documents and, for the remainder, the
prefix of the next epoch in that epoch's seeded order (documents while the tokens
before them are below the remainder). Orders are hashes of seed, epoch and doc_id
(in ``take_mixture`` of the row's key where there is no doc_id),
so prefixes are computed by hash ranges: tokens are summed per leaf and range,
ranges are accumulated, and only rows of one range are ordered together. A leaf
with a third of all rows is spread over ``16 ** DIGITS`` ranges.

Defined cases: null text counts as empty (no tokens); a null domain, language or
source is the name ''; a weight that is null or not positive gives nothing;
rows of one doc_id are separate documents, equal orders are broken by token count
(repeated rows are interchangeable); an empty table or a budget of 0 gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, row_key, text_or_empty, written

LEVELS = ("domain", "lang", "source")
# Hex digits of the order that make up a range.
DIGITS = 3
# Leaves that may be broadcast (three names and three numbers each).
MAX_LEAVES = 50_000


def token_count(text: Column) -> Column:
    """Whitespace-separated words, the unit of budgets."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def _shares(nodes: DataFrame, family: list[str], name: str) -> DataFrame:
    """``nodes(family..., name, capacity, weight, total)`` with ``budget``: each family's total dealt to its members."""
    ratio = F.col("capacity") / F.col("weight")
    by_ratio = Window.partitionBy(*family).orderBy("ratio", name)
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    wide = "decimal(38,0)"
    full = nodes.withColumn("ratio", ratio).select(
        "*",
        F.least("total", F.sum("capacity").over(Window.partitionBy(*family))).alias("amount"),
        F.coalesce(F.sum("capacity").over(upto), F.lit(0)).alias("before"),
        F.sum("weight").over(onward).alias("onward"),
    )
    left = (F.col("amount") - F.col("before")).cast(wide)
    full = full.withColumn("full", F.col("capacity").cast(wide) * F.col("onward") <= left * F.col("weight"))
    same = Window.partitionBy(*family)
    rest = F.col("amount") - F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(same)
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0)).over(same)
    dealt = full.withColumn("rest", rest).withColumn("open_weight", open_weight)
    dealt = dealt.withColumn(
        "budget",
        F.when(F.col("full"), F.col("capacity")).otherwise(
            F.expr("cast(rest AS decimal(28,0)) * cast(weight AS decimal(9,0)) div cast(open_weight AS decimal(18,0))")
        ),
    )
    # what rounding down left over goes to the open members in turn, one token each
    over = F.col("rest") - F.sum(F.when(F.col("full"), 0).otherwise(F.col("budget"))).over(same)
    turn = F.row_number().over(Window.partitionBy(*family, "full").orderBy(name))
    dealt = dealt.withColumn("over", over).withColumn("turn", turn)
    more = (~F.col("full") & (F.col("turn") <= F.col("over"))).cast("bigint")
    return dealt.withColumn("budget", F.col("budget") + more).drop(
        "ratio", "amount", "before", "onward", "full", "rest", "open_weight", "over", "turn"
    )


def leaf_budgets(supply: DataFrame, budget: int, weights: dict[str, Column], max_epochs: int) -> DataFrame:
    """``(domain, lang, source, supply, budget)`` of every leaf of ``supply(domain, lang, source, supply)``.

    ``weights`` has a whole-number column expression over the leaf's names for
    each level; at a level it is the same for all leaves of a node.
    """
    weigh = lambda level: F.coalesce(weights[level].cast("bigint"), F.lit(0))
    leaves = supply.select(*LEVELS, "supply", *[weigh(x).alias(f"w_{x}") for x in LEVELS])
    able = F.least(*[F.col(f"w_{x}") for x in LEVELS]) > 0
    leaves = leaves.withColumn("capacity", F.when(able, F.col("supply") * max_epochs).otherwise(0))
    leaves = written(leaves, "leaves")
    above = leaves.select(F.lit(0).alias("root")).distinct().withColumn("total", F.lit(budget).cast("bigint"))
    family = ["root"]
    for level in LEVELS:
        nodes = (
            leaves.where("capacity > 0")
            .withColumn("root", F.lit(0))
            .groupBy(*family, level)
            .agg(F.sum("capacity").alias("capacity"), F.max(f"w_{level}").alias("weight"))
            .join(above, family)
        )
        family = [*family, level]
        above = _shares(nodes, family[:-1], level).select(*family, F.col("budget").alias("total"))
    return leaves.join(above.drop("root"), list(LEVELS), "left").select(
        *LEVELS, "supply", F.coalesce("total", F.lit(0)).alias("budget")
    )


def epoch_order(seed: int, epoch: Column, doc_id: Column) -> Column:
    """Place of a document in the seeded order of an epoch (hex digits, compared as text)."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def mix(docs: DataFrame, budget: int | None, weights: dict[str, Column], domain: Column, seed: int = 17, max_epochs: int = 3, share: float | None = None) -> DataFrame:
    """``(doc_id, domain, lang, source, epoch, order_key, n_tokens, leaf_supply, leaf_budget)`` of the mixture.

    One row per document and epoch taken. The budget is ``budget`` tokens, or
    ``share`` (in thousandths kept whole) of the tokens there are.
    """
    return _mixture(docs, budget, weights, domain, seed, max_epochs, share, keyed=False)


def _leaf(domain: Column) -> list[Column]:
    return [_name(domain), _name(F.col("lang")), _name(F.col("source"))]


def _name(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def _mixture(docs: DataFrame, budget: int | None, weights: dict[str, Column], domain: Column, seed: int, max_epochs: int, share: float | None, keyed: bool) -> DataFrame:
    """``mix``; if ``keyed``, with each row's ``row_key``, and rows without doc_id ordered by that key."""
    prepare(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        *[c.alias(level) for c, level in zip(_leaf(domain), LEVELS, strict=True)],
        token_count(text_or_empty()).alias("n_tokens"),
        *([row_key(*_leaf(domain)).alias("row_key")] if keyed else []),
    )
    identity = F.coalesce(F.col("doc_id").cast("string"), F.col("row_key")) if keyed else F.col("doc_id")
    rows = written(rows, "tokens")
    supply = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("supply"))
    if budget is None:
        there = rows.agg(F.sum("n_tokens")).first()[0] or 0
        budget = int(there) * round((share or 1.0) * 1000) // 1000
    plan = written(leaf_budgets(supply, budget, weights, max_epochs), "plan").where("budget > 0")
    few = plan.count() <= MAX_LEAVES
    plan = plan.select(
        *LEVELS,
        F.col("supply").alias("leaf_supply"),
        F.col("budget").alias("leaf_budget"),
        F.expr("budget div supply").cast("int").alias("whole"),
        (F.col("budget") % F.col("supply")).alias("rest"),
    )
    taken = rows.join(F.broadcast(plan) if few else plan, list(LEVELS))
    every = ["doc_id", *LEVELS, "epoch", "order_key", "n_tokens", "leaf_supply", "leaf_budget", *(["row_key"] if keyed else [])]

    whole = taken.where("whole > 0").withColumn("epoch", F.explode(F.expr("sequence(0, whole - 1)")))
    whole = whole.withColumn("order_key", epoch_order(seed, F.col("epoch"), identity)).select(*every)

    part = taken.where("rest > 0").withColumn("epoch", F.col("whole"))
    part = part.withColumn("order_key", epoch_order(seed, F.col("epoch"), identity))
    part = part.withColumn("range", F.substring("order_key", 1, DIGITS))
    sums = part.groupBy(*LEVELS, "range").agg(F.sum("n_tokens").alias("tokens"), F.first("rest").alias("bound"))
    so_far = Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # at most 16 ** DIGITS rows a leaf
    reached = sums.withColumn("start", F.coalesce(F.sum("tokens").over(so_far), F.lit(0))).where("start < bound")
    reached = written(reached.select(*LEVELS, "range", "start"), "ranges")
    inside = Window.partitionBy(*LEVELS, "range").orderBy("order_key", "n_tokens", *(["row_key"] if keyed else [])).rowsBetween(Window.unboundedPreceding, -1)
    near = part.join(reached, [*LEVELS, "range"])
    before = F.col("start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    prefix = near.withColumn("tokens_before", before).where("tokens_before < rest").select(*every)
    return whole.unionByName(prefix)


def take_mixture(docs: DataFrame, weights: dict[str, Column], domain: Column, seed: int, share: float) -> DataFrame:
    """The documents of a one-epoch mixture, all columns unchanged.

    Rows are joined back by a key of doc_id (null too), text and leaf, through a
    shuffle of both sides: neither is small. Of the copies of one key as many are
    returned as the mixture holds.
    """
    taken = _mixture(docs, None, weights, domain, seed, 1, share, keyed=True)
    taken = written(taken.groupBy(F.col("row_key").alias("__row_key")).agg(F.count(F.lit(1)).alias("__taken")), "taken")
    rows = docs.withColumn("__row_key", row_key(*_leaf(domain))).join(taken, "__row_key")
    copy = F.row_number().over(Window.partitionBy("__row_key").orderBy("__row_key"))
    return rows.withColumn("__copy", copy).where("__copy <= __taken").select(*docs.columns)
