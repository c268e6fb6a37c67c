"""Option layers per root (ops 15, 50).

option_layers(root, layer in {explicit, global, local, default}, <fields>):
explicit > global > local > default per field; {head, tail} and
{structure, reverse, raw} are taken as a unit from the highest layer that sets
any member; violations come back as an error column, not a job failure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Layer precedence (higher wins) and the option fields.
LAYER_RANK = {"default": 0, "local": 1, "global": 2, "explicit": 3}
SCALAR_FIELDS = [
    "max_size", "max_chars", "from_end", "no_content", "tokens", "no_secret_scan",
    "include_hidden", "no_ignore", "all", "exclude", "force", "dry_run",
]
LINE_GROUP = ["head", "tail"]
MODE_GROUP = ["structure", "reverse", "raw"]

ERR_HEAD_TAIL = "Config enables both 'head' and 'tail'; choose only one"
ERR_FROM_END = "Config enables 'from_end' without setting 'max_chars'"
ERR_RAW_STRUCTURE = "Config enables both 'raw' and 'structure'; choose only one output mode"


FLAGS = ["from_end", "no_content", "tokens", "no_secret_scan", "include_hidden", "no_ignore", "all", "force", "dry_run"]


def _merged(highest: str, prefix: str) -> list:
    """Aggregates that merge the layers up to ``highest``: single fields, then the two groups as units."""
    rank = F.when(F.col("rank") <= LAYER_RANK[highest], F.col("rank"))
    out = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), rank)).alias(prefix + f) for f in SCALAR_FIELDS]
    for group in (LINE_GROUP, MODE_GROUP):
        given = F.col(group[0]).isNotNull()
        for f in group[1:]:
            given = given | F.col(f).isNotNull()
        unit = F.struct(*[F.col(f) for f in group])
        out.append(F.max_by(unit, F.when(given, rank)).alias(prefix + group[0] + "_group"))
    return out


def _error(prefix: str):
    """What is wrong with merged options, null when nothing is."""
    lines, modes = F.col(f"{prefix}head_group"), F.col(f"{prefix}structure_group")
    return (
        F.when(lines["head"].isNotNull() & lines["tail"].isNotNull(), F.lit(ERR_HEAD_TAIL))
        .when(F.coalesce(F.col(f"{prefix}from_end"), F.lit(False)) & F.col(f"{prefix}max_chars").isNull(), F.lit(ERR_FROM_END))
        .when(F.coalesce(modes["raw"] & modes["structure"], F.lit(False)), F.lit(ERR_RAW_STRUCTURE))
    )


def resolve_options(layers: DataFrame) -> DataFrame:
    """One row per root: resolved fields + ``error`` (null when valid). One aggregation by root.

    The merged config files (all layers below the command line) must be valid on
    their own: what the command line adds does not repair them.
    """
    rank = F.create_map(*[x for k, v in LAYER_RANK.items() for x in (F.lit(k), F.lit(v))])
    df = layers.withColumn("rank", F.element_at(rank, F.col("layer")))
    merged = df.groupBy("root").agg(*_merged("explicit", "e_"), *_merged("global", "g_"))
    scalar = lambda f: F.coalesce("e_" + f, F.lit(False)) if f in FLAGS else F.col("e_" + f)
    return merged.select(
        "root",
        *[scalar(f).alias(f) for f in SCALAR_FIELDS],
        *[F.col(f"e_head_group.{f}").alias(f) for f in LINE_GROUP],
        *[F.coalesce(F.col(f"e_structure_group.{f}"), F.lit(False)).alias(f) for f in MODE_GROUP],
        F.coalesce(_error("g_"), _error("e_")).alias("error"),
    )


def secret_scan_policy(resolved: DataFrame, command: str = "copy") -> DataFrame:
    """Op 15: (root, scan) — content is scanned unless disabled or nothing is exported.

    ``command="reverse"``: the command that always writes a blueprint, so only a
    token count or a blueprint without contents exports nothing.
    """
    bare = F.col("no_content") if command == "reverse" else F.col("structure") | (F.col("reverse") & F.col("no_content"))
    skips_export = F.col("tokens") | bare
    return resolved.select("root", (~F.col("no_secret_scan") & ~skips_export).alias("scan"))
