"""Tree structure from path lists: closure, listing, pruning, drawing (ops 3, 4, 13, 32, 37).

``path ARRAY<STRING>`` replaces the recursive tree: ordering by it is the
depth-first preorder with siblings in byte order (never order by the joined
string: ``src-x`` sorts before ``src/a`` there).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BRANCH = "├── "
LAST = "└── "
PIPE = "│   "
SPACE = "    "


def path_closure(files: DataFrame) -> DataFrame:
    """Op 3: every node once, ancestors added; a path with children is a directory.

    (root, path, is_dir, name, depth). Rows x depth are exploded from the two
    narrow columns only, then a partial+final ``bool_or`` per (root, path)
    collapses the repeated ancestors map-side before the shuffle.
    """
    narrow = files.select("root", "path", "is_dir").filter(F.size("path") > 0)
    exploded = narrow.select(
        "root",
        "path",
        "is_dir",
        F.explode(F.sequence(F.lit(1), F.size("path"))).alias("k"),
    ).select(
        "root",
        F.slice("path", 1, F.col("k")).alias("path"),
        ((F.col("k") < F.size("path")) | F.col("is_dir")).alias("is_dir"),
    )
    return (
        exploded.groupBy("root", "path")
        .agg(F.bool_or("is_dir").alias("is_dir"))
        .select(
            "root",
            "path",
            "is_dir",
            F.element_at("path", -1).alias("name"),
            F.size("path").alias("depth"),
        )
    )


def rel_path(path_col="path"):
    return F.array_join(F.col(path_col) if isinstance(path_col, str) else path_col, "/")


def prune_subtrees(nodes: DataFrame, excluded_col: str = "excluded", small=None) -> DataFrame:
    """Op 13: drop every node that is excluded or has an excluded ancestor.

    For rules known per row (hidden, globs) use ``rules.keep_predicate`` instead,
    it needs no join. This general form handles flags that come from joins
    (ignore files): excluded directories are equi-joined with each node's
    exploded ancestors; the anti join removes the subtrees. ``small``
    (``joins.checked_broadcast``) may turn the excluded directories into a
    broadcast side, so that a top directory's subtree is not one join key.
    """
    bad_dirs = nodes.filter(F.col(excluded_col) & F.col("is_dir")).select("root", F.col("path").alias("anc"))
    bad_dirs = small(bad_dirs) if small else bad_dirs
    ancestors = nodes.filter(~F.col(excluded_col)).select(
        "root",
        "path",
        F.explode(F.sequence(F.lit(1), F.size("path") - 1)).alias("k"),
    ).filter(F.col("k") >= 1).select("root", "path", F.slice("path", 1, F.col("k")).alias("anc"))
    doomed = ancestors.join(bad_dirs, ["root", "anc"], "left_semi").select("root", "path").distinct()
    return nodes.filter(~F.col(excluded_col)).join(doomed, ["root", "path"], "left_anti")


def list_files(nodes: DataFrame) -> DataFrame:
    """Op 4: file nodes with their 1-based preorder ordinal within the root.

    The ordinal is computed without a per-root window (a root may hold a third
    of all rows): rows are range-partitioned by (root, path), numbered inside
    each partition, and shifted by the counts of the same root in earlier
    partitions (a small per-(partition, root) table).
    """
    from .ordering import ordinal_within

    files = nodes.filter(~F.col("is_dir")).select("root", "path")
    return ordinal_within(files, "root", "path", "ordinal")


def count_dirs(nodes: DataFrame) -> DataFrame:
    """Op 32: directories per root, empty ones included."""
    return nodes.groupBy("root").agg(F.count_if(F.col("is_dir")).cast("bigint").alias("dirs"))


def mark_last(nodes: DataFrame) -> DataFrame:
    """is_last: the node's name is its siblings' maximum (byte order).

    The maximum per parent is a partial+final aggregation (hot parents collapse
    map-side); the flag is joined back on the node's full path, a unique key.
    """
    parent = F.slice("path", 1, F.size("path") - 1)
    last = (
        nodes.groupBy("root", parent.alias("parent"))
        .agg(F.max("name").alias("last_name"))
        .select("root", F.concat("parent", F.array("last_name")).alias("path"), F.lit(True).alias("is_last"))
    )
    return nodes.join(last, ["root", "path"], "left").withColumn("is_last", F.coalesce("is_last", F.lit(False)))


def tree_lines(nodes: DataFrame) -> DataFrame:
    """Op 37, distributed part: one drawn line per node.

    (root, path, line) where line = ancestors' continuation pieces + connector +
    name (+ '/' for directories) + newline. The pieces of each node's ancestors
    come from the directories only: each directory's child prefix is built from
    its own ancestors (dirs x depth rows), then every node picks its parent's
    prefix with an equi-join on (root, parent path).
    """
    marked = mark_last(nodes)
    piece = F.when(F.col("is_last"), F.lit(SPACE)).otherwise(F.lit(PIPE))
    dirs = marked.filter("is_dir").select("root", "path", piece.alias("piece"))
    # child prefix of each directory = pieces of the directory and all its ancestors, by depth
    dir_anc = dirs.select(
        "root",
        F.col("path").alias("dir"),
        F.explode(F.sequence(F.lit(1), F.size("path"))).alias("k"),
    ).select("root", "dir", "k", F.slice("dir", 1, F.col("k")).alias("path"))
    prefixes = (
        dir_anc.join(dirs, ["root", "path"])
        .groupBy("root", "dir")
        .agg(F.array_sort(F.collect_list(F.struct("k", "piece"))).alias("ps"))
        .select(
            "root",
            F.col("dir").alias("parent"),
            F.array_join(F.transform("ps", lambda s: s["piece"]), "").alias("prefix"),
        )
    )
    with_parent = marked.withColumn("parent", F.slice("path", 1, F.size("path") - 1))
    joined = with_parent.join(prefixes, ["root", "parent"], "left")
    line = F.concat(
        F.coalesce(F.col("prefix"), F.lit("")),
        F.when(F.col("is_last"), F.lit(LAST)).otherwise(F.lit(BRANCH)),
        F.col("name"),
        F.when(F.col("is_dir"), F.lit("/")).otherwise(F.lit("")),
        F.lit("\n"),
    )
    return joined.select("root", "path", line.alias("line"))


def root_display_name(root):
    """Last component of the root (a name like '.' or '' falls back to the whole root)."""
    r = F.col(root) if isinstance(root, str) else root
    trimmed = F.regexp_replace(r, "/+$", "")
    last = F.element_at(F.split(trimmed, "/"), -1)
    return F.when(last.isin("", ".", "..") | last.isNull(), r).otherwise(last)


def tree_pieces(nodes: DataFrame, with_root: bool = True) -> DataFrame:
    """Op 37: (root, seq, path, text): the drawn tree, optionally headed by '<root name>/', line by line."""
    from .joins import freeze

    nodes = freeze(nodes.select("root", "path", "is_dir", "name", "depth"))  # narrow
    lines = tree_lines(nodes).select("root", F.lit(1).alias("seq"), "path", F.col("line").alias("text"))
    if not with_root:
        return lines
    none = F.array().cast("array<string>")
    head = nodes.select("root").distinct().select(
        "root", F.lit(0).alias("seq"), none.alias("path"), F.concat(root_display_name("root"), F.lit("/\n")).alias("text")
    )
    return head.unionByName(lines)


def draw_tree(nodes: DataFrame, with_root: bool = True) -> DataFrame:
    """Op 37: (root, tree), the pieces of the drawn tree as one string per root."""
    from .ordering import concatenated

    return concatenated(tree_pieces(nodes, with_root), "tree")
