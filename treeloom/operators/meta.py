"""Repository metadata as a dimension (op 36): no git binary, rows arrive as tables.

repo_meta(root, branch, commit_hash) — one row per root that is a repository;
remotes(root, pos, name, url) — the remotes in listing order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_line_trimmed(c: Column) -> Column:
    """First line, trimmed; empty -> null (a command's one-line answer)."""
    v = F.regexp_replace(F.substring_index(c, "\n", 1), "(?U)^\\s+|\\s+$", "")
    return F.when(v != "", v)


def attach_repo_meta(repo_meta: DataFrame, remotes: DataFrame) -> DataFrame:
    """(root, branch, commit_hash, remote_url): remote = 'origin', else the first listed non-blank remote.

    Roots without a repo_meta row get no row (not a repository). One small
    aggregation per root over the remotes, then a left join.
    """
    named = remotes.select(
        "root", "pos", first_line_trimmed(F.col("name")).alias("name"), first_line_trimmed(F.col("url")).alias("url")
    ).filter(F.col("name").isNotNull())
    origin = named.filter(F.col("name") == "origin").groupBy("root").agg(F.first("url").alias("origin_url"))
    first = named.groupBy("root").agg(F.min_by("url", "pos").alias("first_url"))
    return (
        repo_meta.select(
            "root",
            first_line_trimmed(F.col("branch")).alias("branch"),
            first_line_trimmed(F.col("commit_hash")).alias("commit_hash"),
        )
        .join(origin, "root", "left")
        .join(first, "root", "left")
        .select("root", "branch", "commit_hash", F.coalesce("origin_url", "first_url").alias("remote_url"))
    )
