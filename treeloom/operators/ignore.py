"""Ignore files as a relational query (ops 11, 12, 13).

1. rules: the lines of each ``.gitignore`` / ``.ignore`` (any directory) and of
   the root's ``.mktreeignore`` become rows (root, dir, source, line_no, regex,
   negated, dir_only). Line -> regex is a small Arrow-batched helper over the
   (tiny) rules table only.
2. rules are indexed by what the last name of a match is certain to have (the
   whole name, an extension, nothing); a node meets the rules of the ancestor
   directories that hold any by (root, dir, index key), and only then is its
   path relative to that directory matched with ``rlike``.
3. the winning rule comes from ``.ignore`` files (any level) over ``.gitignore``
   files, then from the deepest directory, then from the last line (``max_by``);
   a non-negated winner ignores the node. ``.gitignore`` files count whether or
   not the root is a repository. ``.mktreeignore`` globs have no negation and
   always exclude; a glob that is invalid makes the root an error (``Walk.errors``).
4. ignored directories remove their whole subtree (prune).
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package

from . import paths
from .rules import GlobError, glob_to_regex

# Ignore-file names and their precedence (higher wins inside one directory).
SOURCE_PRIORITY = {".gitignore": 1, ".ignore": 2}
MKTREE_NAME = ".mktreeignore"

_RULE_TYPE = T.StructType(
    [
        T.StructField("regex", T.StringType()),
        T.StructField("negated", T.BooleanType()),
        T.StructField("dir_only", T.BooleanType()),
    ]
)


def _gi_glob(body: str) -> str:
    """gitignore glob body -> regex; '*' and '?' stay inside one component."""
    out = []
    i, n = 0, len(body)
    while i < n:
        ch = body[i]
        if ch == "\\" and i + 1 < n:
            out.append(re.escape(body[i + 1]))
            i += 2
        elif ch == "*":
            j = i
            while j < n and body[j] == "*":
                j += 1
            at_start = i == 0 or body[i - 1] == "/"
            at_end = j == n or body[j] == "/"
            if j - i == 2 and at_start and at_end:
                if j < n:
                    out.append("(?:.*/)?")
                    j += 1
                else:
                    out.append(".*")
            else:
                out.append("[^/]*")
            i = j
        elif ch == "?":
            out.append("[^/]")
            i += 1
        elif ch == "[":
            j = i + 1
            if j < n and body[j] in "!^":
                j += 1
            if j < n and body[j] == "]":
                j += 1
            while j < n and body[j] != "]":
                j += 1
            if j >= n:
                out.append(re.escape(ch))
                i += 1
                continue
            inner = body[i + 1 : j]
            neg = inner[:1] in ("!", "^")
            if neg:
                inner = inner[1:]
            inner = inner.replace("\\", "\\\\").replace("[", "\\[")
            out.append("[" + ("^" if neg else "") + inner + "]")
            i = j + 1
        else:
            out.append(_esc(ch))
            i += 1
    return "".join(out)


def _esc(ch: str) -> str:
    return "\\" + ch if ch in "\\.^$|?*+()[]{}" else ch


def parse_gitignore_line(line: str):
    """(regex, negated, dir_only) or None for blank/comment lines."""
    if line.endswith("\r"):
        line = line[:-1]
    # trailing spaces are dropped unless escaped
    stripped = line.rstrip(" ")
    if stripped.endswith("\\") and len(line) > len(stripped):
        stripped = stripped + " "
    line = stripped
    if not line or line.startswith("#"):
        return None
    negated = False
    if line.startswith("!"):
        negated = True
        line = line[1:]
    elif line.startswith("\\!") or line.startswith("\\#"):
        line = line[1:]
    dir_only = line.endswith("/")
    line = line.rstrip("/")
    if not line:
        return None
    anchored = "/" in line
    if line.startswith("/"):
        line = line[1:]
    body = _gi_glob(line)
    if not anchored and not body.startswith("(?:.*/)?"):
        body = "(?:.*/)?" + body
    return ("(?s)^" + body + "$", negated, dir_only)


def parse_mktree_line(line: str):
    """A ``.mktreeignore`` line (already trimmed, no comments) -> glob rule."""
    raw = line
    dir_only = raw.endswith("/")
    text = raw.rstrip("/")
    try:
        rx = glob_to_regex(text)
    except GlobError:
        return None
    return (rx, False, dir_only, "/" in text)


@F.pandas_udf(_RULE_TYPE)
def _compile_gitignore(lines: pd.Series) -> pd.DataFrame:
    rows = [parse_gitignore_line(x) if isinstance(x, str) else None for x in lines]
    return pd.DataFrame(
        {
            "regex": [r[0] if r else None for r in rows],
            "negated": [r[1] if r else None for r in rows],
            "dir_only": [r[2] if r else None for r in rows],
        }
    )


@F.pandas_udf(T.StringType())
def _compile_mktree(lines: pd.Series) -> pd.Series:
    out = []
    for x in lines:
        r = parse_mktree_line(x) if isinstance(x, str) else None
        out.append(None if r is None else "(?s)^(?:" + r[0] + ")$")
    return pd.Series(out, dtype=object)


def gitignore_rules(files: DataFrame) -> DataFrame:
    """(root, dir, source_priority, line_no, regex, negated, dir_only) from .gitignore/.ignore files."""
    name = F.element_at("path", -1)
    src = files.filter(~F.col("is_dir") & name.isin(list(SOURCE_PRIORITY))).select(
        "root",
        F.slice("path", 1, F.size("path") - 1).alias("dir"),
        F.when(name == ".ignore", 2).otherwise(1).alias("source_priority"),
        F.posexplode(F.split(F.col("content").cast("string"), "\n")).alias("pos", "line"),
    )
    compiled = src.select(
        "root", "dir", "source_priority", (F.col("pos") + 1).alias("line_no"), _compile_gitignore("line").alias("r"),
        rule_key(F.regexp_replace(F.regexp_replace("line", "[ \r]+$", ""), "^!", "")).alias("index"),
    )
    return compiled.filter(F.col("r").isNotNull() & F.col("r.regex").isNotNull()).select(
        "root", "dir", "source_priority", "line_no", "r.regex", "r.negated", "r.dir_only", "index"
    )


def mktree_rules(files: DataFrame) -> DataFrame:
    """(root, line_no, regex, dir_only, has_slash) from each root's .mktreeignore (op 11)."""
    src = files.filter(
        ~F.col("is_dir") & (F.size("path") == 1) & (F.element_at("path", 1) == MKTREE_NAME)
    ).select("root", F.posexplode(F.split(F.col("content").cast("string"), "\n")).alias("pos", "line"))
    trimmed = F.regexp_replace(F.col("line"), r"(?U)^\s+|\s+$", "")
    lines = src.select("root", (F.col("pos") + 1).alias("line_no"), trimmed.alias("pattern")).filter(
        (F.col("pattern") != "") & ~F.col("pattern").startswith("#")
    )
    return lines.select(
        "root",
        "line_no",
        F.col("pattern"),
        _compile_mktree(F.regexp_replace("pattern", "/+$", "")).alias("regex"),
        F.col("pattern").endswith("/").alias("dir_only"),
        F.regexp_replace("pattern", "/+$", "").contains("/").alias("has_slash"),
        rule_key(F.col("pattern")).alias("index"),
    )


# ---------------------------------------------------------------------------
# rule index
# ---------------------------------------------------------------------------

# Copies of each rule and shares of the nodes that a shuffle join deals a hot key to.
SALTS = 16


def rule_key(pattern: Column) -> Column:
    """(by, key): what the last name of every path that a pattern matches is certain to have.

    ``name``: the whole name (no wildcard behind the last slash); ``extension``: what
    follows the last dot (the wildcards are followed by a text with a dot);
    ``any``: nothing is certain.
    """
    bare = F.regexp_replace(F.regexp_replace(pattern, "/+$", ""), "^/", "")
    literal = F.regexp_extract(bare, r"([^*?\[\]\\]*)$", 1)  # behind the last wildcard or escape
    last = F.substring_index(literal, "/", -1)
    extension = F.substring_index(last, ".", -1)
    whole = (F.length(literal) == F.length(bare)) | literal.contains("/")
    by = F.when(whole, "name").when(last.contains(".") & (extension != ""), "extension").otherwise("any")
    return F.struct(by.alias("by"), F.when(whole, last).when(by == "extension", extension).otherwise("").alias("key"))


def node_keys() -> Column:
    """The index keys under which a node's rules stand."""
    name = F.element_at("path", -1)
    entry = lambda by, key: F.struct(F.lit(by).alias("by"), key.alias("key"))
    return F.array(entry("name", name), entry("extension", F.substring_index(name, ".", -1)), entry("any", F.lit("")))


def _indexed(nodes: DataFrame, rules: DataFrame, on: list[str]) -> DataFrame:
    """Nodes joined with the rules that their index keys allow; ``rules`` carry ``index``.

    A hash join on (on, by, key); the salts split a key that many nodes share (rules
    for any name) when both sides are shuffled.
    """
    salted = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("by", F.col("index.by"))
    salted = salted.withColumn("key", F.col("index.key")).drop("index")
    held = nodes.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int")).select("*", F.inline(node_keys()))
    return held.join(salted, [*on, "by", "key", "salt"])


def git_winners(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """(root, path, negated) of the winning gitignore rule of every matched node (op 12).

    Only ancestors that hold rules are looked at (their table is broadcast while
    small), and a regex only runs where the rule index allows a match.
    """
    from .joins import checked_broadcast

    ruled = checked_broadcast(rules.select("root", "dir").distinct())
    cand = nodes.select(
        "root", "path", "is_dir", F.explode(F.sequence(F.lit(0), F.size("path") - 1)).alias("k")
    ).select("root", "path", "is_dir", F.slice("path", 1, F.col("k")).alias("dir")).join(ruled, ["root", "dir"], "left_semi")
    rel = F.array_join(F.slice("path", F.size("dir") + 1, F.size("path")), "/")
    hits = _indexed(cand, rules, ["root", "dir"]).filter(F.regexp_like(rel, F.col("regex")) & (~F.col("dir_only") | F.col("is_dir")))
    return hits.groupBy("root", "path").agg(
        F.max_by("negated", F.struct("source_priority", F.size("dir"), "line_no")).alias("negated")
    )


def mktree_ignored(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """(root, path) of nodes matched by their root's .mktreeignore globs (glob semantics of op 10).

    A component matches where a node's own name does: the subtree below goes with it.
    """
    joined = _indexed(nodes.select("root", "path", "is_dir"), rules.select("root", "regex", "dir_only", "has_slash", "index"), ["root"])
    full = F.expr("array_join(path, '/') rlike regex")
    own = F.expr("element_at(path, -1) rlike regex") & ~F.col("has_slash")
    hit = (~F.col("dir_only") | F.col("is_dir")) & (full | own)
    return joined.filter(hit).select("root", "path").distinct()


def mktree_errors(rules: DataFrame) -> DataFrame:
    """(root, error) of roots whose .mktreeignore has an invalid glob; the first such line is named."""
    bad = rules.filter(F.col("regex").isNull()).groupBy("root").agg(F.min(F.struct("line_no", "pattern")).alias("b"))
    text = F.concat(F.lit(f"Invalid pattern in {MKTREE_NAME}, line "), F.col("b.line_no").cast("string"), F.lit(": "), F.col("b.pattern"))
    return bad.select("root", text.alias("error"))


def ignore_files_present(files: DataFrame) -> set[str]:
    """Which ignore-file kinds exist ('git', 'mktree'): one probe on the path columns only
    (content is pruned from the scan); at most three distinct names come back."""
    name = F.element_at("path", -1)
    kinds = F.when(name.isin(list(SOURCE_PRIORITY)), F.lit("git")).when(
        (F.size("path") == 1) & (name == MKTREE_NAME), F.lit("mktree")
    )
    found = files.select("path", "is_dir").filter(~F.col("is_dir")).select(kinds.alias("k")).filter(
        F.col("k").isNotNull()
    ).distinct().limit(2).collect()
    return {r["k"] for r in found}


def apply_ignore_files(files: DataFrame, w, mktree: bool, git: bool, hide: bool = False):
    """Remove ignored nodes and their subtrees from a walk; keep files whose node survives.

    ``hide``: the hidden-name test was deferred to here — a node whose own name
    starts with '.' is excluded unless an ignore-file rule matched it (a
    whitelisting rule rescues it; an ignoring one excludes it anyway). Removed
    file paths are materialised and broadcast only after their size is measured.
    """
    from .joins import checked_broadcast, freeze
    from .snapshot import Walk

    ship_package(files.sparkSession)
    errors = None
    if mktree:
        mk_rules = checked_broadcast(mktree_rules(files))  # a few lines per root
        errors = checked_broadcast(mktree_errors(mk_rules))
        w = Walk(w.files.join(errors.select("root"), "root", "left_anti"), w.nodes.join(errors.select("root"), "root", "left_anti"))
    # nodes feed the rule join, the prune and the removed-file set: compute them once
    nodes = freeze(w.nodes)
    marked = nodes
    excluded = F.lit(False)
    if git:
        # broadcast while the rules are small: then no node is shuffled to its (root, directory)
        win = git_winners(nodes, checked_broadcast(gitignore_rules(files)))
        marked = marked.join(win, ["root", "path"], "left")
        own_hidden = F.element_at("path", -1).startswith(".")
        excluded = F.coalesce(~F.col("negated"), own_hidden if hide else F.lit(False))
    if mktree:
        mk = mktree_ignored(nodes, mk_rules).withColumn("mk", F.lit(True))
        marked = marked.join(mk, ["root", "path"], "left")
        excluded = excluded | F.coalesce(F.col("mk"), F.lit(False))
    marked = marked.withColumn("excluded", excluded).select(*nodes.columns, "excluded")
    kept_nodes = freeze(paths.prune_subtrees(marked, small=checked_broadcast).drop("excluded"))
    removed = nodes.filter(~F.col("is_dir")).select("root", "path").join(
        kept_nodes.select("root", "path"), ["root", "path"], "left_anti"
    )
    kept_files = w.files.join(checked_broadcast(removed), ["root", "path"], "left_anti")
    return Walk(kept_files, kept_nodes, errors)
