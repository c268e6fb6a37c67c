"""Snapshot documents per root: Markdown, structure, raw (ops 38-42).

The result for every root is its ordered pieces ``(root, seq, path, text)``:
concatenated by (seq, path) they are the document. No string longer than one
file's block is built, whatever the size of a root; pieces are written
range-partitioned (``sources.sinks``). ``render`` joins them to one string per
root as an explicit last step.

* seq 0: statistics header and opening of the structure section (raw: empty),
* seq 1: one line of the tree per node, seq 2: closing of the structure section,
* seq 3: one block per file. The blank line between raw files is a piece of its
  own whose path is the file's path and an empty name, so it sorts behind it.

The token line of the statistics header needs an o200k_base rank table; without
one the header has no token line (see ``operators.tokens``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import quantities as Q
from ..functions import text as TX
from ..session import memo_columns
from . import paths
from .inspect import ContentOptions, inspect_files, with_shown
from .joins import checked_broadcast, freeze, stored
from .ordering import concatenated
from .snapshot import WalkOptions, walk


@dataclass(frozen=True)
class RenderOptions:
    walk: WalkOptions = WalkOptions()
    content: ContentOptions = ContentOptions()


def _rel() -> Column:
    return F.array_join(F.col("path"), "/")


def is_notebook_path(path: Column) -> Column:
    return F.lower(F.element_at(path, -1)).endswith(".ipynb") & F.element_at(path, -1).contains(".")


def markdown_block(rel: Column, shown: Column) -> Column:
    """'\\n## path\\n\\n{fence}\\n{content}\\n{fence}\\n'."""
    fence = TX.fence(shown)
    return F.concat(F.lit("\n## "), rel, F.lit("\n\n"), fence, F.lit("\n"), shown, F.lit("\n"), fence, F.lit("\n"))


def notebook_block(rel: Column, rendered: Column) -> Column:
    return F.concat(F.lit("\n## Notebook: "), rel, F.lit("\n\n"), rendered, F.lit("\n"))


def raw_block(rel: Column, shown: Column) -> Column:
    """'==== path ====\\n' + content, newline-terminated (files are joined by a blank line)."""
    return F.concat(
        F.lit("==== "), rel, F.lit(" ====\n"), shown, F.when(shown.endswith("\n"), F.lit("")).otherwise(F.lit("\n"))
    )


def stats_header(files: Column, dirs: Column, lines: Column, size: Column, tokens: Column | None = None,
                 branch: Column | None = None, commit: Column | None = None, remote: Column | None = None) -> Column:
    """'# Project Statistics' + five bullets (token line only with a token count) + git lines + blank line."""
    before, after = header_parts(files, dirs, lines, size, branch, commit, remote)
    if tokens is None:
        return F.concat(before, after)
    return F.concat(before, F.lit("- Tokens (o200k_base): "), Q.format_count(tokens), F.lit("\n"), after)


def header_parts(files: Column, dirs: Column, lines: Column, size: Column, branch: Column | None = None,
                 commit: Column | None = None, remote: Column | None = None) -> tuple[Column, Column]:
    """The statistics header before and after the place of its token line."""
    before = F.concat(
        F.lit("# Project Statistics\n- Files: "), Q.format_count(files),
        F.lit("\n- Directories: "), Q.format_count(dirs),
        F.lit("\n- Total lines: "), Q.format_count(lines),
        F.lit("\n- Total size: "), Q.format_size(size), F.lit("\n"),
    )
    git = [
        F.coalesce(F.concat(F.lit(f"- {label}: "), c, F.lit("\n")), F.lit(""))
        for label, c in (("Git branch", branch), ("Git commit", commit), ("Git remote", remote))
        if c is not None
    ]
    return before, F.concat(*git, F.lit("\n"))


def _file_rows(files: DataFrame, opts: ContentOptions, mode: str, notebooks: bool, max_size=None) -> DataFrame:
    """Per kept file: (root, path, block, lines, size)."""
    insp = with_shown(inspect_files(files, max_size) if max_size is not None else inspect_files(files), opts)
    lines, block = memo_columns(("file_rows", opts, mode, notebooks), lambda: _file_row_columns(opts, mode, notebooks))
    return insp.select("root", "path", block.alias("block"), lines.alias("lines"), "size")


def _file_row_columns(opts: ContentOptions, mode: str, notebooks: bool):
    lines = F.when(F.col("kind") == "text", TX.line_count(F.col("shown"))).otherwise(F.lit(0)).cast("bigint")
    if mode == "raw":
        block = raw_block(_rel(), F.col("shown"))
    else:
        block = markdown_block(_rel(), F.col("shown"))
        if notebooks:
            from .notebook import render_notebook_column

            nb = render_notebook_column(F.col("text"), opts)
            # null where the text is no notebook
            own = F.when(is_notebook_path(F.col("path")) & (F.col("kind") == "text"), notebook_block(_rel(), nb))
            block = F.coalesce(own, block)
    return lines, block


def _meta_cols(meta: DataFrame | None):
    if meta is None:
        return None, None, None
    return F.col("branch"), F.col("commit_hash"), F.col("remote_url")


def render_pieces(files: DataFrame, mode: str = "markdown", opts: RenderOptions | None = None,
                  meta: DataFrame | None = None, notebooks: bool = True, ranks_path: str | None = None) -> DataFrame:
    """(root, seq, path, text) of every input root, also one whose files are all excluded.

    ``mode`` in {markdown, structure, raw}. ``meta``: optional (root, branch,
    commit_hash, remote_url) from ``operators.meta.attach_repo_meta``; roots
    without a row get no git lines. ``ranks_path``: an o200k_base rank file; with
    it the statistics header carries the token line (op 41), whose count includes
    the whole document, the line itself too.
    """
    opts = opts or RenderOptions()
    w = walk(files, opts.walk)
    roots = files.select("root").distinct()
    none = F.array().cast("array<string>")
    blocks = _file_rows(w.files, opts.content, "raw" if mode == "raw" else "markdown",
                        notebooks and mode == "markdown", opts.walk.max_size)
    # each content is inspected once: blocks, line counts and sizes are read back by what uses them
    blocks = stored(blocks.drop("block") if mode == "structure" else blocks, "blocks")
    contents = None
    if mode != "structure":  # which has no file blocks
        contents = blocks.select("root", F.lit(3).alias("seq"), "path", F.col("block").alias("text"))
    if mode == "raw":
        # the blank line behind every file but the last: from the paths alone
        names = w.files.select("root", "path")
        last = names.groupBy("root").agg(F.max("path").alias("last"))
        between = names.join(last, "root").filter(F.col("path") != F.col("last")).select(
            "root", F.lit(3).alias("seq"), F.array_append("path", "").alias("path"), F.lit("\n").alias("text")
        )
        start = roots.select("root", F.lit(0).alias("seq"), none.alias("path"), F.lit("").alias("text"))
        return start.unionByName(contents).unionByName(between)

    nodes = freeze(w.nodes)  # paths only; feeds lines, counts and fence widths
    lines = paths.tree_lines(nodes).select("root", F.lit(1).alias("seq"), "path", F.col("line").alias("text"))
    file_stats = blocks.groupBy("root").agg(
        F.count("*").cast("bigint").alias("files"), F.sum("lines").cast("bigint").alias("lines"),
        F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("size"),
    )
    node_stats = nodes.groupBy("root").agg(
        F.count_if("is_dir").cast("bigint").alias("dirs"), F.max(_max_backtick_run(F.col("name"))).alias("run")
    )
    per_root = roots.join(node_stats, "root", "left").join(file_stats, "root", "left")
    if meta is not None:
        per_root = per_root.join(meta.select("root", "branch", "commit_hash", "remote_url"), "root", "left")
    title = F.concat(paths.root_display_name("root"), F.lit("/\n"))
    widest = F.greatest(F.coalesce("run", F.lit(0)), _max_backtick_run(title))
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), widest + 1).cast("int"))
    opening = F.concat(F.lit("# Project Structure\n\n"), fence, F.lit("\n"), title)
    closing = F.concat(fence, F.lit("\n"), F.lit("\n# File Contents\n" if mode == "markdown" else ""))
    close = per_root.select("root", F.lit(2).alias("seq"), none.alias("path"), closing.alias("text"))
    z = F.lit(0).cast("bigint")
    counts = [F.coalesce(c, z) for c in ("files", "dirs", "lines", "size")]
    git = _meta_cols(meta)
    header = stats_header(*counts, None, *git)
    if ranks_path is not None:
        header, per_root = _header_with_tokens(per_root, counts, git, opening, lines, close, contents, mode, ranks_path)
    head = per_root.select("root", F.lit(0).alias("seq"), none.alias("path"), F.concat(header, opening).alias("text"))
    pieces = head.unionByName(lines).unionByName(close)
    return pieces.unionByName(contents) if mode == "markdown" else pieces


def render(files: DataFrame, mode: str = "markdown", opts: RenderOptions | None = None,
           meta: DataFrame | None = None, notebooks: bool = True, ranks_path: str | None = None) -> DataFrame:
    """(root, document): the pieces of each root as one string.

    For roots whose document fits one string of one task; one that cannot be a
    string at all fails the query. Larger ones stay pieces.
    """
    return concatenated(render_pieces(files, mode, opts, meta, notebooks, ranks_path), "document")


def _header_with_tokens(per_root: DataFrame, counts: list, git: tuple, opening: Column, lines: DataFrame, close: DataFrame,
                        contents: DataFrame, mode: str, ranks_path: str):
    """The header column with its token line, and ``per_root`` with the tokens behind the header.

    Tokens are summed over units that begin where a pre-token does: the opening,
    every tree line, the closing (with the first block's leading newline) and
    every block without its leading newline, which the block before it takes.
    """
    from .tokens import header_fixpoint, token_counts

    units = per_root.select("root", F.lit("0").alias("uid"), opening.alias("text")).unionByName(
        lines.select("root", F.concat(F.lit("1"), F.array_join("path", "/")).alias("uid"), "text")
    )
    if mode == "markdown":
        names = contents.select("root", "path")
        last = names.groupBy("root").agg(F.max("path").alias("last"))
        shifted = contents.join(last, "root").select(
            "root", F.concat(F.lit("3"), F.array_join("path", "/")).alias("uid"),
            F.concat(F.expr("substring(text, 2)"), F.when(F.col("path") == F.col("last"), F.lit("")).otherwise(F.lit("\n"))).alias("text"),
        )
        close = close.join(last, "root", "left").select(
            "root", F.concat("text", F.when(F.col("last").isNull(), F.lit("")).otherwise(F.lit("\n"))).alias("text")
        )
        units = units.unionByName(shifted)
    units = units.unionByName(close.select("root", F.lit("2").alias("uid"), "text"))
    behind = token_counts(units, ranks_path, "text", keys=("root", "uid")).groupBy("root").agg(
        F.sum("tokens").cast("bigint").alias("body_tokens")
    )
    per_root = per_root.join(behind, "root", "left")
    before, after = header_parts(*counts, *git)
    tokens = header_fixpoint(before, after, F.coalesce("body_tokens", F.lit(0)).cast("bigint"), ranks_path)
    header = F.concat(before, F.lit("- Tokens (o200k_base): "), Q.format_count(tokens), F.lit("\n"), after)
    return header, per_root


def render_mode(raw: Column, reverse: Column, structure: Column) -> Column:
    """Op 42: raw > reverse > structure > markdown; raw together with structure is an error."""
    return (
        F.when(raw & structure, F.lit(None))
        .when(raw, F.lit("raw"))
        .when(reverse, F.lit("reverse"))
        .when(structure, F.lit("structure"))
        .otherwise(F.lit("markdown"))
    )


RAW_STRUCTURE_ERROR = "Options --raw and -s (structure with statistics) cannot be used together."


def _max_backtick_run(col: Column) -> Column:
    runs = F.transform(F.regexp_extract_all(col, F.lit("`+"), 0), lambda r: F.length(r))
    return F.coalesce(F.array_max(runs), F.lit(0))


def render_pieces_by_options(files: DataFrame, resolved: DataFrame, meta: DataFrame | None = None,
                             walk_opts: WalkOptions | None = None) -> DataFrame:
    """Ops 42 + 50 end to end: (root, mode, error, seq, path, text), every root rendered with its own options.

    ``resolved`` is ``options.resolve_options`` output; a root without a row gets
    the defaults. Sizes and windows are columns of each file row (one row per
    root, size-checked broadcast). What shapes the walk (mode, include_hidden,
    no_ignore, all, no_content, exclude) is rendered once per distinct setting
    present. A root whose options or patterns are invalid has one row with the
    error and no text.
    """
    from .blueprint import blueprint_pieces
    from .rules import GlobError, RuleSet

    walk_opts = walk_opts or WalkOptions()
    flag = lambda name: F.coalesce(F.col(name), F.lit(False))
    mode = render_mode(flag("raw"), flag("reverse"), flag("structure"))
    none = F.array().cast("array<string>")
    opts = files.select("root").distinct().join(resolved, "root", "full").select(
        "root",
        F.coalesce(F.col("max_size").cast("bigint"), F.lit(walk_opts.max_size).cast("bigint")).alias("__max_size"),
        F.col("max_chars").cast("bigint").alias("__max_chars"),
        F.col("head").cast("bigint").alias("__head"),
        F.col("tail").cast("bigint").alias("__tail"),
        flag("from_end").alias("__from_end"),
        F.struct(
            mode.alias("mode"),
            (flag("include_hidden") | F.lit(walk_opts.include_hidden)).alias("include_hidden"),
            (flag("no_ignore") | F.lit(walk_opts.no_ignore)).alias("no_ignore"),
            (flag("all") | F.lit(walk_opts.all)).alias("all"),
            (flag("no_content") & (mode == "reverse")).alias("no_content"),
            F.concat(F.coalesce("exclude", none), F.array(*[F.lit(g) for g in walk_opts.exclude]).cast("array<string>")).alias("exclude"),
        ).alias("__walk"),
        F.coalesce(F.col("error"), F.when(mode.isNull(), F.lit(RAW_STRUCTURE_ERROR))).alias("__error"),
    )
    opts = checked_broadcast(opts)
    valid = opts.filter(F.col("__error").isNull()).drop("__error")
    out = opts.filter(F.col("__error").isNotNull()).select(
        "root", F.lit(None).cast("string").alias("mode"), F.col("__error").alias("error"), F.lit(0).alias("seq"),
        none.alias("path"), F.lit(None).cast("string").alias("text"),
    )
    with_options = files.join(valid, "root")
    content = ContentOptions(max_chars="__max_chars", head="__head", tail="__tail", from_end="__from_end")
    for row in valid.select("__walk").distinct().collect():  # distinct settings, not roots
        s = row["__walk"]
        same = F.col("__walk").eqNullSafe(F.struct(
            F.lit(s["mode"]).alias("mode"), F.lit(s["include_hidden"]).alias("include_hidden"),
            F.lit(s["no_ignore"]).alias("no_ignore"), F.lit(s["all"]).alias("all"), F.lit(s["no_content"]).alias("no_content"),
            F.array(*[F.lit(g) for g in s["exclude"]]).cast("array<string>").alias("exclude"),
        ))
        mine = with_options.filter(same).drop("__walk")
        error = F.lit(None).cast("string")
        try:
            RuleSet.of(list(s["exclude"]))
        except GlobError as e:
            bad = mine.select("root").distinct()
            part = bad.select("root", F.lit(0).alias("seq"), none.alias("path"), error.alias("text"))
            out = out.unionByName(part.withColumn("mode", error).withColumn("error", F.lit(str(e))))
            continue
        w_opts = WalkOptions(include_hidden=s["include_hidden"], no_ignore=s["no_ignore"], all=s["all"],
                             exclude=tuple(s["exclude"]), mktree_ignore=walk_opts.mktree_ignore, max_size="__max_size")
        if s["mode"] == "reverse":
            w = walk(mine, w_opts)
            part = blueprint_pieces(w.files, w.nodes, content, max_size="__max_size", no_content=s["no_content"], roots=mine)
        else:
            part = render_pieces(mine, s["mode"], RenderOptions(walk=w_opts, content=content), meta)
        out = out.unionByName(part.withColumn("mode", F.lit(s["mode"])).withColumn("error", error))
    return out


def render_by_options(files: DataFrame, resolved: DataFrame, meta: DataFrame | None = None,
                      walk_opts: WalkOptions | None = None) -> DataFrame:
    """(root, mode, document, error): the pieces of each root as one string; null with an error."""
    pieces = render_pieces_by_options(files, resolved, meta, walk_opts)
    good = pieces.filter(F.col("error").isNull())
    modes = good.select("root", "mode").distinct()
    documents = concatenated(good, "document").join(modes, "root")
    errors = pieces.filter(F.col("error").isNotNull()).select("root", "mode", F.col("text").alias("document"), "error")
    return documents.select("root", "mode", "document", F.lit(None).cast("string").alias("error")).unionByName(errors)


def document_token_counts(files: DataFrame, mode: str, ranks_path: str, opts: RenderOptions | None = None,
                          meta: DataFrame | None = None) -> DataFrame:
    """The token count of each root's whole output (``--tokens``): (root, tokens).

    markdown / structure: the header's own count (it includes the header). raw
    and reverse: summed over units that begin where a pre-token does (a file's
    block with the blank line behind it; a node's block). No document string is
    built.
    """
    from .blueprint import blueprint_pieces
    from .tokens import token_counts

    opts = opts or RenderOptions()
    if mode in ("markdown", "structure"):
        head = render_pieces(files, mode, opts, meta, ranks_path=ranks_path).filter("seq = 0")
        t = F.regexp_extract("text", r"- Tokens \(o200k_base\): ([0-9,]+)\n", 1)
        return head.select("root", F.regexp_replace(t, ",", "").cast("bigint").alias("tokens"))
    if mode == "raw":
        pieces = render_pieces(files, "raw", opts, meta)
        # the separator's path is its file's path and an empty name
        place = F.filter("path", lambda c: c != "")
        one = pieces.groupBy("root", place.alias("place")).agg(
            F.expr("listagg(text, '') WITHIN GROUP (ORDER BY path)").alias("text")  # a block and its separator
        )
    else:
        w = walk(files, opts.walk)
        one = blueprint_pieces(w.files, freeze(w.nodes), opts.content, opts.walk.max_size, roots=files).withColumnRenamed("path", "place")
    units = one.select("root", F.array_join("place", "/").alias("uid"), F.coalesce("text", F.lit("")).alias("text"))
    per_unit = token_counts(units, ranks_path, "text", keys=("root", "uid"))
    return per_unit.groupBy("root").agg(F.sum("tokens").cast("bigint").alias("tokens"))
