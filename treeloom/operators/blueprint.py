"""Indented-tree blueprints (ops 47-49).

render: per node one block (2 spaces per level; ``dir/``; ``name``; ``name: text``;
``name:|`` + indented lines), concatenated in preorder per root.
parse: what a line means, and ``parse_blueprint`` for one text; tables of texts or
pieces are parsed by ``blueprint_parse``.
entries: duplicate siblings — the last one wins with its whole subtree.
"""

from __future__ import annotations

import re
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import content as C
from ..functions import quantities as Q
from ..functions import text as TX
from .inspect import ContentOptions, inspect_files, windowed

# ---------------------------------------------------------------------------
# render (op 47)
# ---------------------------------------------------------------------------


def text_lines(text: Column) -> Column:
    """A line iterator's lines: split on '\\n', no final empty piece, trailing '\\r' removed."""
    parts = F.split(text, "\n")
    n = F.size(parts) - F.when(text.endswith("\n"), 1).otherwise(0)
    kept = F.slice(parts, 1, F.greatest(n, F.lit(0)))
    return F.transform(kept, lambda l: F.regexp_replace(l, "\r\\z", ""))


def file_block(indent: Column, name: Column, kind: Column, text: Column, meta: Column, limit: Column,
               error: Column, no_content: bool = False) -> Column:
    if no_content:
        return F.concat(indent, name, F.lit("\n"))
    pad = F.concat(indent, F.lit("  "))
    # texts without CR (nearly all): indent by one replace instead of splitting into lines
    trimmed = F.when(text.endswith("\n"), F.substr(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    fast = F.concat(pad, F.replace(trimmed, F.lit("\n"), F.concat(F.lit("\n"), pad)), F.lit("\n"))
    slow = F.array_join(F.transform(text_lines(text), lambda l: F.concat(pad, l, F.lit("\n"))), "")
    body_lines = F.when(text.contains("\r"), slow).otherwise(fast)
    multi = F.concat(
        indent, name, F.lit(":|\n"), body_lines,
        F.when(text.endswith("\n"), F.concat(indent, F.lit("  \n"))).otherwise(F.lit("")),
    )
    return (
        F.when((kind == "text") & (text == ""), F.concat(indent, name, F.lit("\n")))
        .when((kind == "text") & TX.is_single_line(text), F.concat(indent, name, F.lit(": "), text, F.lit("\n")))
        .when(kind == "text", multi)
        .when(kind == "binary", F.concat(indent, name, F.lit(": <binary file; "), C.format_metadata(meta), F.lit(">\n")))
        .when(
            kind == "too_large",
            F.concat(
                indent, name, F.lit(": <file too large; "), C.format_metadata(meta), F.lit("; limit: "),
                Q.format_bytes(limit), F.lit(">\n"),
            ),
        )
        .otherwise(F.concat(indent, name, F.lit(": <error: "), F.coalesce(error, F.lit("unknown error")), F.lit(">\n")))
    )


def blueprint_blocks(files: DataFrame, nodes: DataFrame, opts: ContentOptions | None = None,
                     max_size: int | None = None, no_content: bool = False) -> DataFrame:
    """(root, path, block) for every kept node (directories from ``nodes``, files inspected)."""
    indent = F.repeat(F.lit("  "), (F.size("path") - 1).cast("int"))
    name = F.element_at("path", -1)
    dirs = nodes.filter("is_dir").select("root", "path", F.concat(indent, name, F.lit("/\n")).alias("block"))
    if no_content:
        fl = nodes.filter(~F.col("is_dir")).select("root", "path", F.concat(indent, name, F.lit("\n")).alias("block"))
        return dirs.unionByName(fl)
    insp = inspect_files(files, max_size) if max_size is not None else inspect_files(files)
    shown = windowed(F.col("text"), opts)
    fl = insp.select(
        "root", "path",
        file_block(indent, name, F.col("kind"), shown, F.col("meta"), F.col("limit"), F.col("error")).alias("block"),
    )
    return dirs.unionByName(fl)


def blueprint_pieces(files: DataFrame, nodes: DataFrame, opts: ContentOptions | None = None,
                     max_size: int | None = None, no_content: bool = False, roots: DataFrame | None = None) -> DataFrame:
    """(root, seq, path, text): one piece per node, and an empty one for each of ``roots`` (the input's
    roots), so a root with nothing kept is present."""
    blocks = blueprint_blocks(files, nodes, opts, max_size, no_content)
    pieces = blocks.select("root", F.lit(1).alias("seq"), "path", F.col("block").alias("text"))
    if roots is None:
        return pieces
    none = F.array().cast("array<string>")
    start = roots.select("root").distinct()
    return pieces.unionByName(start.select("root", F.lit(0).alias("seq"), none.alias("path"), F.lit("").alias("text")))


def blueprint_render(files: DataFrame, nodes: DataFrame, opts: ContentOptions | None = None,
                     max_size: int | None = None, no_content: bool = False, roots: DataFrame | None = None) -> DataFrame:
    """(root, blueprint): the pieces of each root as one string."""
    from .ordering import concatenated

    return concatenated(blueprint_pieces(files, nodes, opts, max_size, no_content, roots), "blueprint")


# ---------------------------------------------------------------------------
# parse (op 48)
# ---------------------------------------------------------------------------


class BlueprintError(ValueError):
    pass


# Messages of the blueprint format.
MSG_TABS = "Tabs are not supported for indentation"
MSG_ODD = "Indentation must use multiples of two spaces"
MSG_DEEP = "Unexpected indentation on line {}"
MSG_EMPTY = "Tree entry names cannot be empty"
MSG_NESTED = "Nested paths are not supported inside a single tree entry: {}"
MSG_NULL = "Blueprint text is null"

_MARGIN = re.compile(r"[ \t]*")


class Line:
    """One line with what its margin says; ``end`` is the first later line that is no deeper."""

    __slots__ = ("body", "end", "level", "margin", "number", "raw", "skip")

    def __init__(self, number: int, raw: str):
        self.number, self.raw = number, raw
        self.margin = _MARGIN.match(raw).group()
        self.body = raw.strip()
        self.skip = not self.body or self.body[0] == "#"
        spaces = len(raw) - len(raw.lstrip(" "))
        self.level = spaces // 2 if self.body else None
        self.end = 0

    def check_margin(self) -> None:
        if "\t" in self.margin:
            raise BlueprintError(MSG_TABS)
        if len(self.margin) % 2:
            raise BlueprintError(MSG_ODD)


def _classified(text: str) -> list[Line]:
    """All lines with their levels and where their nested lines end (one sweep from the last line up)."""
    pieces = text.split("\n")
    if not pieces[-1]:
        pieces.pop()
    lines = [Line(n, piece.removesuffix("\r")) for n, piece in enumerate(pieces, 1)]
    later: list[int] = []  # positions of lines below, levels falling towards the top of the list
    for at in range(len(lines) - 1, -1, -1):
        line = lines[at]
        if line.level is None:
            continue
        while later and lines[later[-1]].level > line.level:
            later.pop()
        line.end = later[-1] if later else len(lines)
        later.append(at)
    return lines


def entry(text: str, lenient: bool) -> tuple[str, bool, str | None, bool]:
    """(name, is a directory, text on the line, text follows on deeper lines) of a header."""
    name, colon, value = text.partition(":")
    follows = bool(colon) and (value.strip() if lenient else value) == "|"
    name = name.strip()
    if not name:
        raise BlueprintError(MSG_EMPTY)
    is_dir = name.endswith("/")
    if "/" in name and not is_dir:
        raise BlueprintError(MSG_NESTED.format(name))
    return name.rstrip("/"), is_dir, None if follows or not colon else value.lstrip(), follows


def parse_blueprint(text: str, lenient: bool = True) -> list[tuple]:
    """-> [(path list, is_dir, content, line_no, parent_chain list)]; raises BlueprintError."""
    lines = _classified(text)
    nodes: list[tuple] = []
    inside: list[tuple[str, int]] = []  # the directories open above the current line, outermost first
    at = 0
    while at < len(lines):
        line = lines[at]
        at += 1
        if line.skip:
            continue
        line.check_margin()
        del inside[line.level :]
        if len(inside) < line.level:
            raise BlueprintError(MSG_DEEP.format(line.number))
        name, is_dir, content, follows = entry(line.raw.lstrip(), lenient)
        if follows:
            if not lenient:  # the lines of the text, and the one that ends it, need proper margins
                for other in lines[at : line.end + 1]:
                    if other.body:
                        other.check_margin()
            margin = 2 * (line.level + 1)
            content = "\n".join(other.raw[margin:] if other.body else "" for other in lines[at : line.end])
            at = line.end
        nodes.append(([*(n for n, _ in inside), name], is_dir, content, line.number, [n for _, n in inside]))
        if is_dir:
            inside.append((name, line.number))
    return nodes


# ---------------------------------------------------------------------------
# entries (op 49)
# ---------------------------------------------------------------------------


def blueprint_entries(parsed: DataFrame) -> DataFrame:
    """Nodes after duplicate resolution: per (id, path) the last occurrence wins; nodes whose
    ancestor occurrence lost are dropped with it. (blueprint_id, path, is_dir, content)."""
    nodes = parsed.filter(F.col("error").isNull())
    winners = nodes.groupBy("blueprint_id", "path").agg(F.max("line_no").alias("line_no"))
    won = nodes.join(winners, ["blueprint_id", "path", "line_no"], "left_semi")
    # every ancestor occurrence on the chain must itself be a winner
    anc = won.select("blueprint_id", "line_no", F.explode("chain").alias("anc"))
    lost = anc.join(
        winners.select("blueprint_id", F.col("line_no").alias("anc")), ["blueprint_id", "anc"], "left_anti"
    ).select("blueprint_id", "line_no").distinct()
    return won.join(lost, ["blueprint_id", "line_no"], "left_anti").select("blueprint_id", "path", "is_dir", "content")
