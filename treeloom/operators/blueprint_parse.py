"""Parsing blueprints (op 48) from ordered pieces, however large one blueprint is.

No task sees a whole blueprint. Pieces are range-partitioned by (blueprint, place)
and joined to chunks of about ``CHUNK`` characters that end with a line; a line cut
by the border of two partitions is put together from its fragments. What a line
means depends on two things that come from before: whether a text block is open,
and which directories are. Each chunk is a function of either, and these functions
compose, so two scans over small summaries replace reading in order:

1. Text blocks. The state is the level and the line of the open block's header (no
   block: a level above all). The first line that is no deeper than an incoming
   state ends it, whatever follows is then known; so a chunk's function is a list
   of ``(level, state)`` with falling levels.
2. Directories. A chunk keeps the first ``base`` of the open directories and opens
   ``names`` behind them.

Both scans compose the chunks of a partition first and then one summary per
partition, so the longest list that one task goes through is as long as the number
of partitions. Chunks are parsed with the first scan's state, and the second scan's
directories go in front of their paths by a join. A block of text that crosses
chunks is put together from one part per chunk.

Defined cases: the pieces of a blueprint_id (also a null one) are one text; an
empty text has no rows; a null piece or a line that cannot be parsed makes the
blueprint one error row, that of its first bad line.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .blueprint import MSG_DEEP, MSG_NULL, BlueprintError, Line, entry
from .joins import checked_broadcast, stored

CHUNK = 1 << 20
NO_BLOCK = 2**31 - 1
# Rows that a parsing task hands on at once.
PARSED_SLICE = 4096

CHUNK_SCHEMA = "key string, pid int, k int, before bigint, n_lines bigint, text string"
STATE = "struct<level:int,line:bigint>"
BLOCKS_SCHEMA = "key string, pid int, first_line bigint, steps array<struct<at:int,level:int,line:bigint>>"
PARSED = (
    "key string, pid int, first_line bigint, kind string, line_no bigint, base int, names array<string>, lines array<bigint>, "
    "is_dir boolean, content string, block boolean, unfinished boolean"
)


# --- chunks ------------------------------------------------------------------


def _chunks(chunk: int) -> Callable:
    """Joins consecutive pieces of a blueprint to chunks; all but the last of a run end with a newline."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        key, held, size, limit, k, before = None, [], 0, chunk, 0, 0
        names = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]
        types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]

        def made(text: str) -> pa.RecordBatch:
            nonlocal k, before
            row = [key, pid, k, before, text.count("\n"), text]
            k, before = k + 1, before + row[4]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

        for batch in batches:
            for new, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                if new != key:
                    if size:
                        yield made("".join(held))
                    key, held, size, limit, k, before = new, [], 0, chunk, 0, 0
                held.append(text)
                size += len(text)
                if size >= limit:
                    whole = "".join(held)
                    cut = whole.rfind("\n") + 1
                    if cut:
                        yield made(whole[:cut])
                    held, size = [whole[cut:]], len(whole) - cut
                    limit = max(chunk, 2 * size)  # a line longer than a chunk is not joined again and again
        if size:
            yield made("".join(held))

    return run


def _whole_lines(chunks: DataFrame) -> DataFrame:
    """(key, pid, first_line, text): chunks of whole lines with the number of their first line."""
    runs = chunks.groupBy("key", "pid").agg(
        F.sum("n_lines").alias("n"), F.max_by(F.col("text").endswith("\n"), "k").alias("ends"), F.max("k").alias("last")
    )
    order = Window.partitionBy("key").orderBy("pid")  # one row per partition
    runs = runs.select(
        "key", "pid", "last",
        F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"),
        F.coalesce(~F.lag("ends").over(order), F.lit(False)).alias("mid"),
    )
    rows = chunks.join(checked_broadcast(runs), ["key", "pid"])
    newline = F.instr("text", "\n") > 0
    head = F.when(newline, F.concat(F.substring_index("text", "\n", 1), F.lit("\n"))).otherwise(F.col("text"))
    rows = rows.withColumn("head", F.when(F.col("mid") & (F.col("k") == 0), head).otherwise(F.lit("")))
    rows = rows.withColumn("body", F.substr("text", F.length("head") + 1))
    tail = F.when((F.col("k") == F.col("last")) & ~F.col("body").endswith("\n"), F.substring_index("body", "\n", -1))
    rows = rows.withColumn("tail", F.coalesce(tail, F.lit("")))
    at = F.col("earlier") + F.col("before") + 1
    inside = rows.select(
        "key", "pid", (at + F.when(F.col("head").endswith("\n"), 1).otherwise(0)).alias("first_line"),
        F.substr("body", F.lit(1), F.length("body") - F.length("tail")).alias("text"),
    )
    fragment = lambda line, part, text: F.struct(line.alias("first_line"), F.lit(part).alias("part"), text.alias("text"))
    cut = rows.filter((F.col("head") != "") | (F.col("tail") != "")).select(
        "key", "pid",
        F.inline(F.array(fragment(at, 0, F.col("head")), fragment(at + F.col("n_lines"), 1, F.col("tail")))),
    )
    mended = cut.filter("text <> ''").groupBy("key", "first_line").agg(
        F.min("pid").alias("pid"), F.expr("listagg(text, '') WITHIN GROUP (ORDER BY struct(pid, part))").alias("text")
    )
    return inside.filter("text <> ''").unionByName(mended)


# --- scans over summaries -----------------------------------------------------


def _scan(summaries: DataFrame, fields: str, compose: Callable, apply: Callable, start, state: str) -> DataFrame:
    """(key, first_line, state): what reaches each chunk when the summaries before it are applied to ``start``.

    Composes the chunks of each (key, pid), then runs along the partitions of a
    key, then along the chunks of each partition.
    """
    columns = fields.split(", ")
    unpacked = lambda pdf: [tuple(r) for r in pdf[columns].itertuples(index=False, name=None)]

    def run_of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first_line")
        whole = None
        for summary in unpacked(pdf):
            whole = summary if whole is None else compose(whole, summary)
        return pd.DataFrame([(pdf["key"].iloc[0], pdf["pid"].iloc[0], pdf["first_line"].iloc[0], *whole)], columns=names)

    def along(pdf: pd.DataFrame, begin) -> list:
        reached, out = begin, []
        for summary in unpacked(pdf):
            out.append(reached)
            reached = apply(summary, reached)
        return out

    def partitions_of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pid")
        return pd.DataFrame({"key": pdf["key"], "pid": pdf["pid"], "begin": along(pdf, start)})

    def chunks_of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first_line")
        begin = pdf["begin"].iloc[0]
        begin = {k: list(v) if hasattr(v, "tolist") else v for k, v in (begin if isinstance(begin, dict) else begin.asDict()).items()}
        return pd.DataFrame({"key": pdf["key"], "first_line": pdf["first_line"], "state": along(pdf, begin)})

    names = summaries.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in summaries.schema)
    runs = summaries.groupBy("key", "pid").applyInPandas(run_of, schema)
    begins = runs.groupBy("key").applyInPandas(partitions_of, f"key string, pid int, begin {state}")
    each = summaries.join(begins, ["key", "pid"])
    return each.groupBy("key", "pid").applyInPandas(chunks_of, f"key string, first_line bigint, state {state}")


def _step(step) -> tuple[int, int, int]:
    return (step["at"], step["level"], step["line"])


def _block_applied(summary: tuple, state: dict) -> dict:
    for at, level, line in map(_step, summary[0]):
        if at <= state["level"]:
            return {"level": int(level), "line": int(line)}
    return state


def _blocks_composed(first: tuple, second: tuple) -> tuple:
    steps = []
    for at, level, line in map(_step, first[0]):
        after = _block_applied(second, {"level": level, "line": line})
        steps.append({"at": int(at), "level": after["level"], "line": after["line"]})
    lowest = steps[-1]["at"] if steps else NO_BLOCK + 1
    return ([*steps, *[{"at": int(a), "level": int(b), "line": int(c)} for a, b, c in map(_step, second[0]) if a < lowest]],)


def _dirs_applied(summary: tuple, state: dict) -> dict:
    base, names, lines = summary
    return {"names": [*state["names"][:base], *names], "lines": [*state["lines"][:base], *map(int, lines)]}


def _dirs_composed(first: tuple, second: tuple) -> tuple:
    base, names, lines = first
    if second[0] <= base:
        return second
    kept = second[0] - base
    return base, [*names[:kept], *second[1]], [*map(int, lines[:kept]), *map(int, second[2])]


# --- chunks of lines ----------------------------------------------------------


def lines_of(text: str, first: int) -> list[Line]:
    pieces = text.split("\n")
    if not pieces[-1]:
        pieces.pop()
    return [Line(n, piece.removesuffix("\r")) for n, piece in enumerate(pieces, first)]


def _opens(line: Line, lenient: bool) -> bool:
    """Whether the line, read as a header, opens a block of text."""
    if line.skip or not line.body.endswith("|"):
        return False
    try:
        return entry(line.raw.lstrip(), lenient)[3]
    except BlueprintError:
        return False


def block_steps(text: str, first: int, lenient: bool) -> list[dict]:
    """A chunk's function on text blocks: from the first line no deeper than ``at`` on, ``(level, line)`` is the end state."""
    lines = [x for x in lines_of(text, first) if x.level is not None]
    ends: list[tuple[int, int]] = [(NO_BLOCK, 0)] * len(lines)
    later: list[int] = []  # positions below, levels falling towards the end of the list
    for at in range(len(lines) - 1, -1, -1):
        line = lines[at]
        while later and lines[later[-1]].level > line.level:
            later.pop()
        if _opens(line, lenient):
            ends[at] = ends[later[-1]] if later else (line.level, line.number)
        elif at + 1 < len(lines):
            ends[at] = ends[at + 1]
        later.append(at)
    steps = []
    for line, (level, number) in zip(lines, ends):
        if not steps or line.level < steps[-1]["at"]:
            steps.append({"at": line.level, "level": level, "line": number})
    return steps


def parse_chunk(text: str, first: int, level: int, owner: int, lenient: bool) -> list[tuple]:
    """Rows of a chunk as ``(kind, line_no, base, names, lines, is_dir, content, block, unfinished)``.

    ``level`` and ``owner`` are the open block that reaches the chunk. Kinds: ``node``
    (its names behind the first ``base`` open directories), ``text`` (a part of the
    block that line_no heads, each line closed by a newline), ``error``, and one
    ``dirs`` (the directories that the chunk leaves open).
    """
    rows: list[tuple] = []
    base, names, numbers = NO_BLOCK, [], []
    held: list[str] = []  # the open block's lines
    header = None if level == NO_BLOCK else ("text", owner, None, None, None, None)

    def close(unfinished: bool) -> None:
        nonlocal header
        if header is not None:
            rows.append((*header, "".join([x + "\n" for x in held]), True, unfinished))
            held.clear()
            header = None

    try:
        for line in lines_of(text, first):
            if line.level is None or line.level > level and level != NO_BLOCK:
                if header is not None:
                    if line.body and not lenient:
                        line.check_margin()
                    held.append(line.raw[2 * (level + 1) :] if line.body else "")
                continue
            if header is not None:
                close(False)
                if not lenient:
                    line.check_margin()
            level = NO_BLOCK
            if line.skip:
                continue
            line.check_margin()
            if line.level < base:
                base, names, numbers = line.level, [], []
            inner = line.level - base
            del names[inner:], numbers[inner:]
            if len(names) < inner:
                raise BlueprintError(MSG_DEEP.format(line.number))
            name, is_dir, content, follows = entry(line.raw.lstrip(), lenient)
            row = ("node", line.number, base, [*names, name], list(numbers), is_dir)
            if follows:
                header, level = row, line.level
            else:
                rows.append((*row, content, False, False))
            if is_dir:
                names.append(name)
                numbers.append(line.number)
        close(True)
    except BlueprintError as e:
        rows.append(("error", line.number, None, None, None, None, str(e), False, False))
    rows.append(("dirs", first, base, names, numbers, None, None, False, False))
    return rows


# --- the whole parse ----------------------------------------------------------


def parse_pieces(pieces: DataFrame, order: tuple[str, ...] = ("seq", "path"), lenient: bool = True, chunk: int = CHUNK) -> DataFrame:
    """(blueprint_id, path, is_dir, content, line_no, chain, error) from ``pieces(blueprint_id, *order, text)``.

    The pieces of a blueprint, joined by ``order``, are its text; they may be cut anywhere.
    """
    spark = pieces.sparkSession
    ship_package(spark)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism)
    key = F.when(F.col("blueprint_id").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("blueprint_id").cast("string")))
    keyed = stored(pieces.select(key.alias("key"), *order, "text"), "pieces")
    ranged = keyed.filter("text <> ''").repartitionByRange(n, "key", *order).sortWithinPartitions("key", *order)
    chunks = stored(ranged.select("key", "text").mapInArrow(_chunks(chunk), CHUNK_SCHEMA), "chunks")
    lines = _whole_lines(chunks)

    def summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("at", pa.int32()), ("level", pa.int32()), ("line", pa.int64())]))
        for batch in batches:
            steps = [block_steps(t, f, lenient) for t, f in zip(batch.column("text").to_pylist(), batch.column("first_line").to_pylist())]
            columns = [batch.column(c) for c in ("key", "pid", "first_line")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(steps, kind)], names=["key", "pid", "first_line", "steps"])

    summaries = stored(lines.mapInArrow(summarised, BLOCKS_SCHEMA), "blocks")
    blocks = _scan(summaries, "steps", _blocks_composed, _block_applied, {"level": NO_BLOCK, "line": 0}, STATE)
    known = lines.join(checked_broadcast(blocks.select("key", "first_line", "state.level", "state.line")), ["key", "first_line"])
    fields = [c.strip().split()[0] for c in PARSED.split(", ")]
    schema = pa.schema(
        [("key", pa.string()), ("pid", pa.int32()), ("first_line", pa.int64()), ("kind", pa.string()), ("line_no", pa.int64()),
         ("base", pa.int32()), ("names", pa.list_(pa.string())), ("lines", pa.list_(pa.int64())), ("is_dir", pa.bool_()),
         ("content", pa.string()), ("block", pa.bool_()), ("unfinished", pa.bool_())]
    )

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = parse_chunk(row["text"], row["first_line"], row["level"], row["line"], lenient)
                for at in range(0, len(found), PARSED_SLICE):
                    part = [(row["key"], row["pid"], row["first_line"], *x) for x in found[at : at + PARSED_SLICE]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v, t) for v, t in zip(zip(*part), schema.types)], names=fields
                    )

    rows = stored(known.mapInArrow(parsed, PARSED), "parsed")
    dirs = rows.filter("kind = 'dirs'").select("key", "pid", "first_line", "base", "names", "lines")
    stacks = _scan(dirs, "base, names, lines", _dirs_composed, _dirs_applied, {"names": [], "lines": []},
                   "struct<names:array<string>,lines:array<bigint>>")
    stacks = checked_broadcast(stacks.select("key", "first_line", F.col("state.names").alias("outer"), F.col("state.lines").alias("outer_lines")))
    nodes = rows.filter("kind = 'node'").join(stacks, ["key", "first_line"])
    deep = nodes.filter(F.col("base") > F.size("outer")).select(
        "key", "line_no", F.concat(*_around(MSG_DEEP, F.col("line_no").cast("string"))).alias("error")
    )
    errors = (
        deep.unionByName(rows.filter("kind = 'error'").select("key", "line_no", F.col("content").alias("error")))
        .unionByName(keyed.filter("text IS NULL").select("key", F.lit(0).cast("bigint").alias("line_no"), F.lit(MSG_NULL).alias("error")))
        .groupBy("key").agg(F.min_by("error", "line_no").alias("error"))
    )
    errors = checked_broadcast(errors)
    # a block that its chunk leaves open goes on in later chunks: one part from each
    parts = rows.filter("kind = 'text'").groupBy("key", "line_no").agg(
        F.expr("listagg(content, '') WITHIN GROUP (ORDER BY first_line)").alias("rest")
    )
    crossing = nodes.filter("unfinished").join(parts, ["key", "line_no"], "left")
    crossing = crossing.withColumn("content", F.concat("content", F.coalesce("rest", F.lit("")))).drop("rest")
    whole = nodes.filter("NOT unfinished").unionByName(crossing).join(errors, "key", "left_anti")
    content = F.when(F.col("block"), F.expr("substring(content, 1, greatest(length(content) - 1, 0))")).otherwise(F.col("content"))
    good = whole.select(
        "key",
        F.concat(F.slice("outer", F.lit(1), F.col("base")), "names").alias("path"),
        "is_dir",
        content.alias("content"),
        "line_no",
        F.concat(F.slice("outer_lines", F.lit(1), F.col("base")), "lines").alias("chain"),
        F.lit(None).cast("string").alias("error"),
    )
    empty = {"path": "array<string>", "is_dir": "boolean", "content": "string", "line_no": "bigint", "chain": "array<bigint>"}
    bad = errors.select("key", *[F.lit(None).cast(t).alias(c) for c, t in empty.items()], "error")
    out = good.unionByName(bad)
    found = F.when(F.col("key") != "0", F.expr("substring(key, 2)"))
    return out.select(found.alias("blueprint_id"), *[c for c in out.columns if c != "key"])


def _around(message: str, value) -> list:
    before, after = message.split("{}")
    return [F.lit(before), value, F.lit(after)]


def blueprint_parse(blueprints: DataFrame, lenient: bool = True) -> DataFrame:
    """``parse_pieces`` of whole texts ``(blueprint_id, text)``, one a blueprint."""
    return parse_pieces(blueprints.select("blueprint_id", F.lit(0).alias("seq"), "text"), ("seq",), lenient)
