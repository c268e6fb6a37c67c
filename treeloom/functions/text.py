"""Text projections: line counts, line/character windows, fences (ops 22-25, 28-30).

Every function takes and returns Columns; option arguments may be Python values
(one setting for the whole table) or Columns (per-root settings, see
``operators.options``). Nothing here leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NL = "\n"


def _c(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _str(value) -> Column:
    return _c(value).cast("string")


def newline_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(NL), F.lit("")))


def line_count(text: Column) -> Column:
    """Lines as a line iterator sees them: 0 for '', a trailing newline adds none."""
    return (
        F.when(text == "", F.lit(0))
        .otherwise(newline_count(text) + F.when(text.endswith(NL), 0).otherwise(1))
        .cast("bigint")
    )


def head_lines(text: Column, n) -> Column:
    """First n lines (newlines kept) plus a marker, when the text has more than n lines."""
    if n is None:
        return text
    n = _c(n)
    cut = F.concat(
        F.call_function("substring_index", text, F.lit(NL), n),
        F.when(n > 0, F.lit(NL)).otherwise(F.lit("")),
    )
    marked = F.concat(cut, F.lit("[truncated after "), _str(n), F.lit(" lines]"))
    return F.when(n.isNull() | (line_count(text) <= n), text).otherwise(marked)


def tail_lines(text: Column, n) -> Column:
    """A marker plus the last n lines, when the text has more than n lines."""
    if n is None:
        return text
    n = _c(n)
    k = n + F.when(text.endswith(NL), 1).otherwise(0)
    cut = F.call_function("substring_index", text, F.lit(NL), -k)
    marked = F.concat(F.lit("[truncated to last "), _str(n), F.lit(" lines]\n"), cut)
    return F.when(n.isNull() | (line_count(text) <= n), text).otherwise(marked)


def take_chars(text: Column, n, from_end=False) -> Column:
    """Cut to n code points from the start (or the end) with a marker."""
    if n is None:
        return text
    n = _c(n)
    from_end = _c(from_end)
    start = F.concat(
        F.call_function("left", text, n), F.lit("\n[truncated after "), _str(n), F.lit(" characters]")
    )
    end = F.concat(
        F.lit("[truncated to last "), _str(n), F.lit(" characters]\n"), F.call_function("right", text, n)
    )
    return (
        F.when(n.isNull() | (F.length(text) <= n), text)
        .when(F.coalesce(from_end, F.lit(False)), end)
        .otherwise(start)
    )


def apply_window(text: Column, head=None, tail=None, max_chars=None, from_end=False) -> Column:
    """Head wins over tail; the character limit applies afterwards and counts their marker."""
    if isinstance(head, Column) or isinstance(tail, Column):
        lined = F.when(_c(head).isNotNull(), head_lines(text, head)).otherwise(tail_lines(text, tail))
    elif head is not None:
        lined = head_lines(text, head)
    elif tail is not None:
        lined = tail_lines(text, tail)
    else:
        lined = text
    return take_chars(lined, max_chars, from_end)


def fence_width(text: Column) -> Column:
    """max(3, longest backtick run + 1); texts without a run of three skip the regex (width 3)."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("`+"), 0), lambda r: F.length(r))
    slow = F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1)
    return F.when(~text.contains("```"), F.lit(3)).otherwise(slow).cast("bigint")


def fence(text: Column) -> Column:
    return F.repeat(F.lit("`"), fence_width(text).cast("int"))


def is_single_line(text: Column) -> Column:
    return ~text.contains("\n") & ~text.contains("\r")
