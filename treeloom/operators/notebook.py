"""Notebook corpus (ops 43-46): .ipynb JSON text -> cells, outputs, Markdown.

Everything is a row-wise JVM expression over ``VARIANT`` (``try_parse_json``,
``try_variant_get``, higher-order ``transform``): a notebook is one row, bounded
by its file size, so rendering needs neither explode nor shuffle. Text that is
not JSON or has no ``cells`` array is not a notebook (null), and the caller
falls back to the plain file content.

``application/json`` outputs are printed with two blanks a level and sorted keys
(``pretty_json``), in the same expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as TX
from .inspect import ContentOptions, windowed

_ANSI = "\u001b\\[[0-9;?]*[ -/]*[@-~]"


# Marks of a JSON text whose running sum is formed together.
_TOGETHER = 64


def _let(value: Column, body) -> Column:
    """``body`` over ``value`` evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running_sum(values: Column) -> Column:
    """Sums up to each place: those of whole blocks before it, and of its own block up to it."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    before = lambda all_, i: F.slice(all_, F.lit(1), i)
    starts = F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), F.lit(_TOGETHER))
    sums = F.transform(starts, lambda at: total(F.slice(values, at + 1, F.lit(_TOGETHER))))

    def within(earlier: Column) -> Column:
        def up_to(_, i: Column) -> Column:
            inside = i % _TOGETHER
            return F.get(earlier, F.floor(i / _TOGETHER).cast("int")) + total(F.slice(values, i - inside + 1, inside + 1))

        return F.transform(values, up_to)

    return _let(sums, lambda s: _let(F.transform(s, lambda _, j: total(before(s, j))), within))


def pretty_json(compact: Column) -> Column:
    """A compact JSON text with a line for each member and two blanks a level; empty lists and objects stay closed.

    Escaped backslashes and quotes are covered first by control characters, which
    no JSON text holds as they are, so a string is what stands between two quotes.
    The level at each mark is a running sum of opening and closing marks outside of
    strings. Escapes of control characters get lower-case digits.
    """
    covered = F.replace(F.replace(compact, F.lit("\\\\"), F.lit("\u0001")), F.lit('\\"'), F.lit("\u0002"))
    for digit in "ABCDEF":
        covered = F.regexp_replace(covered, rf"\\u00([01]){digit}", rf"\\u00$1{digit.lower()}")
    marks = F.regexp_extract_all(covered, F.lit(r'"[^"]*"|[\[\]{},:]|[^\[\]{},:"]+'), F.lit(0))
    opens = lambda t: t.isin("{", "[")
    closes = lambda t: t.isin("}", "]")

    def laid_out(all_: Column, level: Column) -> Column:
        def placed(t: Column, i: Column) -> Column:
            line = F.concat(F.lit("\n"), F.repeat(F.lit("  "), F.get(level, i)))
            empty = F.when(opens(t), closes(F.get(all_, i + 1))).otherwise(opens(F.get(all_, i - 1)))
            return (
                F.when(opens(t), F.when(empty, t).otherwise(F.concat(t, line)))
                .when(closes(t), F.when(F.coalesce(empty, F.lit(False)), t).otherwise(F.concat(line, t)))
                .when(t == ",", F.concat(t, line)).when(t == ":", F.lit(": ")).otherwise(t)
            )

        return F.array_join(F.transform(all_, placed), "")

    change = lambda t: F.when(opens(t), 1).when(closes(t), -1).otherwise(0)
    levels = lambda all_: _let(F.transform(all_, change), _running_sum)
    laid = _let(marks, lambda all_: _let(levels(all_), lambda level: laid_out(all_, level)))
    return F.replace(F.replace(laid, F.lit("\u0002"), F.lit('\\"')), F.lit("\u0001"), F.lit("\\\\"))


def joined_text(v: Column) -> Column:
    """string -> itself; array -> its string elements concatenated; null/missing -> ''; other -> JSON."""
    kind = F.schema_of_variant(v)
    arr = F.try_variant_get(v, "$", "array<variant>")
    strings = F.transform(
        arr, lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))
    )
    return (
        F.when(v.isNull() | (kind == "VOID"), F.lit(""))
        .when(kind == "STRING", F.try_variant_get(v, "$", "string"))
        .when(kind.startswith("ARRAY"), F.array_join(strings, ""))
        .otherwise(F.to_json(v))
    )


def strip_ansi(t: Column) -> Column:
    return F.regexp_replace(t, _ANSI, "")


def _ends_nl(t: Column) -> Column:
    return t.endswith("\n")


def fenced_block(text: Column, language: Column | str) -> Column:
    lang = F.lit(language) if isinstance(language, str) else language
    fence = TX.fence(text)
    return F.concat(
        F.lit("\n"), fence, lang, F.lit("\n"), text, F.when(_ends_nl(text), F.lit("")).otherwise(F.lit("\n")),
        fence, F.lit("\n"),
    )


def labeled_block(label: str, text: Column, language: str) -> Column:
    return F.concat(F.lit("\n" + label + "\n"), fenced_block(text, language))


def _newline_after(prefix_ends_nl: bool, text: Column) -> Column:
    """Newline needed so that (prefix + text) ends with one."""
    if prefix_ends_nl:
        return F.when((text == "") | _ends_nl(text), F.lit("")).otherwise(F.lit("\n"))
    return F.when(_ends_nl(text), F.lit("")).otherwise(F.lit("\n"))


def notebook_language(nb: Column) -> Column:
    """language_info.name, else kernelspec.language, else python if kernelspec.name mentions it, else text."""
    info = F.try_variant_get(nb, "$.metadata.language_info.name", "string")
    spec_lang = F.try_variant_get(nb, "$.metadata.kernelspec.language", "string")
    spec_name = F.try_variant_get(nb, "$.metadata.kernelspec.name", "string")
    info_ok = F.when(F.schema_of_variant(F.try_variant_get(nb, "$.metadata.language_info.name", "variant")) == "STRING", info)
    lang_ok = F.when(F.schema_of_variant(F.try_variant_get(nb, "$.metadata.kernelspec.language", "variant")) == "STRING", spec_lang)
    name_ok = F.when(
        (F.schema_of_variant(F.try_variant_get(nb, "$.metadata.kernelspec.name", "variant")) == "STRING")
        & F.lower(spec_name).contains("python"),
        F.lit("python"),
    )
    raw = F.coalesce(info_ok, lang_ok, name_ok, F.lit("text"))
    norm = F.lower(F.regexp_replace(raw, "(?U)^\\s+|\\s+$", ""))
    return F.when(norm.startswith("python"), F.lit("python")).otherwise(F.regexp_extract(norm, "^[a-z0-9+#]*", 0))


def render_output(o: Column) -> Column:
    otype = F.coalesce(F.when(F.schema_of_variant(F.try_variant_get(o, "$.output_type", "variant")) == "STRING",
                              F.try_variant_get(o, "$.output_type", "string")), F.lit(""))
    is_stderr = F.coalesce(F.try_variant_get(o, "$.name", "string") == "stderr", F.lit(False))
    stream_text = strip_ansi(joined_text(F.try_variant_get(o, "$.text", "variant")))
    stream = _let(
        stream_text,
        lambda t: F.when(is_stderr, labeled_block("**Standard error:**", t, "")).otherwise(labeled_block("**Output:**", t, "")),
    )
    ename = F.coalesce(
        F.when(F.schema_of_variant(F.try_variant_get(o, "$.ename", "variant")) == "STRING", F.try_variant_get(o, "$.ename", "string")),
        F.lit("Error"),
    )
    evalue = F.coalesce(
        F.when(F.schema_of_variant(F.try_variant_get(o, "$.evalue", "variant")) == "STRING", F.try_variant_get(o, "$.evalue", "string")),
        F.lit(""),
    )
    error = F.concat(
        F.lit("\n**Error:** "), ename,
        F.when(evalue != "", F.concat(F.lit(": "), strip_ansi(evalue))).otherwise(F.lit("")), F.lit("\n"),
    )
    data = F.try_variant_get(o, "$.data", "map<string,variant>")
    md = joined_text(F.element_at(data, F.lit("text/markdown")))
    plain = strip_ansi(joined_text(F.element_at(data, F.lit("text/plain"))))
    js = pretty_json(F.to_json(F.element_at(data, F.lit("application/json"))))
    html = joined_text(F.element_at(data, F.lit("text/html")))
    image = F.try_element_at(F.filter(F.array_sort(F.map_keys(data)), lambda k: k.startswith("image/")), F.lit(1))
    rich = (
        F.when(data.isNull(), F.lit(""))
        .when(F.map_contains_key(data, "text/markdown"), _let(md, lambda t: F.concat(F.lit("\n**Output:**\n\n"), t, _newline_after(True, t))))
        .when(F.map_contains_key(data, "text/plain"), _let(plain, lambda t: labeled_block("**Output:**", t, "")))
        .when(F.map_contains_key(data, "application/json"), _let(js, lambda t: labeled_block("**Output:**", t, "json")))
        .when(F.map_contains_key(data, "text/html"), _let(html, lambda t: labeled_block("**Output:**", t, "html")))
        .when(image.isNotNull(), F.concat(F.lit("\n**Output:** ["), image, F.lit(" image omitted]\n")))
        .otherwise(F.lit(""))
    )
    return (
        F.when(otype == "stream", stream)
        .when(otype == "error", error)
        .when(otype.isin("execute_result", "display_data", "update_display_data"), rich)
        .otherwise(F.lit(""))
    )


def cell_type_of(c: Column) -> Column:
    t = F.try_variant_get(c, "$.cell_type", "variant")
    return F.coalesce(F.when(F.schema_of_variant(t) == "STRING", F.try_variant_get(c, "$.cell_type", "string")), F.lit("unknown"))


def render_cell(c: Column, i: Column, language: Column) -> Column:
    ctype = cell_type_of(c)
    source = joined_text(F.try_variant_get(c, "$.source", "variant"))
    outputs = F.try_variant_get(c, "$.outputs", "array<variant>")
    outs = F.coalesce(F.array_join(F.transform(outputs, render_output), ""), F.lit(""))
    body = (
        F.when(ctype == "markdown", F.concat(F.lit("\n"), source, _newline_after(True, source)))
        .when(ctype == "code", F.concat(fenced_block(source, language), outs))
        .otherwise(fenced_block(source, "text"))
    )
    return F.concat(F.lit("### Cell "), (i + 1).cast("string"), F.lit(" ("), ctype, F.lit(")\n"), body, F.lit("\n"))


def parse_notebook(text: Column) -> Column:
    return F.try_parse_json(text)


def notebook_cells_array(nb: Column) -> Column:
    return F.try_variant_get(nb, "$.cells", "array<variant>")


def render_notebook_text(text: Column) -> Column:
    """Rendered notebook (right-trimmed), or null when the text is not a notebook."""
    nb = parse_notebook(text)
    cells = notebook_cells_array(nb)
    lang = notebook_language(nb)
    rendered = F.array_join(F.transform(cells, lambda c, i: render_cell(c, i, lang)), "")
    return F.when(cells.isNotNull(), F.regexp_replace(rendered, "(?U)\\s+\\z", ""))


def render_notebook_column(text: Column, opts: ContentOptions | None = None) -> Column:
    """Op 45: rendered notebook with the content window applied afterwards."""
    return _let(render_notebook_text(text), lambda r: F.when(r.isNotNull(), windowed(r, opts)))


# --- DataFrame operators ---------------------------------------------------


def notebook_cells(nbs: DataFrame) -> DataFrame:
    """Op 43: (root, path, cell_no, cell_type, source) — one row per cell (row-wise generator)."""
    cells = notebook_cells_array(parse_notebook(F.col("text")))
    return nbs.select("root", "path", F.posexplode(cells).alias("pos", "cell")).select(
        "root",
        "path",
        (F.col("pos") + 1).cast("bigint").alias("cell_no"),
        cell_type_of(F.col("cell")).alias("cell_type"),
        joined_text(F.try_variant_get(F.col("cell"), "$.source", "variant")).alias("source"),
    )


def notebook_outputs(nbs: DataFrame) -> DataFrame:
    """Op 44: (root, path, cell_no, out_no, block) for the outputs of code cells."""
    cells = notebook_cells_array(parse_notebook(F.col("text")))
    per_cell = nbs.select("root", "path", F.posexplode(cells).alias("pos", "cell"))
    outs = per_cell.filter(cell_type_of(F.col("cell")) == "code").select(
        "root", "path", "pos", F.posexplode(F.try_variant_get(F.col("cell"), "$.outputs", "array<variant>")).alias("opos", "o")
    )
    return outs.select(
        "root",
        "path",
        (F.col("pos") + 1).cast("bigint").alias("cell_no"),
        (F.col("opos") + 1).cast("bigint").alias("out_no"),
        render_output(F.col("o")).alias("block"),
    )


def notebook_render(nbs: DataFrame, opts: ContentOptions | None = None) -> DataFrame:
    """Op 45: (root, path, rendered)."""
    return nbs.select("root", "path", render_notebook_column(F.col("text"), opts).alias("rendered"))


def notebook_language_of(nbs: DataFrame) -> DataFrame:
    """Op 46: (root, path, language)."""
    return nbs.select("root", "path", notebook_language(parse_notebook(F.col("text"))).alias("language"))
