"""DuckDB SQL fragments for the oracle queries (views of FIXTURES §3 and shared expressions).

Only the *data* (patterns, signature and extension tables) is shared with the
Spark side; every expression here is written separately in DuckDB's dialect.
"""

from __future__ import annotations

from ..functions import constants as K
from ..functions.quantities import SIZE_UNITS
from ..operators.rules import DEFAULT_RULES, RuleSet


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


NL = "chr(10)"

DOC_DIR = (
    "CASE CAST(doc_id % 10 AS INT) WHEN 0 THEN 'node_modules' WHEN 3 THEN '.cache' WHEN 4 THEN 'src-x' "
    "WHEN 5 THEN 'target' WHEN 6 THEN 'public' ELSE 'src' END"
)
DOC_NAME = (
    "concat(CASE WHEN doc_id % 13 = 0 THEN '.env.' ELSE 'd' END, CAST(doc_id AS VARCHAR), "
    "CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN '.log' WHEN 1 THEN '.md' WHEN 2 THEN '.PDF' "
    "WHEN 3 THEN '.local' ELSE '' END)"
)
DOC_TXT = (
    "CASE CAST(doc_id % 8 AS INT) "
    "WHEN 0 THEN concat(text, chr(10)) "
    "WHEN 1 THEN concat('```', chr(10), text, chr(10), '````') "
    "WHEN 2 THEN '' "
    "WHEN 3 THEN replace(text, ' ', chr(9)) "
    "WHEN 4 THEN concat(chr(1), chr(2), chr(27), substring(text, 1, 120)) "
    "WHEN 5 THEN replace(text, chr(10), concat(chr(13), chr(10))) "
    "WHEN 6 THEN replace(text, chr(10), ' ') "
    "ELSE text END"
)

VIEWS = {
    "doc_files": f"""doc_files AS (
  SELECT source AS root, [lang, {DOC_DIR}, {DOC_NAME}] AS path,
         concat_ws('/', lang, {DOC_DIR}, {DOC_NAME}) AS rel, {DOC_TXT} AS text, doc_id
  FROM documents)""",
    "page_files": """page_files AS (
  SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS root,
         list_filter(string_split(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/'), lambda c: c <> '') AS path,
         html AS text, page_id
  FROM pages)""",
}


def closure_sql(source: str, name: str) -> str:
    """CTE `name`: (root, path, is_dir, rel, depth) closure of the files in `source`."""
    return f"""{name} AS (
  SELECT root, p AS path, bool_or(d) AS is_dir, array_to_string(p, '/') AS rel, len(p) AS depth
  FROM (SELECT root, path[1:k] AS p, (k < len(path)) AS d
        FROM (SELECT root, path, unnest(range(1, len(path) + 1)) AS k FROM {source} WHERE len(path) > 0))
  GROUP BY root, p)"""


def with_views(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# ---------------------------------------------------------------------------
# rules
# ---------------------------------------------------------------------------


def _in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def _or(conds):
    conds = [c for c in conds if c]
    return "(" + " OR ".join(conds) + ")" if conds else "false"


def excluded_sql(rules: RuleSet, path: str = "path", is_dir: str = "is_dir") -> str:
    if not rules.globs:
        return "false"
    lit_all, lit_dir, rx_all, rx_dir, full_all, full_dir = rules.parts()

    def comp(c, lits, rx):
        conds = []
        if lits:
            conds.append(f"{c} IN {_in_list(lits)}")
        if rx:
            conds.append(f"regexp_matches({c}, {q(rx)})")
        return _or(conds)

    terms = []
    if lit_all or rx_all:
        terms.append(f"coalesce(list_bool_or([{comp('c', lit_all, rx_all)} for c in {path}]), false)")
    if lit_dir or rx_dir:
        terms.append(
            f"coalesce(list_bool_or([{comp('c', lit_dir, rx_dir)} for c in {path}[1:len({path}) - 1]]), false)"
        )
        terms.append(f"({is_dir} AND {comp(f'{path}[len({path})]', lit_dir, rx_dir)})")
    if full_all or full_dir:
        inner = []
        if full_all:
            inner.append(f"regexp_matches(array_to_string({path}[1:k], '/'), {q(full_all)})")
        if full_dir:
            inner.append(
                f"((k < len({path}) OR {is_dir}) AND regexp_matches(array_to_string({path}[1:k], '/'), {q(full_dir)}))"
            )
        terms.append(f"coalesce(list_bool_or([{_or(inner)} for k in range(1, len({path}) + 1)]), false)")
    return _or(terms)


def hidden_sql(path: str = "path") -> str:
    return f"coalesce(list_bool_or([starts_with(c, '.') for c in {path}]), false)"


def keep_sql(path="path", is_dir="is_dir", include_hidden=False, all_=False, exclude=()) -> str:
    rules = RuleSet.of(list(exclude))
    if not all_:
        rules = DEFAULT_RULES + rules
    cond = f"NOT {excluded_sql(rules, path, is_dir)}"
    if not (include_hidden or all_):
        cond += f" AND NOT {hidden_sql(path)}"
    return cond


# ---------------------------------------------------------------------------
# text
# ---------------------------------------------------------------------------


def nl_count(t: str) -> str:
    return f"(length({t}) - length(replace({t}, chr(10), '')))"


def line_count(t: str) -> str:
    return f"CAST(CASE WHEN {t} = '' THEN 0 ELSE {nl_count(t)} + CASE WHEN ends_with({t}, chr(10)) THEN 0 ELSE 1 END END AS BIGINT)"


def head_lines(t: str, n: int | None) -> str:
    if n is None:
        return t
    cut = f"array_to_string(string_split({t}, chr(10))[1:{n}], chr(10))" + (" || chr(10)" if n > 0 else "")
    return f"(CASE WHEN {line_count(t)} <= {n} THEN {t} ELSE {cut} || '[truncated after {n} lines]' END)"


def tail_lines(t: str, n: int | None) -> str:
    if n is None:
        return t
    parts = f"string_split({t}, chr(10))"
    start = f"(len({parts}) - {n} + CASE WHEN ends_with({t}, chr(10)) THEN 0 ELSE 1 END)"
    cut = f"array_to_string({parts}[{start}:len({parts})], chr(10))"
    return f"(CASE WHEN {line_count(t)} <= {n} THEN {t} ELSE '[truncated to last {n} lines]' || chr(10) || {cut} END)"


def take_chars(t: str, n: int | None, from_end: bool = False) -> str:
    if n is None:
        return t
    if from_end:
        cut = f"'[truncated to last {n} characters]' || chr(10) || right({t}, {n})"
    else:
        cut = f"left({t}, {n}) || chr(10) || '[truncated after {n} characters]'"
    return f"(CASE WHEN length({t}) <= {n} THEN {t} ELSE {cut} END)"


def window(t: str, head=None, tail=None, max_chars=None, from_end=False) -> str:
    if head is not None:
        t = head_lines(t, head)
    elif tail is not None:
        t = tail_lines(t, tail)
    return take_chars(t, max_chars, from_end)


def fence_width(t: str) -> str:
    return f"CAST(greatest(3, coalesce(list_max([length(r) for r in regexp_extract_all({t}, '`+')]), 0) + 1) AS BIGINT)"


def fence(t: str) -> str:
    return f"repeat('`', {fence_width(t)})"


def single_line(t: str) -> str:
    return f"(NOT contains({t}, chr(10)) AND NOT contains({t}, chr(13)))"


# ---------------------------------------------------------------------------
# quantities
# ---------------------------------------------------------------------------


def format_count(n: str) -> str:
    return f"format('{{:,}}', CAST({n} AS BIGINT))"


def format_bytes(n: str) -> str:
    return f"({format_count(n)} || CASE WHEN {n} = 1 THEN ' byte' ELSE ' bytes' END)"


def format_size(n: str) -> str:
    branches = []
    for i, unit in enumerate(SIZE_UNITS):
        power = 1024 ** (i + 1)
        branches.append((power * 1024, f"printf('%.1f', {n} / {float(power)}) || ' {unit}'"))
    case = "CASE " + " ".join(f"WHEN {n} < {b} THEN {v}" for b, v in branches[:-1]) + f" ELSE {branches[-1][1]} END"
    return f"(CASE WHEN {n} < 1024 THEN {format_bytes(n)} ELSE {case} || ' (' || {format_count(n)} || ' bytes)' END)"


# ---------------------------------------------------------------------------
# content inspection (the text column is UTF-8 by construction)
# ---------------------------------------------------------------------------

_CONTROL_HEX = [f"{b:02X}" for b in list(range(0x01, 0x09)) + [0x0B] + list(range(0x0E, 0x20)) + [0x7F]]


def prefix_hex(t: str) -> str:
    return f"hex(encode({t})[1:{K.DETECTION_BYTES}])"


def control_bytes(hx: str) -> str:
    return f"CAST(len(list_filter(regexp_extract_all({hx}, '..'), lambda b: b IN {_in_list(_CONTROL_HEX)})) AS BIGINT)"


def looks_binary(hx: str) -> str:
    nbytes = f"(length({hx}) // 2)"
    bom = f"(starts_with({hx}, 'FFFE') OR starts_with({hx}, 'FEFF'))"
    nul = f"list_contains(regexp_extract_all({hx}, '..'), '00')"
    ctrl = control_bytes(hx)
    return (
        f"(CASE WHEN {nbytes} = 0 OR {bom} THEN false WHEN {nul} THEN true "
        f"ELSE ({ctrl} >= {K.MIN_CONTROL_BYTES} AND {ctrl} * 100 > {nbytes} * {K.MAX_CONTROL_PERCENT}) END)"
    )


def _sig_cond(hx: str, parts) -> str:
    return " AND ".join(f"substr({hx}, {2 * off + 1}, {len(h)}) = {q(h.upper())}" for off, h in parts)


def signature_mime(hx: str) -> str:
    return "(CASE " + " ".join(f"WHEN {_sig_cond(hx, p)} THEN {q(m)}" for _n, p, m, _e in K.SIGNATURES) + " END)"


def signature_ext(hx: str) -> str:
    return "(CASE " + " ".join(f"WHEN {_sig_cond(hx, p)} THEN {q(e)}" for _n, p, _m, e in K.SIGNATURES) + " END)"


def textual_mime(m: str) -> str:
    return (
        f"(starts_with({m}, 'text/') OR {m} IN {_in_list(K.TEXTUAL_MIMES)} "
        f"OR ends_with({m}, '+json') OR ends_with({m}, '+xml'))"
    )


def binary_signature(hx: str) -> str:
    m = signature_mime(hx)
    return f"coalesce({m} IS NOT NULL AND NOT {textual_mime(m)}, false)"


def extension(name: str) -> str:
    return f"nullif(regexp_extract({name}, '^.+\\.([^.]*)$', 1), '')"


def ext_mime(ext: str) -> str:
    return "(CASE " + " ".join(f"WHEN {ext} = {q(e)} THEN {q(m)}" for e, m in K.EXTENSION_MIMES) + " END)"


def meta_columns(name: str, hx: str) -> dict[str, str]:
    """mime_type / extension / detected_by expressions."""
    sm = signature_mime(hx)
    ext = f"lower({extension(name)})"
    em = ext_mime(ext)
    return {
        "mime_type": f"coalesce({sm}, {em}, {q(K.FALLBACK_MIME)})",
        "extension": f"CASE WHEN {sm} IS NOT NULL THEN {signature_ext(hx)} WHEN {em} IS NOT NULL THEN {ext} END",
        "detected_by": (
            f"CASE WHEN {sm} IS NOT NULL THEN {q(K.DETECTED_BY_CONTENT)} "
            f"WHEN {em} IS NOT NULL THEN {q(K.DETECTED_BY_EXTENSION)} ELSE {q(K.DETECTED_BY_FALLBACK)} END"
        ),
    }


def format_metadata(mime: str, det: str, size: str, ext: str) -> str:
    return (
        f"concat_ws('; ', 'MIME: ' || {mime}, 'detected by: ' || {det}, 'size: ' || {format_bytes(size)}, "
        f"'detected extension: ' || {ext})"
    )
