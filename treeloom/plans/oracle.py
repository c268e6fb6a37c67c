"""DuckDB oracle SQL for the registered queries (same column names as ``plans.queries``)."""

from __future__ import annotations

from ..functions import constants as K
from ..operators.rules import DEFAULT_RULES, RuleSet, useless_dir_names
from . import queries as Qy
from . import sqlparts as S

DOC = S.VIEWS["doc_files"]
PAGE = S.VIEWS["page_files"]


def _insp(source: str = "doc_files", max_size: int = K.DEFAULT_MAX_SIZE, name: str = "insp") -> str:
    """CTE: classified files of `source` (text column is valid UTF-8 by construction)."""
    base = f"""{name}_base AS (
  SELECT root, path, array_to_string(path, '/') AS rel, path[len(path)] AS name, text,
         CAST(octet_length(encode(text)) AS BIGINT) AS size, {S.prefix_hex('text')} AS hx
  FROM {source})"""
    meta = S.meta_columns("name", "hx")
    kind = (
        f"CASE WHEN size > {max_size} THEN 'too_large' "
        f"WHEN {S.binary_signature('hx')} OR {S.looks_binary('hx')} THEN 'binary' ELSE 'text' END"
    )
    main = f"""{name} AS (
  SELECT root, path, rel, name, text, size, hx, kind,
         CASE WHEN kind <> 'text' THEN {meta['mime_type']} END AS mime_type,
         CASE WHEN kind <> 'text' THEN {meta['extension']} END AS extension,
         CASE WHEN kind <> 'text' THEN {meta['detected_by']} END AS detected_by,
         CASE WHEN kind = 'too_large' THEN CAST({max_size} AS BIGINT) END AS lim
  FROM (SELECT *, {kind} AS kind FROM {name}_base))"""
    return base + ",\n" + main


def _marker(text_expr: str) -> str:
    meta = S.format_metadata("mime_type", "detected_by", "size", "extension")
    return (
        f"CASE WHEN kind = 'text' THEN {text_expr} "
        f"WHEN kind = 'binary' THEN '[Binary file not shown; ' || {meta} || ']' "
        f"ELSE '[File too large; ' || {meta} || '; limit: ' || {S.format_bytes('lim')} || ']' END"
    )


def _doc_nodes() -> str:
    return S.with_views(DOC, S.closure_sql("doc_files", "nodes"))


def _page_nodes() -> str:
    return S.with_views(PAGE, S.closure_sql("page_files", "nodes"))


def sql() -> dict[str, str]:
    o: dict[str, str] = {}
    o["files_from_table"] = S.with_views(DOC) + (
        "SELECT root, rel, CAST(len(path) AS BIGINT) AS depth, false AS is_dir, false AS is_symlink, "
        "CAST(octet_length(encode(text)) AS BIGINT) AS size FROM doc_files"
    )
    o["path_closure"] = _page_nodes() + "SELECT root, rel, CAST(depth AS BIGINT) AS depth, is_dir FROM nodes"
    o["list_files"] = _page_nodes() + (
        "SELECT root, rel, CAST(row_number() OVER (PARTITION BY root ORDER BY path) AS BIGINT) AS ordinal "
        "FROM nodes WHERE NOT is_dir"
    )
    o["count_dirs"] = _page_nodes() + (
        "SELECT root, CAST(count(*) FILTER (WHERE is_dir) AS BIGINT) AS dirs FROM nodes GROUP BY root"
    )
    o["drop_hidden"] = _doc_nodes() + f"SELECT root, rel, is_dir FROM nodes WHERE NOT {S.hidden_sql()}"
    o["default_excludes"] = _doc_nodes() + (
        f"SELECT root, rel, is_dir FROM nodes WHERE NOT {S.excluded_sql(DEFAULT_RULES)}"
    )
    o["glob_exclude"] = _doc_nodes() + (
        f"SELECT root, rel, is_dir FROM nodes WHERE NOT {S.excluded_sql(RuleSet.of(Qy.USER_GLOBS))}"
    )
    o["prune_subtrees"] = o["default_excludes"]
    o["useless_dir"] = _doc_nodes() + (
        f"SELECT root, rel, path[len(path)] IN ({', '.join(S.q(x) for x in useless_dir_names())}) AS useless "
        "FROM nodes WHERE is_dir"
    )
    o["classify_files"] = S.with_views(DOC, _insp()) + (
        "SELECT root, rel, kind, mime_type, extension, detected_by, size FROM insp"
    )
    o["oversize_gate"] = S.with_views(DOC, _insp(max_size=Qy.SMALL_MAX_SIZE)) + (
        f"SELECT root, rel, kind, lim AS \"limit\", {_marker('text')} AS marker FROM insp WHERE kind = 'too_large'"
    )
    o["looks_binary"] = S.with_views(DOC) + (
        f"SELECT root, rel, {S.control_bytes(S.prefix_hex('text'))} AS control_bytes, "
        f"{S.looks_binary(S.prefix_hex('text'))} AS looks_binary FROM doc_files"
    )
    o["content_signature"] = S.with_views(DOC) + (
        f"SELECT root, rel, {S.signature_mime('hx')} AS sig_mime, {S.binary_signature('hx')} AS binary_sig "
        f"FROM (SELECT *, {S.prefix_hex('text')} AS hx FROM doc_files)"
    )
    meta = S.meta_columns("path[len(path)]", "hx")
    o["detect_mime"] = S.with_views(DOC) + (
        f"SELECT root, rel, {meta['mime_type']} AS mime_type, {meta['extension']} AS extension, "
        f"{meta['detected_by']} AS detected_by FROM (SELECT *, {S.prefix_hex('text')} AS hx FROM doc_files)"
    )
    o["decode_text"] = S.with_views(DOC, _insp()) + (
        "SELECT root, rel, kind = 'text' AS is_text, CASE WHEN kind = 'text' THEN CAST(length(text) AS BIGINT) END AS chars "
        "FROM insp"
    )

    def text_op(expr):
        return S.with_views(DOC, _insp()) + f"SELECT root, rel, {expr} AS shown FROM insp WHERE kind = 'text'"

    o["head_lines"] = text_op(S.window("text", head=Qy.HEAD_N))
    o["tail_lines"] = text_op(S.window("text", tail=Qy.TAIL_N))
    o["max_chars"] = text_op(S.window("text", max_chars=Qy.CHARS_N))
    o["from_end"] = text_op(S.window("text", max_chars=Qy.CHARS_N, from_end=True))
    o["content_or_marker"] = S.with_views(DOC, _insp(max_size=Qy.SMALL_MAX_SIZE)) + (
        f"SELECT root, rel, {_marker(S.window('text', head=40, max_chars=1000))} AS shown FROM insp"
    )
    o["format_quantities"] = S.with_views(DOC) + (
        "SELECT root, bytes, "
        f"{S.format_size('bytes')} AS size_text, {S.format_bytes('bytes')} AS bytes_text, "
        f"{S.format_count('n * 1001')} AS count_text "
        "FROM (SELECT root, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, CAST(count(*) AS BIGINT) AS n "
        "FROM doc_files GROUP BY root)"
    )
    o["line_count"] = S.with_views(DOC, _insp()) + (
        f"SELECT root, rel, {S.line_count('text')} AS lines FROM insp WHERE kind = 'text'"
    )
    o["fence_width"] = S.with_views(DOC, _insp()) + (
        f"SELECT root, rel, {S.fence_width('text')} AS fence_width FROM insp WHERE kind = 'text'"
    )
    o["single_line"] = S.with_views(DOC, _insp()) + (
        f"SELECT root, rel, {S.single_line('text')} AS single_line FROM insp WHERE kind = 'text'"
    )
    o["project_stats"] = project_stats_sql()
    o.update(sql2())
    return o


def kept_doc_ctes(opts_hidden=False, all_=False, exclude=()) -> list[str]:
    """CTEs: doc_files, kept (files), nodes (closure of all files, filtered)."""
    keep_f = S.keep_sql("path", "false", opts_hidden, all_, exclude)
    keep_n = S.keep_sql("path", "is_dir", opts_hidden, all_, exclude)
    return [
        DOC,
        f"kept AS (SELECT * FROM doc_files WHERE {keep_f})",
        S.closure_sql("doc_files", "all_nodes"),
        f"nodes AS (SELECT * FROM all_nodes WHERE {keep_n})",
    ]


def project_stats_sql() -> str:
    ctes = kept_doc_ctes() + [_insp("kept")]
    return S.with_views(*ctes) + f"""
SELECT root, CAST(sum(f) AS BIGINT) AS files, CAST(sum(d) AS BIGINT) AS dirs,
       CAST(sum(l) AS BIGINT) AS lines, CAST(coalesce(sum(s), 0) AS BIGINT) AS size
FROM (SELECT root, 1 AS f, 0 AS d, CASE WHEN kind = 'text' THEN {S.line_count('text')} ELSE 0 END AS l, size AS s FROM insp
      UNION ALL
      SELECT root, 0, 1, 0, 0 FROM nodes WHERE is_dir)
GROUP BY root"""


# ---------------------------------------------------------------------------
# batch 2
# ---------------------------------------------------------------------------

NLc = "chr(10)"


def meta_ctes() -> list[str]:
    return [
        "srcs AS (SELECT DISTINCT source AS root, CAST(regexp_extract(source, '(\\d+)$', 1) AS INT) AS n FROM documents)",
        """meta AS (SELECT root, CASE WHEN n % 2 = 0 THEN 'main' END AS branch, sha1(root) AS commit_hash,
  CASE WHEN n % 3 = 0 THEN 'https://git.example.com/origin/' || root || '.git'
       WHEN n % 3 = 1 THEN 'https://git.example.com/mirror/' || root || '.git' END AS remote_url FROM srcs)""",
    ]


def display_name(root: str = "root") -> str:
    last = f"string_split(regexp_replace({root}, '/+$', ''), '/')[-1]"
    return f"(CASE WHEN {last} IN ('', '.', '..') THEN {root} ELSE {last} END)"


def tree_ctes(nodes: str = "nodes") -> list[str]:
    """CTEs ending in trees(root, tree) for the nodes CTE `nodes` (root, path, is_dir)."""
    return [
        f"""marked AS (SELECT *, name = max(name) OVER (PARTITION BY root, path[1:len(path) - 1]) AS is_last
  FROM (SELECT root, path, is_dir, path[len(path)] AS name FROM {nodes}))""",
        "anc AS (SELECT root, path, unnest(range(1, len(path))) AS k FROM marked)",
        """pref AS (SELECT a.root, a.path, string_agg(CASE WHEN m.is_last THEN '    ' ELSE '│   ' END, '' ORDER BY a.k) AS prefix
  FROM anc a JOIN marked m ON m.root = a.root AND m.path = a.path[1:a.k] GROUP BY a.root, a.path)""",
        f"""tlines AS (SELECT m.root, m.path, coalesce(p.prefix, '') || CASE WHEN m.is_last THEN '└── ' ELSE '├── ' END
  || m.name || CASE WHEN m.is_dir THEN '/' ELSE '' END || {NLc} AS line
  FROM marked m LEFT JOIN pref p ON p.root = m.root AND p.path = m.path)""",
        f"trees AS (SELECT root, {display_name()} || '/' || {NLc} || string_agg(line, '' ORDER BY path) AS tree FROM tlines GROUP BY root)",
    ]


def _placed(pieces: str) -> str:
    """Rows of ``pieces(root, seq, path, text)`` with the byte where each begins in its root's text."""
    return f"""SELECT root, CAST(seq AS INTEGER) AS seq, array_to_string(path, '/') AS rel, text,
  CAST(coalesce(sum(octet_length(encode(text))) OVER (PARTITION BY root ORDER BY seq, path
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM ({pieces})"""


NO_PATH = "[]::VARCHAR[]"


def _header_expr() -> str:
    fc = S.format_count
    return (
        f"'# Project Statistics' || {NLc} || '- Files: ' || {fc('files')} || {NLc} || '- Directories: ' || {fc('dirs')} || {NLc}"
        f" || '- Total lines: ' || {fc('lines')} || {NLc} || '- Total size: ' || {S.format_size('size')} || {NLc}"
        f" || coalesce('- Git branch: ' || branch || {NLc}, '') || coalesce('- Git commit: ' || commit_hash || {NLc}, '')"
        f" || coalesce('- Git remote: ' || remote_url || {NLc}, '') || {NLc}"
    )


def _shown_insp_ctes() -> list[str]:
    return kept_doc_ctes() + [_insp("kept"), f"shown AS (SELECT *, {_marker('text')} AS shown FROM insp)"]


def _stats_cte() -> str:
    return f"""st AS (SELECT r.root,
  (SELECT CAST(count(*) AS BIGINT) FROM shown s WHERE s.root = r.root) AS files,
  (SELECT CAST(count(*) AS BIGINT) FROM nodes n WHERE n.root = r.root AND n.is_dir) AS dirs,
  (SELECT CAST(coalesce(sum(CASE WHEN kind = 'text' THEN {S.line_count('shown')} ELSE 0 END), 0) AS BIGINT) FROM shown s WHERE s.root = r.root) AS lines,
  (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM shown s WHERE s.root = r.root) AS size
  FROM (SELECT root FROM nodes UNION SELECT root FROM kept) r)"""


def _doc_sql(mode: str) -> str:
    ctes = _shown_insp_ctes() + tree_ctes("nodes") + meta_ctes() + [_stats_cte()]
    fence_t = S.fence("t.tree")
    fs = S.fence("shown")
    md_block = f"{NLc} || '## ' || rel || {NLc} || {NLc} || {fs} || {NLc} || shown || {NLc} || {fs} || {NLc}"
    raw_block = f"'==== ' || rel || ' ====' || {NLc} || shown || CASE WHEN ends_with(shown, {NLc}) THEN '' ELSE {NLc} END"
    if mode == "raw":
        between = (
            f"SELECT root, 3, list_append(path, ''), {NLc} FROM (SELECT root, path, max(path) OVER (PARTITION BY root) AS last FROM shown) "
            "WHERE path <> last"
        )
        pieces = f"""SELECT root, 0 AS seq, {NO_PATH} AS path, '' AS text FROM st
UNION ALL SELECT root, 3, path, {raw_block} FROM shown UNION ALL {between}"""
    else:
        opening = f"'# Project Structure' || {NLc} || {NLc} || {fence_t} || {NLc} || {display_name('st.root')} || '/' || {NLc}"
        closing = f"{fence_t} || {NLc}" + (f" || {NLc} || '# File Contents' || {NLc}" if mode == "markdown" else "")
        pieces = f"""SELECT st.root, 0 AS seq, {NO_PATH} AS path, {_header_expr()} || {opening} AS text
FROM st LEFT JOIN meta USING (root) LEFT JOIN trees t ON t.root = st.root
UNION ALL SELECT root, 1, path, line FROM tlines
UNION ALL SELECT st.root, 2, {NO_PATH}, {closing} FROM st LEFT JOIN trees t ON t.root = st.root"""
        if mode == "markdown":
            pieces += f"\nUNION ALL SELECT root, 3, path, {md_block} FROM shown"
    return S.with_views(*ctes) + _placed(pieces)


def _secret_lines_ctes() -> list[str]:
    sd = "sd AS (SELECT source AS root, [lang, 'doc' || doc_id || '.txt'] AS path, text FROM documents)"
    return [
        sd,
        _insp("sd"),
        f"""sl AS (SELECT root, path, rel, regexp_replace(l, '\\r\\z', '') AS l, line FROM (
  SELECT root, path, rel, unnest(string_split(text, {NLc})) AS l,
         CAST(generate_subscripts(string_split(text, {NLc}), 1) AS BIGINT) AS line
  FROM insp WHERE kind = 'text'))""",
    ]


def _secret_hits() -> str:
    from ..operators.secrets import SECRET_RULES

    parts = [
        f"SELECT root, path, rel, line, {i} AS rule, {S.q(k)} AS kind FROM sl WHERE regexp_matches(l, {S.q(rx)})"
        for i, (k, rx) in enumerate(SECRET_RULES)
    ]
    return "hits AS (" + "\nUNION ALL ".join(parts) + ")"


def _grouped_ctes(hidden: bool = False) -> list[str]:
    """CTEs: files in directories of 64 documents, and their nodes that names alone keep."""
    return [
        DOC,
        "grouped AS (SELECT root, doc_id, list_concat(path[1:2], ['g' || CAST(doc_id // 64 AS VARCHAR), path[3]]) AS path FROM doc_files)",
        S.closure_sql("grouped", "all_nodes"),
        f"nodes AS (SELECT * FROM all_nodes WHERE {S.keep_sql('path', 'is_dir', hidden, False, ())})",
    ]


_UNDER = "len(i.path) <= len(b.path) AND b.path[1:len(i.path)] = i.path"


def _gitignore_sql() -> str:
    """The winning rule by what each line means, spelled out: no pattern is translated."""
    rule = """CASE WHEN doc_id % 35 = 0 THEN 'end' WHEN doc_id % 7 IN (1, 2) THEN 'is' WHEN doc_id % 7 = 3 THEN 'not'
  WHEN doc_id % 7 = 4 THEN 'one' WHEN doc_id % 7 = 5 THEN 'folder' END"""
    name, r_name = "n.path[len(n.path)]", "r.path[4]"
    means = f"""CASE r.rule WHEN 'end' THEN ends_with({name}, '.md') WHEN 'folder' THEN n.is_dir AND {name} = {r_name}
  WHEN 'one' THEN length({name}) = length('d' || (r.doc_id // 10)) + 5 AND starts_with({name}, 'd' || (r.doc_id // 10)) AND ends_with({name}, '.PDF')
  ELSE {name} = {r_name} END"""
    ctes = _grouped_ctes(True) + [
        f"rules AS (SELECT * FROM (SELECT root, path, doc_id, {rule} AS rule FROM grouped) WHERE rule IS NOT NULL)",
        f"""hits AS (
  SELECT n.root, n.path, r.rule = 'not' AS negated, 1 AS prio, 3 AS dl, r.doc_id AS line FROM nodes n
  JOIN rules r ON r.root = n.root AND len(n.path) = 4 AND n.path[1:3] = r.path[1:3] WHERE {means}
  UNION ALL SELECT n.root, n.path, l.line = 2, 2, 0, l.line FROM nodes n, (VALUES (1), (2)) l(line)
  WHERE CAST(regexp_extract(n.root, '(\\d+)$', 1) AS INT) % 2 = 0 AND ends_with({name}, '.local') AND (l.line = 1 OR starts_with({name}, 'd1')))""",
        "win AS (SELECT root, path, arg_max(negated, (prio, dl, line)) AS negated FROM hits GROUP BY root, path)",
        "gone AS (SELECT n.root, n.path FROM nodes n LEFT JOIN win w ON w.root = n.root AND w.path = n.path "
        f"WHERE coalesce(NOT w.negated, starts_with({name}, '.')))",
    ]
    return S.with_views(*ctes) + f"SELECT b.root, b.rel, b.is_dir FROM nodes b WHERE NOT EXISTS (SELECT 1 FROM gone i WHERE i.root = b.root AND {_UNDER})"


def _root_ignore_sql() -> str:
    name = "n.path[len(n.path)]"
    ctes = _grouped_ctes() + [
        """own AS (SELECT root, CAST(regexp_extract(root, '(\\d+)$', 1) AS INT) AS num, min(path[3]) AS g, max(path[1] || '/' || path[2]) AS d
  FROM grouped GROUP BY root)""",
        f"""gone AS (SELECT n.root, n.path FROM nodes n JOIN own o ON o.root = n.root
  WHERE CASE o.num % 3 WHEN 0 THEN ends_with({name}, '.PDF') WHEN 1 THEN ends_with({name}, '.md')
             ELSE starts_with({name}, 'd') AND substr({name}, 3, 1) = '5' END
     OR n.is_dir AND {name} = o.g OR array_to_string(n.path, '/') = o.d)""",
    ]
    return S.with_views(*ctes) + f"SELECT b.root, b.rel, b.is_dir FROM nodes b WHERE NOT EXISTS (SELECT 1 FROM gone i WHERE i.root = b.root AND {_UNDER})"


def _layers_cte() -> list[str]:
    f = ["max_size", "max_chars", "head", "tail", "from_end", "structure", "reverse", "raw", "no_content", "tokens",
         "no_secret_scan"]
    types = {"max_size": "BIGINT", "max_chars": "BIGINT", "head": "BIGINT", "tail": "BIGINT"}

    def layer(name, rank, **kw):
        cols = ", ".join(f"CAST({kw.get(c, 'NULL')} AS {types.get(c, 'BOOLEAN')}) AS {c}" for c in f)
        return f"SELECT root, {rank} AS rank, {cols} FROM srcs"

    layers = " UNION ALL ".join(
        [
            layer("default", 0, max_size="1048576"),
            layer("local", 1, max_chars="CASE WHEN n % 2 = 0 THEN n * 1000 + 500 END",
                  head="CASE WHEN n % 4 = 1 THEN 10 END", reverse="CASE WHEN n % 5 = 1 THEN true END"),
            layer("global", 2, tail="CASE WHEN n % 3 = 0 THEN 5 END", structure="CASE WHEN n % 6 = 0 THEN true END",
                  max_size="CASE WHEN n % 4 = 2 THEN 2000 END"),
            layer("explicit", 3, raw="CASE WHEN n % 5 = 0 THEN true END",
                  max_size="CASE WHEN n % 5 = 0 THEN 1048576 END", from_end="CASE WHEN n % 7 = 0 THEN true END",
                  no_secret_scan="CASE WHEN n % 9 = 4 THEN true END", tokens="CASE WHEN n % 8 = 3 THEN true END",
                  no_content="CASE WHEN n % 3 = 1 THEN true END"),
        ]
    )
    scal = ["max_size", "max_chars", "from_end", "no_content", "tokens", "no_secret_scan"]
    aggs = ", ".join(f"arg_max({c}, rank) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in scal)
    res = f"""resolved AS (SELECT root, max_size, max_chars, lg.head AS head, lg.tail AS tail,
  coalesce(from_end, false) AS from_end, coalesce(mg.structure, false) AS structure, coalesce(mg.reverse, false) AS reverse,
  coalesce(mg.raw, false) AS raw, coalesce(no_content, false) AS no_content, coalesce(tokens, false) AS tokens,
  coalesce(no_secret_scan, false) AS no_secret_scan
  FROM (SELECT root, {aggs},
    arg_max({{'head': head, 'tail': tail}}, rank) FILTER (WHERE head IS NOT NULL OR tail IS NOT NULL) AS lg,
    arg_max({{'structure': structure, 'reverse': reverse, 'raw': raw}}, rank)
      FILTER (WHERE structure IS NOT NULL OR reverse IS NOT NULL OR raw IS NOT NULL) AS mg
    FROM layers GROUP BY root))"""
    return [meta_ctes()[0], f"layers AS ({layers})", res]


def _nb_ctes() -> list[str]:
    strip = "regexp_replace({t}, '\\x1b\\[[0-9;?]*[ -/]*[@-~]', '', 'g')"
    cells = f"""cells AS (SELECT conv_id, 'conv' || conv_id AS root, 'notebooks/c' || conv_id || '.ipynb' AS rel, turn, text,
  CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS BIGINT) AS cell_no,
  CASE WHEN role = 'user' THEN 'markdown' ELSE 'code' END AS cell_type,
  CASE CAST(conv_id % 4 AS INT) WHEN 0 THEN 'python' WHEN 1 THEN 'r' WHEN 2 THEN 'python' ELSE 'text' END AS lang
  FROM conversations)"""
    t = f"split_part(text, {NLc}, 1)"
    st = strip.format(t=t)
    fence = S.fence(st)
    stream = (
        f"{NLc} || CASE WHEN turn % 2 = 0 THEN '**Output:**' ELSE '**Standard error:**' END || {NLc} || {NLc} || {fence} || {NLc} || {st}"
        f" || CASE WHEN ends_with({st}, {NLc}) THEN '' ELSE {NLc} END || {fence} || {NLc}"
    )
    ev = "substring(text, 1, 30)"
    err = f"{NLc} || '**Error:** ValueError' || CASE WHEN {ev} <> '' THEN ': ' || {strip.format(t=ev)} ELSE '' END || {NLc}"
    outs = f"""outs AS (SELECT root, rel, cell_no, 1 AS out_no, {stream} AS block FROM cells WHERE cell_type = 'code'
  UNION ALL SELECT root, rel, cell_no, 2, {err} FROM cells WHERE cell_type = 'code' AND turn % 3 = 0)"""
    fsrc = S.fence("text")
    code = f"{NLc} || {fsrc} || lang || {NLc} || text || CASE WHEN ends_with(text, {NLc}) THEN '' ELSE {NLc} END || {fsrc} || {NLc}"
    md = f"{NLc} || text || CASE WHEN text = '' OR ends_with(text, {NLc}) THEN '' ELSE {NLc} END"
    rendered = f"""rcells AS (SELECT c.root, c.rel, c.cell_no, '### Cell ' || c.cell_no || ' (' || c.cell_type || ')' || {NLc}
  || CASE WHEN c.cell_type = 'markdown' THEN {md.replace('text', 'c.text')} ELSE {code.replace('text', 'c.text').replace('lang', 'c.lang')}
     || coalesce((SELECT string_agg(o.block, '' ORDER BY o.out_no) FROM outs o WHERE o.root = c.root AND o.cell_no = c.cell_no), '') END
  || {NLc} AS r FROM cells c)"""
    return [cells, outs, rendered]


def _blueprint_file_block(indent: str, name: str) -> str:
    lines = (
        f"string_split(text, {NLc})[1:len(string_split(text, {NLc})) - CASE WHEN ends_with(text, {NLc}) THEN 1 ELSE 0 END]"
    )
    body = f"array_to_string([{indent} || '  ' || regexp_replace(l, '\\r\\z', '') || {NLc} for l in {lines}], '')"
    meta = S.format_metadata("mime_type", "detected_by", "size", "extension")
    return (
        f"CASE WHEN kind = 'text' AND text = '' THEN {indent} || {name} || {NLc} "
        f"WHEN kind = 'text' AND {S.single_line('text')} THEN {indent} || {name} || ': ' || text || {NLc} "
        f"WHEN kind = 'text' THEN {indent} || {name} || ':|' || {NLc} || {body} || CASE WHEN ends_with(text, {NLc}) THEN {indent} || '  ' || {NLc} ELSE '' END "
        f"WHEN kind = 'binary' THEN {indent} || {name} || ': <binary file; ' || {meta} || '>' || {NLc} "
        f"ELSE {indent} || {name} || ': <file too large; ' || {meta} || '; limit: ' || {S.format_bytes('lim')} || '>' || {NLc} END"
    )


def _parsed_content(text: str = "text") -> str:
    """What parsing gives back of a rendered file: its lines without CR, blank ones emptied, or its marker."""
    lines = f"string_split({text}, {NLc})[1:len(string_split({text}, {NLc})) - CASE WHEN ends_with({text}, {NLc}) THEN 1 ELSE 0 END]"
    line = "regexp_replace(l, '\\r\\z', '')"
    kept = f"array_to_string([CASE WHEN regexp_matches({line}, '^\\s*$') THEN '' ELSE {line} END for l in {lines}], {NLc})"
    meta = S.format_metadata("mime_type", "detected_by", "size", "extension")
    return (
        f"CASE WHEN kind = 'text' AND {text} = '' THEN NULL WHEN kind = 'text' AND {S.single_line(text)} THEN {text} "
        f"WHEN kind = 'text' THEN {kept} || CASE WHEN ends_with({text}, {NLc}) THEN {NLc} ELSE '' END "
        f"WHEN kind = 'binary' THEN '<binary file; ' || {meta} || '>' "
        f"ELSE '<file too large; ' || {meta} || '; limit: ' || {S.format_bytes('lim')} || '>' END"
    )


def _parsed_sql(text: str, columns: str) -> str:
    ctes = [DOC, _insp(), S.closure_sql("doc_files", "nodes"), f"shown AS (SELECT * REPLACE ({text} AS text) FROM insp)",
            f"content AS (SELECT root, path, {_parsed_content()} AS content FROM shown)"]
    return S.with_views(*ctes) + f"""SELECT n.root AS blueprint_id, n.rel, n.is_dir, c.content{columns}
FROM nodes n LEFT JOIN content c ON c.root = n.root AND c.path = n.path"""


def _existing_ctes() -> list[str]:
    return [
        """ex_rows AS (SELECT d.root, CASE WHEN l.toxic = 1 THEN d.path WHEN l.quality = 1 THEN d.path ELSE d.path[1:2] END AS path,
  l.toxic = 1 AS is_dir FROM doc_files d JOIN labels l USING (doc_id))""",
        """existing AS (SELECT root, p AS path, bool_or(d) AS is_dir FROM (
  SELECT root, path[1:k] AS p, (k < len(path) OR is_dir) AS d
  FROM (SELECT root, path, is_dir, unnest(range(1, len(path) + 1)) AS k FROM ex_rows)) GROUP BY root, p)""",
    ]


def sql2() -> dict[str, str]:
    o: dict[str, str] = {}
    o["gitignore"] = _gitignore_sql()
    o["root_ignore_file"] = _root_ignore_sql()
    o["secret_findings"] = S.with_views(*_secret_lines_ctes(), _secret_hits()) + "SELECT root, rel, line, kind FROM hits"
    entry = f"'  ' || rel || ':' || CAST(line AS VARCHAR) || ' — ' || kind || {NLc}"
    head = (
        "'Warning: ' || CAST(count(*) AS VARCHAR) || ' potential secret' || CASE WHEN count(*) = 1 THEN '' ELSE 's' END "
        f"|| ' detected in content about to be exported:' || {NLc}"
    )
    tail = f"'Review the files or exclude them with --exclude. Use --no-secret-scan to disable this warning.' || {NLc}"
    place = "lpad(CAST(line AS VARCHAR), 12, '0') || ' ' || lpad(CAST(rule AS VARCHAR), 6, '0')"
    o["secret_report"] = S.with_views(*_secret_lines_ctes(), _secret_hits()) + _placed(
        f"""SELECT root, 0 AS seq, {NO_PATH} AS path, {head} AS text FROM hits GROUP BY root
UNION ALL SELECT root, 1, list_concat(path, ['', {place}]), {entry} FROM hits
UNION ALL SELECT DISTINCT root, 2, {NO_PATH}, {tail} FROM hits"""
    )
    o["attach_repo_meta"] = S.with_views(*meta_ctes()) + "SELECT root, branch, commit_hash, remote_url FROM meta"
    o["draw_tree"] = S.with_views(PAGE, S.closure_sql("page_files", "nodes"), *tree_ctes("nodes")) + _placed(
        f"""SELECT root, 0 AS seq, {NO_PATH} AS path, {display_name()} || '/' || {NLc} AS text FROM (SELECT DISTINCT root FROM nodes)
UNION ALL SELECT root, 1, path, line FROM tlines"""
    )
    o["render_structure"] = _doc_sql("structure")
    o["render_markdown"] = _doc_sql("markdown")
    o["render_raw"] = _doc_sql("raw")
    o["stats_header"] = S.with_views(*_shown_insp_ctes(), *meta_ctes(), _stats_cte()) + (
        f"SELECT st.root, {_header_expr()} AS header FROM st LEFT JOIN meta USING (root)"
    )
    o["resolve_options"] = S.with_views(*_layers_cte()) + (
        "SELECT root, max_size, max_chars, head, tail, from_end, structure, reverse, raw, no_content, tokens, no_secret_scan, "
        f"CASE WHEN head IS NOT NULL AND tail IS NOT NULL THEN {S.q('Config enables both ' + chr(39) + 'head' + chr(39) + ' and ' + chr(39) + 'tail' + chr(39) + '; choose only one')} "
        f"WHEN from_end AND max_chars IS NULL THEN {S.q('Config enables ' + chr(39) + 'from_end' + chr(39) + ' without setting ' + chr(39) + 'max_chars' + chr(39))} "
        f"WHEN raw AND structure THEN {S.q('Config enables both ' + chr(39) + 'raw' + chr(39) + ' and ' + chr(39) + 'structure' + chr(39) + '; choose only one output mode')} END AS error "
        "FROM resolved"
    )
    o["secret_scan_policy"] = S.with_views(*_layers_cte()) + (
        "SELECT root, NOT no_secret_scan AND NOT (tokens OR structure OR (reverse AND no_content)) AS scan FROM resolved"
    )
    o["render_mode"] = S.with_views(*_layers_cte()) + (
        "SELECT root, CASE WHEN raw AND structure THEN NULL WHEN raw THEN 'raw' WHEN reverse THEN 'reverse' "
        "WHEN structure THEN 'structure' ELSE 'markdown' END AS mode, "
        f"CASE WHEN raw AND structure THEN {S.q('Options --raw and -s (structure with statistics) cannot be used together.')} END AS error "
        "FROM resolved"
    )
    nb = _nb_ctes()
    o["notebook_cells"] = S.with_views(nb[0]) + "SELECT root, rel, cell_no, cell_type, text AS source FROM cells"
    o["notebook_outputs"] = S.with_views(nb[0], nb[1]) + "SELECT root, rel, CAST(cell_no AS BIGINT) AS cell_no, CAST(out_no AS BIGINT) AS out_no, block FROM outs"
    o["notebook_render"] = S.with_views(*nb) + (
        "SELECT root, rel, regexp_replace(string_agg(r, '' ORDER BY cell_no), '\\s+$', '') AS rendered FROM rcells GROUP BY root, rel"
    )
    o["notebook_language"] = S.with_views(nb[0]) + "SELECT DISTINCT root, rel, lang AS language FROM cells"
    bp_dir = f"repeat('  ', len(path) - 1) || path[len(path)] || '/' || {NLc}"
    o["blueprint_render"] = S.with_views(*kept_doc_ctes(), _insp("kept")) + _placed(
        f"""SELECT DISTINCT root, 0 AS seq, {NO_PATH} AS path, '' AS text FROM doc_files
UNION ALL SELECT root, 1, path, {bp_dir} FROM nodes WHERE is_dir
UNION ALL SELECT root, 1, path, {_blueprint_file_block("repeat('  ', len(path) - 1)", 'name')} FROM insp"""
    )
    o["blueprint_parse"] = _parsed_sql("text", ", CAST(NULL AS VARCHAR) AS error")
    cut = f"CASE WHEN kind = 'text' AND path[1] = 'en' THEN {S.head_lines('text', 1)} ELSE text END"
    o["blueprint_entries"] = _parsed_sql(cut, "")
    o["pick_template"] = _pick_template_sql()
    o["scaffold_write"] = S.with_views(DOC, S.closure_sql("doc_files", "wanted")) + (
        "SELECT root, rel, is_dir, 'create' AS action, true AS written FROM wanted"
    )
    o["scan_files"] = S.with_views(DOC, S.closure_sql("doc_files", "nodes")) + """SELECT n.root, n.rel, n.is_dir, false AS is_symlink,
  CASE WHEN n.is_dir THEN NULL ELSE CAST(octet_length(encode(f.text)) AS BIGINT) END AS size, CAST(NULL AS VARCHAR) AS error,
  sha256(f.text) AS content_sha256
FROM nodes n LEFT JOIN doc_files f ON f.root = n.root AND f.path = n.path"""
    o["write_snapshots"] = f"SELECT {display_name()} || '.md' AS output, * FROM ({_doc_sql('markdown')})"
    o["normalize_inline"] = (
        "SELECT conv_id, turn, replace(replace(text, chr(10), '\\n'), '\\n', chr(10)) AS text FROM conversations"
    )
    o["scaffold_plan"] = S.with_views(DOC, S.closure_sql("doc_files", "wanted"), *_existing_ctes()) + """SELECT w.root, w.rel, w.is_dir,
  e.is_dir IS NOT NULL AS exists,
  CASE WHEN w.is_dir THEN (CASE WHEN e.is_dir IS NULL THEN 'create' WHEN e.is_dir THEN 'keep' ELSE 'create' END)
       ELSE (CASE WHEN e.is_dir IS NOT NULL THEN 'overwrite' ELSE 'create' END) END AS action,
  CASE WHEN w.is_dir THEN (CASE WHEN e.is_dir IS NULL THEN 'create' ELSE 'keep' END)
       ELSE (CASE WHEN e.is_dir IS NOT NULL THEN 'overwrite' ELSE 'create' END) END AS dry_action,
  e.is_dir IS NOT NULL AND NOT (w.is_dir AND e.is_dir) AS conflict,
  NOT w.is_dir AND coalesce(e.is_dir, false) AS replaces_dir
FROM wanted w LEFT JOIN existing e ON e.root = w.root AND e.path = w.path"""
    return o


def _pick_template_sql() -> str:
    return """WITH srcs AS (SELECT DISTINCT source FROM documents),
langs AS (SELECT DISTINCT lang FROM documents),
tpl(dir, name, text, builtin) AS (
  SELECT 'tpl', source || '.tree', 'tree of ' || source, false FROM srcs
  UNION ALL SELECT 'tpl', source, 'names of ' || source, false FROM srcs WHERE CAST(regexp_extract(source, '(\\d+)$', 1) AS INT) % 2 = 0
  UNION ALL SELECT '', lang, 'builtin ' || lang, true FROM langs),
req(req_id, dir, name) AS (
  SELECT source, 'tpl', source FROM srcs UNION ALL SELECT source || '.tree', 'tpl', source || '.tree' FROM srcs
  UNION ALL SELECT 'missing-' || source, 'tpl', 'missing-' || source FROM srcs
  UNION ALL SELECT lang, 'tpl', lang FROM langs UNION ALL SELECT lang || '.tree', 'tpl', lang || '.tree' FROM langs),
cand AS (
  SELECT r.req_id, t.text, 1 AS prio, 'dir' AS source FROM req r JOIN tpl t ON NOT t.builtin AND t.dir = r.dir AND t.name = r.name
  UNION ALL SELECT r.req_id, t.text, 2, 'dir' FROM req r JOIN tpl t ON NOT t.builtin AND t.dir = r.dir AND t.name = r.name || '.tree'
  UNION ALL SELECT r.req_id, t.text, 3, 'builtin' FROM req r JOIN tpl t ON t.builtin AND t.name = regexp_replace(r.name, '\\.tree$', '')),
best AS (SELECT req_id, arg_min(text, prio) AS text, arg_min(source, prio) AS source FROM cand GROUP BY req_id),
names AS (SELECT string_agg(name, ', ' ORDER BY name) AS names FROM tpl WHERE builtin)
SELECT r.req_id, b.text, b.source,
  CASE WHEN b.text IS NULL THEN 'Template ''' || r.name || ''' was not found in ' || r.dir || ' or built-in templates ('
       || (SELECT coalesce(names, 'none') FROM names) || ')' END AS error
FROM req r LEFT JOIN best b USING (req_id)"""
