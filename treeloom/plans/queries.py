"""Registered queries: one per operator of the inventory, over the TESTDATA views.

Each function takes (spark, sf_dir) and returns a DataFrame whose column names
equal those of the matching oracle SQL in ``plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import content as C
from ..functions import quantities as Q
from ..functions import text as TX
from ..operators import paths, rules, stats
from ..operators.inspect import ContentOptions, inspect_files, windowed, with_shown
from ..operators.snapshot import WalkOptions, walk
from ..sources import tables

# Fixed parameters of the registered queries.
USER_GLOBS = ["*.md", "src-x/", "fr/src/*7.PDF", "[!d]*.local", "de/public"]
SMALL_MAX_SIZE = 20_000
HEAD_N = 2
TAIL_N = 2
CHARS_N = 100


def _rel(col: str = "path"):
    return F.array_join(F.col(col), "/").alias("rel")


def _doc_files(spark, sf):
    return tables.doc_files_table(spark, sf)


def _doc_closure(spark, sf):
    return paths.path_closure(_doc_files(spark, sf))


def _page_closure(spark, sf):
    return paths.path_closure(tables.page_files_table(spark, sf))


def _doc_inspected(spark, sf, max_size=None):
    files = _doc_files(spark, sf)
    return inspect_files(files, max_size) if max_size else inspect_files(files)


# --- sources ---------------------------------------------------------------


def files_from_table(spark: SparkSession, sf: str) -> DataFrame:
    f = _doc_files(spark, sf)
    return f.select(
        "root", _rel(), F.size("path").cast("bigint").alias("depth"), "is_dir", "is_symlink", "size"
    )


# --- structure -------------------------------------------------------------


def path_closure(spark, sf):
    n = _page_closure(spark, sf)
    return n.select("root", _rel(), F.col("depth").cast("bigint").alias("depth"), "is_dir")


def list_files(spark, sf):
    n = _page_closure(spark, sf)
    return paths.list_files(n).select("root", _rel(), "ordinal")


def count_dirs(spark, sf):
    return paths.count_dirs(_page_closure(spark, sf))


# --- filters ---------------------------------------------------------------


def drop_hidden(spark, sf):
    return rules.drop_hidden(_doc_closure(spark, sf)).select("root", _rel(), "is_dir")


def default_excludes(spark, sf):
    return rules.default_excludes(_doc_closure(spark, sf)).select("root", _rel(), "is_dir")


def glob_exclude(spark, sf):
    return rules.glob_exclude(_doc_closure(spark, sf), USER_GLOBS).select("root", _rel(), "is_dir")


def prune_subtrees(spark, sf):
    """Flag nodes whose *own* path matches a built-in pattern, then prune their subtrees by join."""
    n = _doc_closure(spark, sf)
    own = rules.own_excluded(rules.DEFAULT_RULES, F.col("path"), F.col("is_dir"))
    flagged = n.withColumn("excluded", own)
    return paths.prune_subtrees(flagged).select("root", _rel(), "is_dir")


def useless_dir(spark, sf):
    n = _doc_closure(spark, sf).filter("is_dir")
    return n.select("root", _rel(), rules.is_useless_dir(F.col("path")).alias("useless"))


# --- inspection ------------------------------------------------------------


def classify_files(spark, sf):
    i = _doc_inspected(spark, sf)
    return i.select(
        "root",
        _rel(),
        "kind",
        F.col("meta.mime_type").alias("mime_type"),
        F.col("meta.extension").alias("extension"),
        F.col("meta.detected_by").alias("detected_by"),
        "size",
    )


def oversize_gate(spark, sf):
    i = with_shown(_doc_inspected(spark, sf, SMALL_MAX_SIZE))
    return i.filter(F.col("kind") == "too_large").select("root", _rel(), "kind", "limit", F.col("shown").alias("marker"))


def looks_binary(spark, sf):
    f = _doc_files(spark, sf)
    prefix = C.detection_prefix(F.col("content"))
    return f.select(
        "root",
        _rel(),
        C.control_byte_count(prefix).cast("bigint").alias("control_bytes"),
        C.looks_binary(prefix).alias("looks_binary"),
    )


def content_signature(spark, sf):
    f = _doc_files(spark, sf)
    sig = C.signature(C.detection_prefix(F.col("content")))
    return f.select("root", _rel(), sig["mime"].alias("sig_mime"), C.has_binary_signature(C.detection_prefix(F.col("content"))).alias("binary_sig"))


def detect_mime(spark, sf):
    f = _doc_files(spark, sf)
    m = C.detect_metadata(F.element_at("path", -1), C.detection_prefix(F.col("content")), F.col("size"))
    return f.select("root", _rel(), m["mime_type"].alias("mime_type"), m["extension"].alias("extension"), m["detected_by"].alias("detected_by"))


def decode_text(spark, sf):
    i = _doc_inspected(spark, sf)
    return i.select("root", _rel(), (F.col("kind") == "text").alias("is_text"), F.length("text").cast("bigint").alias("chars"))


def _text_op(spark, sf, opts: ContentOptions):
    i = _doc_inspected(spark, sf).filter(F.col("kind") == "text")
    return i.select("root", _rel(), windowed(F.col("text"), opts).alias("shown"))


def head_lines(spark, sf):
    return _text_op(spark, sf, ContentOptions(head=HEAD_N))


def tail_lines(spark, sf):
    return _text_op(spark, sf, ContentOptions(tail=TAIL_N))


def max_chars(spark, sf):
    return _text_op(spark, sf, ContentOptions(max_chars=CHARS_N))


def from_end(spark, sf):
    return _text_op(spark, sf, ContentOptions(max_chars=CHARS_N, from_end=True))


def content_or_marker(spark, sf):
    i = with_shown(_doc_inspected(spark, sf, SMALL_MAX_SIZE), ContentOptions(head=40, max_chars=1000))
    return i.select("root", _rel(), "shown")


def format_quantities(spark, sf):
    f = _doc_files(spark, sf)
    per_root = f.groupBy("root").agg(F.sum("size").cast("bigint").alias("bytes"), F.count("*").cast("bigint").alias("n"))
    return per_root.select(
        "root",
        "bytes",
        Q.format_size(F.col("bytes")).alias("size_text"),
        Q.format_bytes(F.col("bytes")).alias("bytes_text"),
        Q.format_count(F.col("n") * 1001).alias("count_text"),
    )


def line_count(spark, sf):
    i = _doc_inspected(spark, sf).filter(F.col("kind") == "text")
    return i.select("root", _rel(), TX.line_count(F.col("text")).alias("lines"))


def fence_width(spark, sf):
    i = _doc_inspected(spark, sf).filter(F.col("kind") == "text")
    return i.select("root", _rel(), TX.fence_width(F.col("text")).alias("fence_width"))


def single_line(spark, sf):
    i = _doc_inspected(spark, sf).filter(F.col("kind") == "text")
    return i.select("root", _rel(), TX.is_single_line(F.col("text")).alias("single_line"))


# --- aggregation -----------------------------------------------------------


def project_stats(spark, sf):
    files = _doc_files(spark, sf)
    w = walk(files, WalkOptions())
    return stats.project_stats(inspect_files(w.files), w.nodes, roots=files)



# --- ignore files ------------------------------------------------------------

# Ignore files added to every root of doc_files (relative dir, file name, text).
# Documents of a directory of the ignore queries; bounds the rule file of each.
IGNORE_GROUP = 64


def _grouped_files(spark, sf):
    """doc_files in directories of up to ``IGNORE_GROUP`` documents, below their language and directory."""
    files = _doc_files(spark, sf)
    group = F.concat(F.lit("g"), F.floor(F.col("doc_id") / IGNORE_GROUP).cast("string"))
    path = F.concat(F.slice("path", 1, F.size("path") - 1), F.array(group), F.array(F.element_at("path", -1)))
    return files.withColumn("path", path)


def _rule_line(name, doc_id):
    """The ignore rule that a document's name and number give its directory; null for most documents."""
    return (
        F.when(doc_id % 35 == 0, F.lit("*.md"))
        .when(doc_id % 7 == 1, name)
        .when(doc_id % 7 == 2, F.concat(F.lit("/"), name))
        .when(doc_id % 7 == 3, F.concat(F.lit("!"), name))
        .when(doc_id % 7 == 4, F.concat(F.lit("d"), F.floor(doc_id / 10).cast("string"), F.lit("?.PDF")))
        .when(doc_id % 7 == 5, F.concat(name, F.lit("/")))
    )


def gitignore(spark, sf):
    """Op 12: every directory has a rule file made of its documents' names; roots of even number one more."""
    files = _grouped_files(spark, sf)
    narrow = files.select("root", F.slice("path", 1, 3).alias("dir"), _rule_line(F.element_at("path", -1), F.col("doc_id")).alias("line"), "doc_id")
    texts = narrow.filter("line IS NOT NULL").groupBy("root", "dir").agg(
        F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY doc_id)").alias("text")
    )
    own = texts.select("root", F.concat("dir", F.array(F.lit(".gitignore"))).alias("path"), "text")
    n = F.regexp_extract("root", r"(\d+)$", 1).cast("int")
    top = files.select("root").distinct().filter(n % 2 == 0).select(
        "root", F.array(F.lit(".ignore")).alias("path"), F.lit("*.local\n!d1*.local\n").alias("text")
    )
    w = walk(files.drop("doc_id").unionByName(tables.files_from_table(own.unionByName(top))), WalkOptions())
    return w.nodes.select("root", _rel(), "is_dir")


def root_ignore_file(spark, sf):
    """Op 11: every root's .mktreeignore names its own directories and extensions, by the root's number."""
    files = _grouped_files(spark, sf)
    n = F.regexp_extract("root", r"(\d+)$", 1).cast("int")
    ends = F.when(n % 3 == 0, F.lit("*.PDF")).when(n % 3 == 1, F.lit("*.md")).otherwise(F.lit("d?5*"))
    # the least group of each root, and one of its directories with a slash
    least = files.select("root", F.element_at("path", 3).alias("g"), F.concat_ws("/", F.slice("path", 1, 2)).alias("d"))
    texts = least.groupBy("root").agg(F.min("g").alias("g"), F.max("d").alias("d")).select(
        "root", F.array(F.lit(".mktreeignore")).alias("path"),
        F.concat(F.lit("# derived globs\n\n"), ends, F.lit("\n  "), F.col("g"), F.lit("/  \n"), F.col("d"), F.lit("\n")).alias("text"),
    )
    rows = files.drop("doc_id").unionByName(tables.files_from_table(texts))
    w = walk(rows, WalkOptions(no_ignore=True, mktree_ignore=True))
    return w.nodes.select("root", _rel(), "is_dir")


# --- secrets -------------------------------------------------------------------


def secret_findings(spark, sf):
    from ..operators.secrets import secret_findings as find

    f = find(inspect_files(tables.secret_docs(spark, sf)))
    return f.select("root", _rel(), "line", "kind")


def _placed(pieces, at_rest=False):
    """Pieces of every root's text with the byte where each begins: no root is gathered."""
    from ..operators.ordering import with_starts

    return with_starts(pieces, at_rest).select("root", "seq", _rel(), "start", "text")


def secret_report(spark, sf):
    from ..operators.secrets import secret_findings as find
    from ..operators.secrets import secret_report_pieces as report

    return _placed(report(find(inspect_files(tables.secret_docs(spark, sf)))))


# --- repository metadata ---------------------------------------------------------


def _meta(spark, sf):
    from ..operators.meta import attach_repo_meta as attach

    return attach(tables.repo_meta(spark, sf), tables.remotes(spark, sf))


def attach_repo_meta(spark, sf):
    return _meta(spark, sf)


# --- tree and documents -----------------------------------------------------------


def draw_tree(spark, sf):
    return _placed(paths.tree_pieces(_page_closure(spark, sf)))


def _render(spark, sf, mode):
    from ..operators.render import render_pieces

    return _placed(render_pieces(_doc_files(spark, sf), mode, meta=_meta(spark, sf)), at_rest=True)


def render_structure(spark, sf):
    return _render(spark, sf, "structure")


def render_markdown(spark, sf):
    return _render(spark, sf, "markdown")


def render_raw(spark, sf):
    return _render(spark, sf, "raw")


def stats_header(spark, sf):
    from ..operators.render import stats_header as header

    files = _doc_files(spark, sf)
    w = walk(files, WalkOptions())
    st = stats.project_stats(inspect_files(w.files), w.nodes).join(_meta(spark, sf), "root", "left")
    return st.select(
        "root",
        header(F.col("files"), F.col("dirs"), F.col("lines"), F.col("size"), None,
               F.col("branch"), F.col("commit_hash"), F.col("remote_url")).alias("header"),
    )


# --- options -------------------------------------------------------------------------


def option_layers(spark, sf):
    """Per-root option layers derived from the source number n of each root."""
    roots = spark.read.parquet(f"{sf.rstrip('/')}/documents.parquet").select(F.col("source").alias("root")).distinct()
    n = F.regexp_extract("root", r"(\d+)$", 1).cast("int")
    b = F.lit(None).cast("boolean")
    i = F.lit(None).cast("bigint")

    def layer(name, **kw):
        cols = {
            "max_size": i, "max_chars": i, "head": i, "tail": i, "from_end": b, "structure": b, "reverse": b,
            "raw": b, "no_content": b, "tokens": b, "no_secret_scan": b, "include_hidden": b, "no_ignore": b,
            "all": b, "exclude": F.lit(None).cast("array<string>"), "force": b, "dry_run": b,
        }
        cols.update(kw)
        return roots.select("root", F.lit(name).alias("layer"), *[v.alias(k) for k, v in cols.items()])

    default = layer("default", max_size=F.lit(1048576).cast("bigint"))
    local = layer(
        "local",
        max_chars=F.when(n % 2 == 0, (n * 1000 + 500).cast("bigint")),
        head=F.when(n % 4 == 1, F.lit(10).cast("bigint")),
        reverse=F.when(n % 5 == 1, F.lit(True)),
    )
    glob_ = layer(
        "global",
        tail=F.when(n % 3 == 0, F.lit(5).cast("bigint")),
        structure=F.when(n % 6 == 0, F.lit(True)),
        max_size=F.when(n % 4 == 2, F.lit(2000).cast("bigint")),
    )
    explicit = layer(
        "explicit",
        raw=F.when(n % 5 == 0, F.lit(True)),
        max_size=F.when(n % 5 == 0, F.lit(1048576).cast("bigint")),
        from_end=F.when(n % 7 == 0, F.lit(True)),
        no_secret_scan=F.when(n % 9 == 4, F.lit(True)),
        tokens=F.when(n % 8 == 3, F.lit(True)),
        no_content=F.when(n % 3 == 1, F.lit(True)),
    )
    return default.unionByName(local).unionByName(glob_).unionByName(explicit)


def resolve_options(spark, sf):
    from ..operators.options import resolve_options as resolve

    r = resolve(option_layers(spark, sf))
    return r.select("root", "max_size", "max_chars", "head", "tail", "from_end", "structure", "reverse", "raw",
                    "no_content", "tokens", "no_secret_scan", "error")


def secret_scan_policy(spark, sf):
    from ..operators.options import resolve_options as resolve
    from ..operators.options import secret_scan_policy as policy

    return policy(resolve(option_layers(spark, sf)))


def render_mode(spark, sf):
    from ..operators.options import resolve_options as resolve
    from ..operators.render import RAW_STRUCTURE_ERROR
    from ..operators.render import render_mode as mode

    r = resolve(option_layers(spark, sf))
    m = mode(F.col("raw"), F.col("reverse"), F.col("structure"))
    return r.select("root", m.alias("mode"), F.when(m.isNull(), F.lit(RAW_STRUCTURE_ERROR)).alias("error"))


# --- notebooks --------------------------------------------------------------------------


def _nbs(spark, sf):
    return tables.notebooks(spark, sf)


def notebook_cells(spark, sf):
    from ..operators import notebook as NB

    return NB.notebook_cells(_nbs(spark, sf)).select("root", _rel(), "cell_no", "cell_type", "source")


def notebook_outputs(spark, sf):
    from ..operators import notebook as NB

    return NB.notebook_outputs(_nbs(spark, sf)).select("root", _rel(), "cell_no", "out_no", "block")


def notebook_render(spark, sf):
    from ..operators import notebook as NB

    return NB.notebook_render(_nbs(spark, sf)).select("root", _rel(), "rendered")


def notebook_language(spark, sf):
    from ..operators import notebook as NB

    return NB.notebook_language_of(_nbs(spark, sf)).select("root", _rel(), "language")


# --- blueprints ---------------------------------------------------------------------------


def _blueprint_pieces(spark, sf, with_duplicates=False):
    """Blueprints of all doc_files as ordered pieces; with duplicates, the entries of ``en`` follow again, cut to one line."""
    from ..operators.blueprint import blueprint_pieces

    files = _doc_files(spark, sf)
    pieces = blueprint_pieces(files, paths.path_closure(files))
    if with_duplicates:
        en = files.filter(F.element_at("path", 1) == "en")
        again = blueprint_pieces(en, paths.path_closure(en), ContentOptions(head=1))
        pieces = pieces.unionByName(again.withColumn("seq", F.lit(2)))
    return pieces.withColumnRenamed("root", "blueprint_id")


def blueprint_render(spark, sf):
    from ..sources.sinks import snapshot_pieces

    return _placed(snapshot_pieces(_doc_files(spark, sf), "reverse")[0])


def blueprint_parse(spark, sf):
    from ..operators.blueprint_parse import parse_pieces

    p = parse_pieces(_blueprint_pieces(spark, sf))
    return p.select("blueprint_id", _rel(), "is_dir", "content", "error")


def blueprint_entries(spark, sf):
    from ..operators.blueprint import blueprint_entries as entries
    from ..operators.blueprint_parse import parse_pieces

    e = entries(parse_pieces(_blueprint_pieces(spark, sf, with_duplicates=True)))
    return e.select("blueprint_id", _rel(), "is_dir", "content")


# --- templates, inline text, scaffolding ------------------------------------------------


def _templates(spark, sf):
    roots = spark.read.parquet(f"{sf.rstrip('/')}/documents.parquet").select("source", "lang")
    sources = roots.select("source").distinct()
    n = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    dotted = sources.select(F.lit("tpl").alias("dir"), F.concat("source", F.lit(".tree")).alias("name"),
                            F.concat(F.lit("tree of "), F.col("source")).alias("text"), F.lit(False).alias("builtin"))
    exact = sources.filter(n % 2 == 0).select(F.lit("tpl").alias("dir"), F.col("source").alias("name"),
                                              F.concat(F.lit("names of "), F.col("source")).alias("text"), F.lit(False).alias("builtin"))
    builtin = roots.select("lang").distinct().select(F.lit("").alias("dir"), F.col("lang").alias("name"),
                                                     F.concat(F.lit("builtin "), F.col("lang")).alias("text"), F.lit(True).alias("builtin"))
    return dotted.unionByName(exact).unionByName(builtin)


def _template_requests(spark, sf):
    roots = spark.read.parquet(f"{sf.rstrip('/')}/documents.parquet").select("source", "lang")
    s = roots.select(F.col("source").alias("x")).distinct()
    l = roots.select(F.col("lang").alias("x")).distinct()
    reqs = (
        s.select(F.col("x").alias("name"))
        .unionByName(s.select(F.concat("x", F.lit(".tree")).alias("name")))
        .unionByName(s.select(F.concat(F.lit("missing-"), "x").alias("name")))
        .unionByName(l.select(F.col("x").alias("name")))
        .unionByName(l.select(F.concat("x", F.lit(".tree")).alias("name")))
    )
    return reqs.select(F.col("name").alias("req_id"), F.lit("tpl").alias("dir"), "name")


def pick_template(spark, sf):
    from ..operators.scaffold import pick_template as pick

    return pick(_template_requests(spark, sf), _templates(spark, sf))


def normalize_inline(spark, sf):
    from ..operators.scaffold import normalize_inline as norm

    c = spark.read.parquet(f"{sf.rstrip('/')}/conversations.parquet")
    inline = F.replace(F.col("text"), F.lit("\n"), F.lit("\\n"))
    return c.select("conv_id", "turn", norm(inline).alias("text"))


def _existing(spark, sf):
    """Paths already on disk, derived from labels: quality 1 -> the file; toxic 1 -> a directory at the
    file's path; quality 0 -> a file where the wanted tree has its parent directory; plus ancestors."""
    files = _doc_files(spark, sf)
    labels = spark.read.parquet(f"{sf.rstrip('/')}/labels.parquet")
    j = files.join(labels, "doc_id")
    rows = j.select(
        "root",
        F.when(F.col("toxic") == 1, F.col("path"))
        .when(F.col("quality") == 1, F.col("path"))
        .otherwise(F.slice("path", 1, 2)).alias("path"),
        (F.col("toxic") == 1).alias("is_dir"),
    )
    return paths.path_closure(rows.withColumn("is_symlink", F.lit(False))).select("root", "path", "is_dir")


def _wanted(spark, sf):
    files = _doc_files(spark, sf)
    nodes = paths.path_closure(files)
    content = files.select("root", "path", F.col("content").cast("string").alias("content"))
    return nodes.join(content, ["root", "path"], "left").select("root", "path", "is_dir", "content")


def scaffold_plan(spark, sf):
    from ..operators.scaffold import scaffold_plan as plan

    wanted, existing = _wanted(spark, sf), _existing(spark, sf)
    p = plan(wanted, existing, force=True).drop("conflict")
    dry = plan(wanted, existing, dry_run=True).select("root", "path", F.col("action").alias("dry_action"))
    strict = plan(wanted, existing).select("root", "path", "conflict")
    return p.join(dry, ["root", "path"]).join(strict, ["root", "path"]).select(
        "root", _rel(), "is_dir", "exists", "action", "dry_action", "conflict", "replaces_dir"
    )


# --- sources and sinks that touch storage (rows-only checks) ------------------------------


def _posix_shared(spark, *parts):
    """A fresh folder under the shared checkpoint folder (must be mounted on every executor)."""
    import os
    import uuid

    from ..session import ensure_checkpoint_dir

    base = ensure_checkpoint_dir(spark)
    if base.startswith("file:"):
        base = "/" + base[5:].lstrip("/")
    if "://" in base:
        raise RuntimeError(f"file-tree queries need a POSIX-mounted shared folder, got {base}")
    path = os.path.join(base, *parts, uuid.uuid4().hex)
    os.makedirs(path, exist_ok=True)
    return path


def _materialise_doc_tree(spark, sf):
    """Write the doc_files tree under a fresh shared folder (one directory per root)."""
    from ..operators.scaffold import scaffold_plan as plan
    from ..operators.scaffold import scaffold_write as write
    from ..sources.filetree import scan_parent

    target = _posix_shared(spark, "trees")
    existing = scan_parent(spark, target).select("root", "path", "is_dir")
    events = write(plan(_wanted(spark, sf), existing), target)
    return target, events


def scaffold_write(spark, sf):
    """Op 52: plan against what is on disk (a fresh folder), then write; returns the write events."""
    target, events = _materialise_doc_tree(spark, sf)
    return events.select("root", _rel(), "is_dir", "action", "written")


def scan_files(spark, sf):
    """Op 1: the doc_files tree written to shared storage, walked back by the file-tree source."""
    from ..sources.filetree import scan_parent

    target, _ = _materialise_doc_tree(spark, sf)
    f = scan_parent(spark, target)
    sha = F.sha2("content", 256).alias("content_sha256")
    return f.select("root", _rel(), "is_dir", "is_symlink", "size", F.col("error"), sha)


def write_snapshots(spark, sf):
    """Op 5: Markdown documents of every root written, then every piece read back by its byte range."""
    import uuid

    from ..operators.joins import freeze
    from ..operators.ordering import with_starts
    from ..session import ensure_checkpoint_dir
    from ..sources.sinks import read_ranges, snapshot_pieces, write_pieces

    files = _doc_files(spark, sf)
    pieces = snapshot_pieces(files, "markdown", meta=_meta(spark, sf))[0]
    target = f"{ensure_checkpoint_dir(spark).rstrip('/')}/snapshots-{uuid.uuid4().hex}"
    index = write_pieces(pieces, target, roots=files)
    pieces = freeze(with_starts(pieces, at_rest=True).drop("text"))
    read = read_ranges(spark, target, pieces).select("root", "start", "length", F.col("content").cast("string").alias("text"))
    names = index.select("root", "output").distinct()
    return pieces.join(read, ["root", "start", "length"]).join(names, "root").select("root", "output", "seq", _rel(), "start", "text")


def public_ranks():
    """Path and pre-token pattern of an installed public rank file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def token_count(spark, sf):
    """Op 33 with a public rank file: tokens of every text file; pre-tokens met before are not encoded again."""
    from ..operators.tokens import TokenDictionary, token_counts

    ranks, pattern = public_ranks()
    i = _doc_inspected(spark, sf).filter(F.col("kind") == "text")
    counts = token_counts(i, ranks, dictionary=TokenDictionary(spark, ranks, pattern))
    return counts.select("root", _rel(), "tokens")


QUERIES = {
    "files_from_table": files_from_table,
    "path_closure": path_closure,
    "list_files": list_files,
    "drop_hidden": drop_hidden,
    "default_excludes": default_excludes,
    "glob_exclude": glob_exclude,
    "prune_subtrees": prune_subtrees,
    "useless_dir": useless_dir,
    "classify_files": classify_files,
    "oversize_gate": oversize_gate,
    "looks_binary": looks_binary,
    "content_signature": content_signature,
    "detect_mime": detect_mime,
    "decode_text": decode_text,
    "head_lines": head_lines,
    "tail_lines": tail_lines,
    "max_chars": max_chars,
    "from_end": from_end,
    "content_or_marker": content_or_marker,
    "format_quantities": format_quantities,
    "line_count": line_count,
    "fence_width": fence_width,
    "single_line": single_line,
    "project_stats": project_stats,
    "count_dirs": count_dirs,
    "gitignore": gitignore,
    "root_ignore_file": root_ignore_file,
    "secret_findings": secret_findings,
    "secret_report": secret_report,
    "attach_repo_meta": attach_repo_meta,
    "draw_tree": draw_tree,
    "render_structure": render_structure,
    "render_markdown": render_markdown,
    "render_raw": render_raw,
    "stats_header": stats_header,
    "resolve_options": resolve_options,
    "secret_scan_policy": secret_scan_policy,
    "render_mode": render_mode,
    "notebook_cells": notebook_cells,
    "notebook_outputs": notebook_outputs,
    "notebook_render": notebook_render,
    "notebook_language": notebook_language,
    "blueprint_render": blueprint_render,
    "blueprint_parse": blueprint_parse,
    "blueprint_entries": blueprint_entries,
    "pick_template": pick_template,
    "normalize_inline": normalize_inline,
    "scaffold_plan": scaffold_plan,
    "scaffold_write": scaffold_write,
    "scan_files": scan_files,
    "write_snapshots": write_snapshots,
    "token_count": token_count,
}
