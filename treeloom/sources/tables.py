"""Corpora already held in tables become ``files`` (op 2), plus the views over TESTDATA.

``files(root STRING, path ARRAY<STRING>, is_dir BOOLEAN, is_symlink BOOLEAN,
size BIGINT, content BINARY, error STRING)`` is the canonical input of every
operator. ``path`` is the list of components below the root; ordering by it
(element-wise, prefix first) is the depth-first preorder of the tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILES_COLUMNS = ["root", "path", "is_dir", "is_symlink", "size", "content", "error"]


def files_from_table(
    df: DataFrame,
    root: str | Column = "root",
    path: str | Column = "path",
    text: str | Column | None = "text",
    content: str | Column | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Rows of (root, path, text-or-bytes) -> ``files``.

    ``path`` may be an ARRAY<STRING> of components or a '/'-separated string
    (empty components dropped). Either ``text`` (STRING) or ``content``
    (BINARY) carries the bytes; size is their byte length. From text, the
    ``text`` column is kept next to ``content``: inspection then never copies
    or re-validates the whole content (only the first 8 KiB are encoded).
    """
    root_c = F.col(root) if isinstance(root, str) else root
    path_c = F.col(path) if isinstance(path, str) else path
    if dict(df.select(path_c.alias("p")).dtypes)["p"] == "string":
        path_c = F.filter(F.split(path_c, "/"), lambda c: c != "")
    t = None
    if content is not None:
        body = F.col(content) if isinstance(content, str) else content
        size = F.octet_length(body)
    else:
        t = F.col(text) if isinstance(text, str) else text
        body = F.encode(t, "UTF-8")  # computed only where bytes are needed (pruned otherwise)
        size = F.octet_length(t)  # bytes of the UTF-8 string, no copy
    cols = [
        root_c.cast("string").alias("root"),
        path_c.alias("path"),
        F.lit(False).alias("is_dir"),
        F.lit(False).alias("is_symlink"),
        size.cast("bigint").alias("size"),
        body.alias("content"),
        F.lit(None).cast("string").alias("error"),
    ]
    if t is not None:
        # a table's string column is valid UTF-8 already: inspection reads it directly
        cols.append(t.alias("text"))
    cols += [F.col(k) for k in (keep or [])]
    return df.select(*cols)


# ---------------------------------------------------------------------------
# Views over TESTDATA (same definitions as the DuckDB oracle, see plans/oracle.py)
# ---------------------------------------------------------------------------


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def balance(df: DataFrame) -> DataFrame:
    """Spread a scan that yields fewer partitions than task slots (e.g. one large row group).

    Large inputs already arrive in many splits and are returned untouched. For a
    small, already-projected frame the repartition is checkpointed to the shared
    folder: a plain ``repartition`` would not help, because the optimizer pushes
    the (expensive, per-row) filters below it into the single scan task.
    """
    from ..session import ensure_checkpoint_dir

    want = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    ensure_checkpoint_dir(df.sparkSession)
    return df.repartition(want).checkpoint(eager=True)


def doc_dir(doc_id: Column) -> Column:
    m = (doc_id % 10).cast("int")
    return (
        F.when(m == 0, "node_modules")
        .when(m == 3, ".cache")
        .when(m == 4, "src-x")
        .when(m == 5, "target")
        .when(m == 6, "public")
        .otherwise("src")
    )


def doc_name(doc_id: Column) -> Column:
    m = (doc_id % 5).cast("int")
    return F.concat(
        F.when(doc_id % 13 == 0, ".env.").otherwise("d"),
        doc_id.cast("string"),
        F.when(m == 0, ".log").when(m == 1, ".md").when(m == 2, ".PDF").when(m == 3, ".local").otherwise(""),
    )


def doc_text(doc_id: Column, text: Column) -> Column:
    m = (doc_id % 8).cast("int")
    return (
        F.when(m == 0, F.concat(text, F.lit("\n")))
        .when(m == 1, F.concat(F.lit("```\n"), text, F.lit("\n````")))
        .when(m == 2, F.lit(""))
        .when(m == 3, F.replace(text, F.lit(" "), F.lit("\t")))
        .when(m == 4, F.concat(F.lit("\u0001\u0002\u001b"), F.substring(text, 1, 120)))
        .when(m == 5, F.replace(text, F.lit("\n"), F.lit("\r\n")))
        .when(m == 6, F.replace(text, F.lit("\n"), F.lit(" ")))
        .otherwise(text)
    )


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> (root, path, rel, text, doc_id): one file per document, perturbed by doc_id % 8."""
    d = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    did = F.col("doc_id")
    d = balance(d)
    return d.select(
        F.col("source").alias("root"),
        F.array(F.col("lang"), doc_dir(did), doc_name(did)).alias("path"),
        F.concat_ws("/", F.col("lang"), doc_dir(did), doc_name(did)).alias("rel"),
        doc_text(did, F.col("text")).alias("text"),
        did,
    )


def doc_files_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``files`` rows of the doc_files view."""
    return files_from_table(doc_files(spark, sf_dir), keep=["doc_id"])


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages -> (root = host, path = non-empty url path parts, text = html)."""
    p = balance(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    upath = F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1)
    return p.select(
        host.alias("root"),
        F.filter(F.split(upath, "/"), lambda c: c != "").alias("path"),
        F.col("html").alias("text"),
        "page_id",
    )


def page_files_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_from_table(page_files(spark, sf_dir), keep=["page_id"])


def notebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations -> one .ipynb JSON text per conv_id (cells ordered by turn, role, text).

    user turns are markdown cells, the others code cells with outputs derived
    from their text: a stream (stdout on even turns, stderr on odd) holding the
    first line, and for turns divisible by 3 an error whose value is the first
    30 characters. Notebook metadata varies with conv_id % 4 (language_info,
    kernelspec language, kernelspec name, none). Built with a grouped
    aggregation: each conversation is one group, bounded by the conversation.
    """
    c = balance(_read(spark, sf_dir, "conversations"))
    is_code = F.col("role") != "user"
    none_s = F.lit(None).cast("string")
    stream = F.struct(
        F.lit("stream").alias("output_type"),
        F.when(F.col("turn") % 2 == 0, "stdout").otherwise("stderr").alias("name"),
        F.array(F.substring_index(F.col("text"), "\n", 1)).alias("text"),
        none_s.alias("ename"),
        none_s.alias("evalue"),
    )
    error = F.struct(
        F.lit("error").alias("output_type"),
        none_s.alias("name"),
        F.lit(None).cast("array<string>").alias("text"),
        F.lit("ValueError").alias("ename"),
        F.substring(F.col("text"), 1, 30).alias("evalue"),
    )
    outputs = F.when(is_code, F.when(F.col("turn") % 3 == 0, F.array(stream, error)).otherwise(F.array(stream)))
    cell = F.to_json(
        F.struct(
            F.when(is_code, "code").otherwise("markdown").alias("cell_type"),
            F.array(F.col("text")).alias("source"),
            outputs.alias("outputs"),
        )
    )
    cells = F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.struct("turn", "role", "text", cell.alias("cell")))),
            lambda s: s["cell"],
        ),
        ", ",
    )
    m = (F.col("conv_id") % 4).cast("int")
    metadata = (
        F.when(m == 0, F.lit('{"language_info": {"name": "Python3"}}'))
        .when(m == 1, F.lit('{"kernelspec": {"language": "R"}}'))
        .when(m == 2, F.lit('{"kernelspec": {"name": "ir-python-kernel"}}'))
        .otherwise(F.lit("{}"))
    )
    nb = F.concat(F.lit('{"metadata": '), F.first(metadata), F.lit(', "cells": ['), cells, F.lit("]}"))
    return c.groupBy("conv_id").agg(nb.alias("text")).select(
        F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("root"),
        F.array(F.lit("notebooks"), F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(".ipynb"))).alias("path"),
        "text",
        "conv_id",
    )


def secret_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw documents as files: root = source, path = [lang, 'doc<id>.txt']."""
    d = balance(_read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return files_from_table(
        d.select(
            F.col("source").alias("root"),
            F.array("lang", F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"),
            "text",
            "doc_id",
        ),
        keep=["doc_id"],
    )


def _source_num(col: str = "root") -> Column:
    return F.regexp_extract(F.col(col), r"(\d+)$", 1).cast("int")


def repo_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per documents.source: branch null for odd source numbers, a 40-hex commit."""
    s = _read(spark, sf_dir, "documents").select(F.col("source").alias("root")).distinct()
    num = F.regexp_extract("root", r"(\d+)$", 1).cast("int")
    return s.select(
        "root",
        F.when(num % 2 == 0, F.lit("main")).alias("branch"),
        F.sha1(F.col("root")).alias("commit_hash"),
    )


def remotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remotes 'upstream' (pos 0) and 'origin' (pos 1) for every third source; one 'mirror' for others
    whose number is 1 mod 3; none for the rest."""
    s = _read(spark, sf_dir, "documents").select(F.col("source").alias("root")).distinct()
    num = F.regexp_extract("root", r"(\d+)$", 1).cast("int")
    rows = F.when(
        num % 3 == 0,
        F.array(
            F.struct(F.lit(0).alias("pos"), F.lit("upstream").alias("name")),
            F.struct(F.lit(1).alias("pos"), F.lit("origin").alias("name")),
        ),
    ).when(num % 3 == 1, F.array(F.struct(F.lit(0).alias("pos"), F.lit("mirror").alias("name"))))
    return (
        s.select("root", F.explode(rows).alias("r"))
        .select(
            "root",
            F.col("r.pos").cast("int").alias("pos"),
            F.col("r.name").alias("name"),
            F.concat(F.lit("https://git.example.com/"), F.col("r.name"), F.lit("/"), F.col("root"), F.lit(".git")).alias(
                "url"
            ),
        )
    )
