import json
import os

import pytest
from pyspark.sql import functions as F

from treeloom.operators.tokens import O200K_PATTERN, pretoken_counts, token_counts
from treeloom.sources import tables
from treeloom.sources.filetree import scan_files

SF001 = "/root/testdata/sf0.001"


def _vocabulary():
    """A rank file named by TREELOOM_RANKS, else of an installed package of public vocabularies."""
    if os.environ.get("TREELOOM_RANKS"):
        return os.environ["TREELOOM_RANKS"]
    try:
        import public_tokenizers
    except ImportError:
        return ""
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


VOCAB = _vocabulary()


def test_pretokens_match_python_regex(spark):
    import regex

    docs = tables.doc_files(spark, SF001).select("root", "path", "text")
    extra = spark.createDataFrame([("x", ["u"], "سلام 👋 <|endoftext|>  don't\r\n\n  x")], "root string, path array<string>, text string")
    docs = docs.unionByName(extra)
    got = {(r["root"], tuple(r["path"])): r["pretokens"] for r in pretoken_counts(docs).collect()}
    pat = regex.compile(O200K_PATTERN)
    for r in docs.collect():
        assert got[(r["root"], tuple(r["path"]))] == len(pat.findall(r["text"]))


@pytest.mark.skipif(not os.path.exists(VOCAB), reason="no local vocabulary")
def test_distributed_bpe_matches_tiktoken(spark):
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    enc = tiktoken.Encoding("local50k", pat_str=O200K_PATTERN, mergeable_ranks=load_tiktoken_bpe(VOCAB), special_tokens={})
    docs = tables.doc_files(spark, SF001).select("root", "path", "text")
    rows = docs.collect()
    got = {(r["root"], tuple(r["path"])): r["tokens"] for r in token_counts(docs, VOCAB).collect()}
    for r in rows:
        assert got[(r["root"], tuple(r["path"]))] == len(enc.encode_ordinary(r["text"]))


@pytest.mark.skipif(not os.path.exists(VOCAB), reason="no local vocabulary")
def test_token_dictionary_encodes_each_pretoken_once(spark, tmp_path):
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    from treeloom.operators.tokens import TokenDictionary, pretokens

    import public_tokenizers

    pattern = public_tokenizers.PATTERN
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_tiktoken_bpe(VOCAB), special_tokens={})
    docs = tables.doc_files(spark, SF001).select("root", "path", "text")
    more = spark.createDataFrame([("x", ["u"], "n\u00e9w p\u00efeces \U0001f44b  don't\r\n\n  x"), ("x", ["empty"], "")], "root string, path array<string>, text string")
    memory = TokenDictionary(spark, VOCAB, pattern, str(tmp_path / "d"))
    sizes = []
    for rows in (docs, docs, docs.unionByName(more), more):
        got = {(r["root"], tuple(r["path"])): r["tokens"] for r in token_counts(rows, VOCAB, dictionary=memory).collect()}
        assert got == {(r["root"], tuple(r["path"])): len(enc.encode_ordinary(r["text"])) for r in rows.collect()}
        sizes.append(spark.read.parquet(memory.path).count())
    assert sizes[0] == sizes[1] < sizes[2] == sizes[3]  # a corpus seen before encodes nothing
    assert spark.read.parquet(memory.path).select("pt").distinct().count() == sizes[-1]
    again = TokenDictionary(spark, VOCAB, pattern, str(tmp_path / "d"))
    assert again.path == memory.path and again.learn(docs.select(F.explode(pretokens(F.col("text"), again.pattern)).alias("pt")).distinct()) == 0


@pytest.mark.skipif(not os.path.exists(VOCAB), reason="no local vocabulary")
def test_registered_token_count_equals_tiktoken(spark):
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    import public_tokenizers
    from treeloom.plans import queries

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(VOCAB), special_tokens={})
    text = {(r["root"], "/".join(r["path"])): r["text"] for r in tables.doc_files(spark, SF001).collect()}
    got = queries.token_count(spark, SF001).collect()
    assert len(got) > 100 and all(r["tokens"] == len(enc.encode_ordinary(text[r["root"], r["rel"]])) for r in got)


def test_filetree_source(spark, tmp_path):
    root = tmp_path / "proj"
    (root / "src").mkdir(parents=True)
    (root / "empty").mkdir()
    (root / "src" / "__init__.py").write_text("")
    (root / ".hidden").write_text("h")
    (root / "_x").write_text("x")
    (root / "f.txt").write_text("file")
    os.symlink(root / "f.txt", root / "link")
    os.symlink(root / "src", root / "dirlink")
    os.symlink(root / "missing", root / "broken")
    got = {"/".join(r["path"]): r for r in scan_files(spark, [str(root)]).collect()}
    assert set(got) == {"src", "empty", "src/__init__.py", ".hidden", "_x", "f.txt", "link", "dirlink", "broken"}
    assert got["empty"]["is_dir"] and got["src"]["is_dir"]
    assert got["link"]["is_symlink"] and bytes(got["link"]["content"]) == b"file"
    assert got["dirlink"]["is_symlink"] and not got["dirlink"]["is_dir"] and "Is a directory" in got["dirlink"]["error"]
    assert "No such file" in got["broken"]["error"] and got["broken"]["size"] is None
    assert {r["root"] for r in got.values()} == {"proj"}


def test_entry_contract(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.columns == ["root", "files", "dirs", "lines", "size"]
    assert df.count() > 0
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 52


@pytest.mark.skipif(not os.path.exists(VOCAB), reason="no local vocabulary")
def test_token_line_counts_whole_document(spark, files_of):
    import re

    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    from treeloom.operators.render import render

    enc = tiktoken.Encoding("local50k", pat_str=O200K_PATTERN, mergeable_ranks=load_tiktoken_bpe(VOCAB), special_tokens={})
    f = files_of({"p": {"README.md": "# Title\n\n```\ncode\n```\n", "src/main.rs": "fn main() { println!(\"hello\"); }",
                        "src/lib.rs": "pub fn add(a: i32) -> i32 { a }\n"}})
    for mode in ("markdown", "structure"):
        doc = render(f, mode, ranks_path=VOCAB).collect()[0]["document"]
        t = int(re.search(r"- Tokens \(o200k_base\): ([\d,]+)\n", doc).group(1).replace(",", ""))
        assert t == len(enc.encode_ordinary(doc))


def test_filetree_splits_wide_directories(spark, tmp_path):
    from treeloom.sources.filetree import FileTreeReader

    root = tmp_path / "wide"
    (root / "big").mkdir(parents=True)
    for i in range(40):
        (root / "big" / f"f{i:02d}.txt").write_text(str(i))
    (root / "small.txt").write_text("s")
    parts = FileTreeReader({"roots": f'["{root}"]', "target_partitions": "16"}).partitions()
    assert 10 <= len(parts) <= 16
    got = scan_files(spark, [str(root)]).collect()
    assert sorted("/".join(r["path"]) for r in got) == sorted(["big", "small.txt"] + [f"big/f{i:02d}.txt" for i in range(40)])


@pytest.mark.skipif(not os.path.exists(VOCAB), reason="no local vocabulary")
def test_document_token_counts_all_modes(spark, files_of):
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    from treeloom.operators.blueprint import blueprint_render
    from treeloom.operators.render import document_token_counts, render
    from treeloom.operators.snapshot import WalkOptions, walk

    enc = tiktoken.Encoding("local50k", pat_str=O200K_PATTERN, mergeable_ranks=load_tiktoken_bpe(VOCAB), special_tokens={})
    f = files_of({"p": {"README.md": "readme\n\n", "src/main.rs": "fn main() {}\n", "src/a/b.txt": "x\r\ny", "e": ""}})
    raw = render(f, "raw").collect()[0]["document"]
    assert document_token_counts(f, "raw", VOCAB).collect()[0]["tokens"] == len(enc.encode_ordinary(raw))
    w = walk(f, WalkOptions())
    bp = blueprint_render(w.files, w.nodes).collect()[0]["blueprint"]
    assert document_token_counts(f, "reverse", VOCAB).collect()[0]["tokens"] == len(enc.encode_ordinary(bp))
    md = render(f, "markdown", ranks_path=VOCAB).collect()[0]["document"]
    assert document_token_counts(f, "markdown", VOCAB).collect()[0]["tokens"] == len(enc.encode_ordinary(md))


def test_filetree_refuses_roots_of_one_name_and_bounds_tasks(spark, tmp_path):
    from treeloom.sources.filetree import FileTreeReader

    for top in ("x", "y"):
        (tmp_path / top / "app").mkdir(parents=True)
        (tmp_path / top / "app" / "main.txt").write_text(top)
    with pytest.raises(Exception, match="app"):
        scan_files(spark, [str(tmp_path / "x" / "app"), str(tmp_path / "y" / "app")]).collect()
    flat = tmp_path / "flat"
    flat.mkdir()
    for i in range(5000):
        os.close(os.open(flat / f"f{i}", os.O_CREAT))
    parts = FileTreeReader({"roots": f'["{flat}"]'}).partitions()
    assert len(parts) <= 64 and sum(len(p.subtrees) for p in parts) == 5000


def test_filetree_names_and_truncated_content(spark, tmp_path):
    from treeloom.operators.inspect import inspect_files

    root = tmp_path / "r"
    root.mkdir()
    (root / "long.txt").write_text("word " * 4000)
    with open(os.fsencode(str(root)) + b"/caf\xe9.txt", "w") as fh:
        fh.write("x")
    files = scan_files(spark, [str(root)], max_size=10_000)
    got = {"/".join(r["path"]): r for r in inspect_files(files, max_size=1 << 20).collect()}
    assert set(got) == {"long.txt", "caf\ufffd.txt"}
    # the scan kept 8 KiB of it: never a whole text
    assert got["long.txt"]["kind"] == "too_large" and got["long.txt"]["text"] is None


@pytest.mark.skipif(not os.path.exists(VOCAB), reason="no local vocabulary")
@pytest.mark.parametrize("bound", [0, 300, 1 << 20])
def test_token_counts_with_few_pretokens_broadcast(spark, bound):
    from treeloom.operators.tokens import bpe_count, load_ranks, python_pretokens

    ranks = load_ranks(VOCAB)
    texts = ["the cat and the dog and the cat", "rare words, the cat", "", None, "the the the\n\n x1", "more: the dog"]
    keyed = [("r", [f"f{i}"], t) for i, t in enumerate(texts)] + [("r", ["f0"], "a second row of the key"), (None, ["n"], "the cat")]
    rows = spark.createDataFrame(keyed, "root string, path array<string>, text string")
    got = sorted((r["root"] or "", r["path"][0], r["tokens"]) for r in token_counts(rows, VOCAB, common_bytes=bound).collect())
    own = lambda t: sum(bpe_count(p.encode(), ranks) for p in python_pretokens(t or ""))
    both = {}
    for root, path, t in keyed:
        both[root, path[0]] = both.get((root, path[0]), 0) + own(t)
    # rows of one key share their sum; a null key meets nothing
    assert got == sorted((root or "", path[0], both[root, path[0]] if root else 0) for root, path, _ in keyed)


def test_file_tree_batches_are_bounded(tmp_path, monkeypatch):
    from treeloom.sources import filetree

    monkeypatch.setattr(filetree, "BATCH_BYTES", 10_000)
    (tmp_path / "r" / "d").mkdir(parents=True)
    sizes = {f"f{i}": i % 3000 for i in range(1300)} | {"big": 50_000}
    for name, n in sizes.items():
        (tmp_path / "r" / "d" / name).write_bytes(b"x" * n)
    for i in range(1300):
        (tmp_path / "r" / f"empty{i}").write_bytes(b"")
    reader = filetree.FileTreeReader({"roots": json.dumps([str(tmp_path / "r")]), "target_partitions": "1"})
    batches = [b for part in reader.partitions() for b in reader.read(part)]
    assert all(b.num_rows <= filetree.BATCH_ROWS for b in batches)
    held = [[len(c or b"") for c in b.column("content").to_pylist()] for b in batches]
    assert all(sum(h[:-1]) < 10_000 for h in held)
    found = {r["path"][-1]: r["size"] for b in batches for r in b.to_pylist() if not r["is_dir"]}
    assert found == sizes | {f"empty{i}": 0 for i in range(1300)} and sum(b.num_rows for b in batches) == len(found) + 1
