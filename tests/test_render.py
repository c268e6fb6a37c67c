from treeloom.operators import render as R
from treeloom.operators import stats
from treeloom.operators.inspect import inspect_files
from treeloom.operators.snapshot import WalkOptions, walk


def test_project_stats_count_text_lines_and_all_bytes(spark, files_of):
    tree = {"a/b/one.py": "x = 1\ny = 2", "a/two.txt": "", "top.md": "# t\n\nend\n", "a/raw.bin": bytes([0, 9, 8])}
    w = walk(files_of({"p": tree}), WalkOptions())
    r = stats.project_stats(inspect_files(w.files), w.nodes).collect()[0]
    assert (r["files"], r["dirs"], r["lines"], r["size"]) == (4, 2, 2 + 0 + 3, 11 + 0 + 9 + 3)


def test_raw_ends_every_file_with_a_newline(spark, files_of):
    f = files_of({"p": {"b.txt": "no newline", "a/x.txt": "1\n2\n", "c.txt": ""}})
    doc = R.render(f, "raw").collect()[0]["document"]
    assert doc == "==== a/x.txt ====\n1\n2\n\n==== b.txt ====\nno newline\n\n==== c.txt ====\n\n"


def test_markdown_and_structure(spark, files_of):
    f = files_of({"example-project": {"README.md": "```\ncode\n```\n", "src/main.rs": "fn main() {}"}})
    md = R.render(f, "markdown").collect()[0]["document"]
    assert md.startswith("# Project Statistics\n- Files: 2\n- Directories: 1\n- Total lines: 4\n- Total size: 25 bytes\n\n")
    assert "# Project Structure\n\n```\nexample-project/\n├── README.md\n└── src/\n    └── main.rs\n```\n" in md
    assert "\n## README.md\n\n````\n```\ncode\n```\n\n````\n" in md
    st = R.render(f, "structure").collect()[0]["document"]
    assert st.startswith("# Project Statistics") and "example-project/" in st and "# File Contents" not in st


def test_markers_in_documents(spark, files_of):
    f = files_of({"p": {"song.xyz": b"OggS" + bytes(12)}})
    md = R.render(f, "markdown").collect()[0]["document"]
    assert "[Binary file not shown; MIME: " in md and "detected by: content signature; size: 16 bytes" in md


def test_stats_header_lines(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1200, 35, 98765, 2048, None, "0f" * 20, "ssh://host/x")],
                               "f long, d long, l long, s long, b string, c string, r string")
    h = df.select(R.stats_header(F.col("f"), F.col("d"), F.col("l"), F.col("s"), F.lit(1000000),
                                 F.col("b"), F.col("c"), F.col("r"))).collect()[0][0]
    assert h.splitlines() == [
        "# Project Statistics", "- Files: 1,200", "- Directories: 35", "- Total lines: 98,765",
        "- Total size: 2.0 KB (2,048 bytes)", "- Tokens (o200k_base): 1,000,000", "- Git commit: " + "0f" * 20,
        "- Git remote: ssh://host/x", "",
    ]


def _documents_of(index, target):
    """Each root's document: its files joined in name order, as the index places them."""
    import glob
    import os

    text = {}
    for row in sorted(index.collect(), key=lambda r: (r["root"], r["offset"] or 0)):
        text.setdefault((row["root"], row["output"]), "")
        if row["file"] is not None:
            (path,) = glob.glob(f"{target}/snapshot=*/{row['file']}") if "~" in row["output"] else [
                os.path.join(target, f"snapshot={row['output']}", row["file"])]
            body = open(path, newline="", encoding="utf-8").read()
            key = (row["root"], row["output"])
            assert len(text[key].encode()) == row["offset"] and len(body.encode()) == row["size"]
            text[key] += body
    return text


def test_snapshots_are_written_as_addressable_documents(spark, files_of, tmp_path):
    from treeloom.operators.blueprint import blueprint_render
    from treeloom.operators.inspect import ContentOptions
    from treeloom.sources.sinks import read_ranges, write_snapshots

    hot = {f"d{i % 7}/f{i:03d}.txt": f"line {i} \u00e9\U0001f332\n" * (i % 5) for i in range(60)}
    f = files_of({"hot": hot, "q": {"only.txt": "q"}, "none": {"node_modules/x.js": "x"},
                  "r": {"a.md": "```\nx\n```\n", "big.txt": "y" * 50, "z.bin": b"\x00\x01"}})
    meta = spark.createDataFrame([("hot", "main", "a" * 40, None)], "root string, branch string, commit_hash string, remote_url string")
    opts = R.RenderOptions(walk=WalkOptions(max_size=40), content=ContentOptions(head=2, max_chars=30))
    for mode in ("markdown", "reverse"):
        target = str(tmp_path / mode)
        index = write_snapshots(f, target, mode, opts, None if mode == "reverse" else meta, partitions=9)
        if mode == "reverse":
            w = walk(f, opts.walk)
            whole = {r["root"]: r["blueprint"] for r in blueprint_render(w.files, w.nodes, opts.content, 40, roots=f).collect()}
        else:
            whole = {r["root"]: r["document"] for r in R.render(f, mode, opts, meta).collect()}
        suffix = ".tree" if mode == "reverse" else ".md"
        assert _documents_of(index, target) == {(root, root + suffix): text for root, text in whole.items()}
        assert set(whole) == {"hot", "q", "none", "r"}
        size = {root: len(text.encode()) for root, text in whole.items()}
        assert index.filter("root = 'hot'").count() > 3  # a hot root is spread over files
        asked = [(root, at, n) for root in whole for at, n in ((0, size[root]), (3, 11), (size[root] // 2, 200), (size[root], 5), (1, 0))]
        asked += [("unknown", 0, 9), ("hot", 3, 11)]
        got = read_ranges(spark, target, spark.createDataFrame(asked, "root string, start bigint, length bigint")).collect()
        want = {(root, at, n): whole[root].encode()[at : at + n] for root, at, n in asked if root in whole}
        assert {(r["root"], r["start"], r["length"]): bytes(r["content"]) for r in got} == want and len(got) == len(want)
    assert "File too large" in R.render(f, "raw", opts).filter("root = 'r'").collect()[0]["document"]


def test_roots_that_share_an_output_name_have_their_own_documents(spark, files_of, tmp_path):
    from treeloom.sources.sinks import read_ranges, write_snapshots

    f = files_of({"x/app": {"a.txt": "first"}, "y/app": {"a.txt": "second"}, "z/a b+c%": {"a.txt": "third"}, ".": {"a.txt": "dot"}})
    target = str(tmp_path / "t")
    names = {r["root"]: r["output"] for r in write_snapshots(f, target, "raw").collect()}
    assert names["z/a b+c%"] == "a b+c%.md" and names["."] == "snapshot.md"
    assert names["x/app"] != names["y/app"] and all(names[r].startswith("app.md~") for r in ("x/app", "y/app"))
    ranges = spark.createDataFrame([(r, 16, 99) for r in names], "root string, start bigint, length bigint")
    got = {r["root"]: bytes(r["content"]) for r in read_ranges(spark, target, ranges).collect()}
    assert got == {"x/app": b"first\n", "y/app": b"second\n", "z/a b+c%": b"third\n", ".": b"dot\n"}


def test_render_by_options_matches_static_renders(spark, files_of):
    from treeloom.operators.blueprint import blueprint_render
    from treeloom.operators.inspect import ContentOptions
    from treeloom.operators.options import resolve_options
    from treeloom.operators.snapshot import WalkOptions, walk

    body = {"README.md": "one\ntwo\nthree\n", "src/main.rs": "fn main() { println!(\"hi\"); }"}
    f = files_of({r: body for r in ("a", "b", "c", "d", "e")})
    fields = ("max_size bigint, max_chars bigint, head bigint, tail bigint, from_end boolean, structure boolean, "
              "reverse boolean, raw boolean, no_content boolean, tokens boolean, no_secret_scan boolean, "
              "include_hidden boolean, no_ignore boolean, all boolean, exclude array<string>, force boolean, dry_run boolean")
    names = [x.split()[0] for x in fields.split(", ")]

    def row(root, layer, **kw):
        return (root, layer, *[kw.get(n) for n in names])

    layers = spark.createDataFrame([
        row("a", "default", max_size=1048576), row("a", "explicit", head=1),
        row("b", "default", max_size=1048576), row("b", "explicit", raw=True, max_chars=5, from_end=True),
        row("c", "default", max_size=1048576), row("c", "explicit", reverse=True, no_content=True),
        row("d", "default", max_size=20), row("d", "global", structure=True),
        row("e", "default", max_size=1048576), row("e", "global", raw=True, structure=True),
    ], "root string, layer string, " + fields)
    got = {r["root"]: r for r in R.render_by_options(f, resolve_options(layers)).collect()}

    def one(root, mode, copts=ContentOptions(), max_size=1048576):
        fr = f.filter(f.root == root)
        if mode == "reverse":
            w = walk(fr, WalkOptions())
            return blueprint_render(w.files, w.nodes, copts, no_content=True).collect()[0]["blueprint"]
        return R.render(fr, mode, R.RenderOptions(walk=WalkOptions(max_size=max_size), content=copts)).collect()[0]["document"]

    assert (got["a"]["mode"], got["a"]["document"]) == ("markdown", one("a", "markdown", ContentOptions(head=1)))
    assert (got["b"]["mode"], got["b"]["document"]) == ("raw", one("b", "raw", ContentOptions(max_chars=5, from_end=True)))
    assert (got["c"]["mode"], got["c"]["document"]) == ("reverse", one("c", "reverse"))
    assert (got["d"]["mode"], got["d"]["document"]) == ("structure", one("d", "structure", max_size=20))
    assert got["e"]["document"] is None and "raw" in got["e"]["error"]


def test_root_with_everything_excluded_still_rendered(spark, files_of):
    f = files_of({"p": {"node_modules/x.js": "x", ".env": "y"}, "q": {"a.txt": "a"}})
    got = {r["root"]: r["document"] for r in R.render(f, "structure").collect()}
    assert got["p"] == ("# Project Statistics\n- Files: 0\n- Directories: 0\n- Total lines: 0\n- Total size: 0 bytes\n\n"
                        "# Project Structure\n\n```\np/\n```\n")
    assert "q/\n└── a.txt\n" in got["q"]
    raw = {r["root"]: r["document"] for r in R.render(f, "raw").collect()}
    assert raw["p"] == ""


def test_stats_report_roots_with_nothing_kept(spark, files_of):
    f = files_of({"p": {"node_modules/x.js": "x"}, "q": {"a.txt": "a"}})
    w = walk(f, WalkOptions())
    got = {r["root"]: tuple(r)[1:] for r in stats.project_stats(inspect_files(w.files), w.nodes, roots=f).collect()}
    assert got == {"p": (0, 0, 0, 0), "q": (1, 0, 1, 1)}


def test_options_of_each_root_shape_its_walk(spark, files_of):
    from treeloom.operators.options import resolve_options

    from test_options_meta_secrets import _layers

    body = {"a.txt": "a\n", "b.md": "b\n", ".hid": "h\n", "build/c.txt": "c\n"}
    f = files_of({r: body for r in ("plain", "globs", "hidden", "every", "bad")})
    rows = [
        ("globs", "explicit", {"raw": True, "exclude": ["*.md"]}), ("hidden", "explicit", {"raw": True, "include_hidden": True}),
        ("every", "local", {"raw": True, "all": True}), ("bad", "explicit", {"raw": True, "exclude": ["[abc"]}),
    ]
    got = {r["root"]: r for r in R.render_by_options(f, resolve_options(_layers(spark, rows))).collect()}
    files = lambda r: [x[5:-5] for x in got[r]["document"].splitlines() if x.startswith("==== ")]
    assert got["plain"]["mode"] == "markdown" and "## b.md" in got["plain"]["document"]
    assert files("globs") == ["a.txt"] and files("hidden") == [".hid", "a.txt", "b.md"]
    assert files("every") == [".hid", "a.txt", "b.md", "build/c.txt"]
    assert got["bad"]["document"] is None and got["bad"]["error"]
