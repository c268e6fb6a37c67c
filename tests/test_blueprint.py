import pytest
from pyspark.sql import functions as F

from treeloom.operators import blueprint as B
from treeloom.operators import blueprint_parse as BP
from treeloom.operators import paths
from treeloom.operators.snapshot import WalkOptions, walk


def _render(spark, files_of, entries, **kw):
    f = files_of({"p": entries})
    w = walk(f, WalkOptions(all=True))
    return B.blueprint_render(w.files, w.nodes, **kw).collect()[0]["blueprint"]


def test_render_forms(spark, files_of):
    assert _render(spark, files_of, {"title.txt": "one line"}) == "title.txt: one line\n"
    jpeg = bytes.fromhex("FFD8FFE000104A46494600")
    assert _render(spark, files_of, {"photo": jpeg}).startswith(
        f"photo: <binary file; MIME: image/jpeg; detected by: content signature; size: {len(jpeg)} bytes")
    got = _render(spark, files_of, {"lib/util/two.txt": "p\nq", "lib/util/three.txt": "p\nq\n", "lib/none": "", "z": "end"})
    assert got == ("lib/\n  none\n  util/\n    three.txt:|\n      p\n      q\n      \n    two.txt:|\n      p\n      q\nz: end\n")
    assert _render(spark, files_of, {"lib/two.txt": "p\nq"}, no_content=True) == "lib/\n  two.txt\n"


def test_root_with_nothing_kept_has_an_empty_blueprint(spark, files_of):
    f = files_of({"p": {"node_modules/x.js": "x"}, "q": {"a.txt": "a"}})
    w = walk(f, WalkOptions())
    got = {r["root"]: r["blueprint"] for r in B.blueprint_render(w.files, w.nodes, roots=f).collect()}
    assert got == {"p": "", "q": "a.txt: a\n"}


def test_parse_errors():
    for text, msg in [
        ("x/\n\ty", "Tabs"), ("x/\n   y", "multiples of two"), ("x/\n    y", "Unexpected indentation on line 2"),
        ("one\n  two", "Unexpected indentation on line 2"), ("x/\n  : v", "cannot be empty"), ("x/y/z: v", "Nested paths.*x/y/z"),
        ("t:|\n  ok\n   odd", "multiples of two"),
    ]:
        with pytest.raises(B.BlueprintError, match=msg):
            B.parse_blueprint(text, lenient=False)


def test_spaced_marker_is_text_in_strict_mode_only():
    text = "note: |\n  first\n  second\n"
    assert [n[2] for n in B.parse_blueprint(text)] == ["first\nsecond"]
    with pytest.raises(B.BlueprintError, match="line 2"):
        B.parse_blueprint(text, lenient=False)
    assert [n[2] for n in B.parse_blueprint("note: |\nnext", lenient=False)] == ["|", None]


def test_parse_nesting_comments_and_bodies():
    text = ("top/\n  # remark\n  in/\n    deep.cfg:|\n      k: v\n\n        more\n  url: http://host:80/x\n\nend/\r\n  e.txt:  padded \n")
    got = [("/".join(p), d, c, n, chain) for p, d, c, n, chain in B.parse_blueprint(text)]
    assert got == [
        ("top", True, None, 1, []), ("top/in", True, None, 3, [1]), ("top/in/deep.cfg", False, "k: v\n\n  more", 4, [1, 3]),
        ("top/url", False, "http://host:80/x", 8, [1]), ("end", True, None, 10, []), ("end/e.txt", False, "padded ", 11, [10]),
    ]


def test_null_text_is_an_error_row(spark):
    df = spark.createDataFrame([("n", None), ("e", ""), ("k", "a\n")], "blueprint_id string, text string")
    got = {(r["blueprint_id"], r["error"]) for r in BP.blueprint_parse(df).collect()}
    assert got == {("n", B.MSG_NULL), ("k", None)}


def test_later_duplicates_replace_whole_subtrees(spark):
    text = "k/\n  gone: 1\n  sub/\n    gone2: 2\nf: first\nk/\n  stays: 3\nf: second\n"
    df = spark.createDataFrame([("t", text)], "blueprint_id string, text string")
    e = B.blueprint_entries(BP.blueprint_parse(df))
    got = sorted(("/".join(r["path"]), r["content"]) for r in e.collect())
    assert got == [("f", "second"), ("k", None), ("k/stays", "3")]


def test_round_trip_property(spark, files_of):
    entries = {"d/one.txt": "single line", "d/two.txt": "l1\nl2\n", "d/e/three.txt": "x\n\ny", "empty": "", "z.md": "# title"}
    f = files_of({"p": entries})
    nodes = paths.path_closure(f)
    text = B.blueprint_render(f, nodes).select(F.col("root").alias("blueprint_id"), F.col("blueprint").alias("text"))
    parsed = {"/".join(r["path"]): r["content"] for r in BP.blueprint_parse(text).collect() if not r["is_dir"]}
    assert parsed == {k: (v if v else None) for k, v in entries.items()}


def _random_blueprint(rng):
    """Lines of all kinds, some with bad margins, deep jumps, empty or nested names."""
    out, level = [], 0
    for _ in range(rng.randrange(0, 40)):
        deeper = bool(out) and out[-1].endswith(("/", "|")) or rng.random() < 0.02
        level = max(0, level + (1 if deeper and rng.random() < 0.9 else rng.choice((-2, -1, 0, 0, 0))))
        pad = "  " * level
        out.append(rng.choice((
            f"{pad}dir{rng.randrange(3)}/", f"{pad}dir{rng.randrange(3)}/", f"{pad}file{rng.randrange(4)}", f"{pad}file: one line",
            f"{pad}text:|", f"{pad}text: |", "", "   ", f"{pad}# comment", f"{pad}  body line\r", f"{pad}t\u00e9xt \U0001f332: x",
        )))
        if rng.random() < 0.01:
            out.append(rng.choice(("\tbad", " odd", "a/b", ":", f"{pad}      deep", f"{pad} # odd comment")))
    return "\n".join(out) + rng.choice(("", "\n"))


def test_parsing_pieces_cut_anywhere_equals_parsing_the_text(spark):
    import random

    rng = random.Random(48)
    texts = {f"t{i}": _random_blueprint(rng) for i in range(120)}
    texts |= {"empty": "", "one": "file", "long": "text:|\n" + "".join(f"  line {i}\n" for i in range(400)) + "after: x\n",
              "nested": "".join("  " * i + f"d{i}/\n" for i in range(30)) + "  " * 30 + "leaf:|\n" + "  " * 31 + "body"}
    rows = []
    for key, text in texts.items():
        seq = at = 0
        while at < len(text):
            n = rng.choice((1, 2, 5, 17, 60))
            rows.append((key, seq, [str(seq % 3)], text[at : at + n]))
            seq, at = seq + 1, at + n
    rows += [("null", 0, ["a"], "file\n"), ("null", 1, ["a"], None), (None, 0, ["a"], "no id\n")]
    pieces = spark.createDataFrame(rows, "blueprint_id string, seq int, path array<string>, text string").repartition(5)
    for lenient, chunk in ((True, 30), (False, 30), (True, 1 << 20)):
        want = set()
        for key, text in texts.items():
            try:
                for path, is_dir, content, line, chain in B.parse_blueprint(text, lenient):
                    want.add((key, tuple(path), is_dir, content, line, tuple(chain), None))
            except B.BlueprintError as e:
                want.add((key, None, None, None, None, None, str(e)))
        want |= {("null", None, None, None, None, None, B.MSG_NULL), (None, ("no id",), False, None, 1, (), None)}
        got = [
            (r["blueprint_id"], r["path"] and tuple(r["path"]), r["is_dir"], r["content"], r["line_no"],
             None if r["chain"] is None else tuple(r["chain"]), r["error"])
            for r in BP.parse_pieces(pieces, ("seq", "path"), lenient, chunk).collect()
        ]
        assert len(got) == len(set(got)) and set(got) == want
    assert sum(1 for w in want if w[-1]) > 20 and sum(1 for w in want if w[3]) > 50
