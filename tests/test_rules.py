import pytest
from pyspark.sql import functions as F

from treeloom.operators import rules
from treeloom.operators.ignore import parse_gitignore_line


def _excluded(spark, rs, cases):
    df = spark.createDataFrame([(p.split("/"), d) for p, d in cases], "path array<string>, is_dir boolean")
    return [r[0] for r in df.select(rs.excluded(F.col("path"), F.col("is_dir"))).collect()]


def test_default_excludes_by_directory_name_and_suffix(spark):
    cases = [
        ("site/node_modules/left/pad.js", True), ("site/.next", True), ("jobs/__pycache__/a.pyc", False),
        ("run/server.log", False), (".env.local", False), ("web/Cargo.lock", False), ("old/backup.zip", False),
        ("notes/target", False), ("lib/core.py", False), ("node_modules_notes.txt", False),
    ]
    assert _excluded(spark, rules.DEFAULT_RULES, cases) == [True] * 7 + [False] * 3


def test_globs(spark):
    rs = rules.RuleSet.of(["*.log", "public/uploads/", "[!a]*.txt"])
    cases = [
        ("a/b.log", False), ("x.log", True), ("public/uploads", True), ("x/public/uploads", True),
        ("public/uploads/f", False), ("abc.txt", False), ("bcd.txt", False), ("d/abc.txt", False),
    ]
    # '*' crosses '/', so 'd/abc.txt' matches '[!a]*.txt' as a whole path
    assert _excluded(spark, rs, cases) == [True, True, True, False, True, False, True, True]


def test_invalid_globs_fail_fast():
    for bad in ["[abc", "a***", "a**/b"]:
        with pytest.raises(rules.GlobError):
            rules.RuleSet.of([bad])


def test_hidden_and_useless(spark):
    df = spark.createDataFrame([(["a", ".git", "x"],), (["src", "main.rs"],), (["node_modules"],)], "path array<string>")
    got = df.select(rules.is_hidden(F.col("path")), rules.is_useless_dir(F.col("path"))).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, False), (False, True)]


def test_gitignore_lines():
    assert parse_gitignore_line("# c") is None and parse_gitignore_line("   ") is None
    rx, neg, d = parse_gitignore_line("!keep.md")
    assert neg and not d
    rx, neg, d = parse_gitignore_line("build/")
    assert d and not neg
    import re

    assert re.fullmatch(parse_gitignore_line("\\#x")[0], "a/#x")
    assert re.fullmatch(parse_gitignore_line("trail\\ ")[0], "trail ")
    assert not re.fullmatch(parse_gitignore_line("trail  ")[0], "trail ")
    assert re.fullmatch(parse_gitignore_line("/a/*.c")[0], "a/x.c") and not re.fullmatch(parse_gitignore_line("/a/*.c")[0], "a/b/x.c")
    assert re.fullmatch(parse_gitignore_line("**/lib")[0], "x/y/lib")


def test_gitignore_walk(spark, files_of):
    from treeloom.operators.snapshot import WalkOptions, walk

    f = files_of({"r": {
        ".gitignore": "*.md\n!keep.md\n/only_root.txt\nbuild/\n",
        "a.md": "x", "keep.md": "x", "only_root.txt": "x", "sub/only_root.txt": "x",
        "build/out.txt": "x", "sub/.ignore": "!b.md\n", "sub/.gitignore": "b.md\n", "sub/b.md": "x",
        "sub/build/deep.txt": "x",
    }})
    w = walk(f, WalkOptions())
    kept = sorted("/".join(r["path"]) for r in w.files.collect())
    assert kept == ["keep.md", "sub/b.md", "sub/only_root.txt"]
    w2 = walk(f, WalkOptions(no_ignore=True))
    assert len(w2.files.collect()) == 5  # hidden ignore files and built-in build/ still dropped


def test_mktreeignore(spark, files_of):
    from treeloom.operators.snapshot import WalkOptions, walk

    f = files_of({"r": {".mktreeignore": "# c\n\n  *.tmp  \ncache/\n", "a.tmp": "x", "b.txt": "x", "cache/c.txt": "x"}})
    w = walk(f, WalkOptions(mktree_ignore=True))
    assert sorted("/".join(r["path"]) for r in w.files.collect()) == ["b.txt"]


def test_whitelist_rescues_hidden(spark, files_of):
    from treeloom.operators.snapshot import WalkOptions, walk

    f = files_of({"r": {".gitignore": "!.github/\n!.keep\n", ".github/ci.yml": "x", ".keep": "", ".other": "x", "a.txt": "x"}})
    w = walk(f, WalkOptions())
    assert sorted("/".join(r["path"]) for r in w.files.collect()) == [".github/ci.yml", ".keep", "a.txt"]


def test_reinclusion_below_ignored_dir_is_impossible(spark, files_of):
    from treeloom.operators.snapshot import WalkOptions, walk

    f = files_of({"r": {".gitignore": "gen/\n!gen/keep.txt\nlogs2/*\n!logs2/keep.txt\n",
                        "gen/keep.txt": "x", "gen/drop.txt": "x", "logs2/keep.txt": "x", "logs2/drop.txt": "x"}})
    w = walk(f, WalkOptions())
    # an ignored directory is never entered; ignoring only its contents allows re-inclusion
    assert sorted("/".join(r["path"]) for r in w.files.collect()) == ["logs2/keep.txt"]


def test_ignore_files_beat_deeper_gitignore_files(spark, files_of):
    from treeloom.operators.snapshot import WalkOptions, walk

    f = files_of({"r": {".ignore": "!x.md\n", "sub/.gitignore": "x.md\ny.md\n", "sub/x.md": "x", "sub/y.md": "y"}})
    assert sorted("/".join(r["path"]) for r in walk(f, WalkOptions()).files.collect()) == ["sub/x.md"]


def test_invalid_mktreeignore_glob_is_an_error_of_its_root(spark, files_of):
    from treeloom.operators.snapshot import WalkOptions, walk

    f = files_of({"bad": {".mktreeignore": "*.tmp\n[abc\n", "a.txt": "x"}, "good": {".mktreeignore": "\u00a0*.tmp\u2003\n", "a.tmp": "x", "b.txt": "x"}})
    w = walk(f, WalkOptions())
    assert [(r["root"], "/".join(r["path"])) for r in w.files.collect()] == [("good", "b.txt")]
    (error,) = w.errors.collect()
    assert error["root"] == "bad" and "line 2: [abc" in error["error"]


def test_rule_index_loses_no_match(spark):
    import random
    import re

    from treeloom.operators import ignore

    rng = random.Random(12)
    names = ["a", "b.txt", "c.tar.gz", ".env", "x.y", "ab", "a.b", "b", "*.txt", "[q]"]
    parts = [*names, "*", "**", "*.txt", "a*", "?b", "*.gz", "[ab].txt", "x.*", "*.", "\\*.txt", "*r.gz", "b?txt"]
    patterns = {"/".join(rng.choice(parts) for _ in range(rng.choice((1, 1, 1, 2, 3)))) for _ in range(150)}
    patterns |= {"/" + p for p in sorted(patterns)[:20]} | {p + "/" for p in sorted(patterns)[20:40]} | {"!" + p for p in sorted(patterns)[40:60]}
    paths_ = {tuple(rng.choice(names) for _ in range(rng.choice((1, 2, 3, 4)))) for _ in range(200)}
    nodes = spark.createDataFrame([("r", list(p), len(p) % 2 == 0) for p in sorted(paths_)], "root string, path array<string>, is_dir boolean")
    lines = sorted(patterns)
    rows = [("r", [".gitignore"], "\n".join(lines)), ("r", ["a", ".ignore"], "\n".join(lines[::-1])), ("r", ["a", "b", ".gitignore"], "*.gz\n!ab\n")]
    from treeloom.sources.tables import files_from_table

    files = files_from_table(spark.createDataFrame(rows, "root string, path array<string>, text string"))
    got = {tuple(r["path"]): r["negated"] for r in ignore.git_winners(nodes, ignore.gitignore_rules(files)).collect()}
    want = {}
    for _, where, text in rows:
        for n, line in enumerate(text.split("\n"), 1):
            rule = ignore.parse_gitignore_line(line)
            for p in sorted(paths_) if rule else ():
                d = where[:-1]
                if len(p) > len(d) and list(p[: len(d)]) == d and re.search(rule[0], "/".join(p[len(d) :])) and (not rule[2] or len(p) % 2 == 0):
                    place = (2 if where[-1] == ".ignore" else 1, len(d), n)
                    want[p] = max(want.get(p, ((0, 0, 0), None)), (place, rule[1]))
    assert got == {p: w[1] for p, w in want.items()} and len(got) > 100
