import os

import pytest

from treeloom.operators import scaffold as SC
from treeloom.sources.filetree import scan_files


def _nodes(spark, rows):
    return spark.createDataFrame([(r, p.split("/"), d, c) for r, p, d, c in rows],
                                 "root string, path array<string>, is_dir boolean, content string")


def _existing(spark, rows):
    return spark.createDataFrame([(r, p.split("/"), d) for r, p, d in rows], "root string, path array<string>, is_dir boolean")


def test_plan_actions(spark):
    wanted = _nodes(spark, [("r", "d", True, None), ("r", "f", False, "x"), ("r", "g", True, None), ("r", "h", False, "y"),
                            ("r", "n", False, "z")])
    existing = _existing(spark, [("r", "d", True), ("r", "f", False), ("r", "g", False), ("r", "h", True)])

    def acts(**kw):
        return {"/".join(r["path"]): (r["action"], r["conflict"]) for r in SC.scaffold_plan(wanted, existing, **kw).collect()}

    assert acts(force=True) == {"d": ("keep", False), "f": ("overwrite", False), "g": ("create", False),
                                "h": ("overwrite", False), "n": ("create", False)}
    assert acts(dry_run=True)["g"] == ("keep", False)
    strict = acts()
    assert strict["f"][1] and strict["g"][1] and strict["h"][1] and not strict["d"][1]


def test_write_and_conflict(spark, tmp_path):
    wanted = _nodes(spark, [("r", "a", True, None), ("r", "a/x.txt", False, "hi\n"), ("r", "b.txt", False, "")])
    target = str(tmp_path / "out")
    empty = _existing(spark, [])
    events = SC.scaffold_write(SC.scaffold_plan(wanted, empty), target).collect()
    assert all(e["written"] for e in events)
    assert open(os.path.join(target, "r", "a", "x.txt")).read() == "hi\n"
    assert os.path.getsize(os.path.join(target, "r", "b.txt")) == 0
    on_disk = scan_files(spark, [os.path.join(target, "r")]).select("root", "path", "is_dir")
    with pytest.raises(SC.ScaffoldConflict):
        SC.scaffold_write(SC.scaffold_plan(wanted, on_disk), target)
    bad = _nodes(spark, [("r", "../x", False, "no")])
    with pytest.raises(Exception):
        SC.scaffold_write(SC.scaffold_plan(bad, empty), target).collect()


def test_pick_template(spark):
    tpl = spark.createDataFrame([("t", "x.tree", "dotted", False), ("t", "y", "exact", False), ("", "python", "builtin", True)],
                                "dir string, name string, text string, builtin boolean")
    req = spark.createDataFrame([("1", "t", "x"), ("2", "t", "y"), ("3", "t", "python.tree"), ("4", "t", "nope")],
                                "req_id string, dir string, name string")
    got = {r["req_id"]: (r["text"], r["error"]) for r in SC.pick_template(req, tpl).collect()}
    assert got["1"] == ("dotted", None) and got["2"] == ("exact", None) and got["3"] == ("builtin", None)
    assert got["4"][1] == "Template 'nope' was not found in t or built-in templates (python)"


def test_files_and_directories_replace_each_other(spark, tmp_path):
    target = str(tmp_path / "out")
    os.makedirs(os.path.join(target, "r", "was_dir", "deep"))
    for rel in ("was_file", "was_dir/deep/x", "stays"):
        with open(os.path.join(target, "r", rel), "w") as fh:
            fh.write("old")
    wanted = _nodes(spark, [("r", "was_file", True, None), ("r", "was_file/new.txt", False, "n"), ("r", "was_dir", False, "now a file")])
    wanted = wanted.repartition(3)
    on_disk = scan_files(spark, [os.path.join(target, "r")]).select("root", "path", "is_dir")
    events = SC.scaffold_write(SC.scaffold_plan(wanted, on_disk, force=True), target)
    assert {("/".join(e["path"]), e["action"]) for e in events.collect()} == {
        ("was_file", "create"), ("was_file/new.txt", "create"), ("was_dir", "overwrite")}
    back = {"/".join(r["path"]): r["content"] and bytes(r["content"]) for r in scan_files(spark, [os.path.join(target, "r")]).collect()}
    assert back == {"was_file": None, "was_file/new.txt": b"n", "was_dir": b"now a file", "stays": b"old"}
    os.remove(os.path.join(target, "r", "stays"))
    events.count()  # reading the events again writes nothing
    assert not os.path.exists(os.path.join(target, "r", "stays"))


def test_an_unsafe_name_leaves_the_target_untouched(spark, tmp_path):
    target = str(tmp_path / "out")
    plan = SC.scaffold_plan(_nodes(spark, [("r", "fine.txt", False, "x"), ("r", "../x", False, "no")]), _existing(spark, []))
    with pytest.raises(SC.ScaffoldConflict, match="unsafe"):
        SC.scaffold_write(plan, target)
    assert not os.path.exists(target)


def _tree(top):
    found = {}
    for folder, names, files in os.walk(top):
        for n in names:
            found[os.path.relpath(os.path.join(folder, n), top)] = None
        for n in files:
            with open(os.path.join(folder, n), "rb") as fh:
                found[os.path.relpath(os.path.join(folder, n), top)] = fh.read()
    return found


def _old_target(tmp_path):
    target = str(tmp_path / "out")
    os.makedirs(os.path.join(target, "r", "was_dir", "deep"))
    for rel in ("was_file", "was_dir/deep/x", "stays", "changed"):
        with open(os.path.join(target, "r", rel), "w") as fh:
            fh.write("old " + rel)
    return target


def test_a_failing_task_leaves_the_target_as_it_was(spark, tmp_path):
    target = _old_target(tmp_path)
    before = _tree(target)
    wanted = _nodes(spark, [
        ("r", "was_file", True, None), ("r", "was_file/new.txt", False, "n"), ("r", "was_dir", False, "now a file"), ("r", "changed", False, "new"),
        ("r", "fresh", True, None), ("r", "fresh/in", True, None), ("r", "fresh/in/f", False, "f"), ("q", "other", False, "o"),
        ("r", "n" * 300, False, "its name is too long for the file system")]).repartition(4)
    on_disk = scan_files(spark, [os.path.join(target, "r")]).select("root", "path", "is_dir")
    with pytest.raises(Exception, match="too long"):
        SC.scaffold_write(SC.scaffold_plan(wanted, on_disk, force=True), target)
    assert _tree(target) == before


def test_a_failing_commit_is_undone(spark, tmp_path):
    target = _old_target(tmp_path)
    wanted = _nodes(spark, [
        ("r", "was_file", True, None), ("r", "was_file/new.txt", False, "n"), ("r", "was_dir", False, "now a file"), ("r", "changed", False, "new"),
        ("r", "fresh", True, None), ("r", "fresh/in", True, None), ("r", "fresh/in/f", False, "f"), ("q", "other", False, "o"),
        ("r", "appears", False, "x")]).repartition(4)
    on_disk = scan_files(spark, [os.path.join(target, "r")]).select("root", "path", "is_dir")
    plan = SC.scaffold_plan(wanted, on_disk, force=True)
    plan = spark.createDataFrame(plan.collect(), plan.schema)
    os.makedirs(os.path.join(target, "r", "appears", "full"))  # a directory that the plan knows nothing of
    before = _tree(target)
    with pytest.raises(Exception, match="in the place of a file"):
        SC.scaffold_write(plan, target)
    assert _tree(target) == before
    os.rmdir(os.path.join(target, "r", "appears", "full"))
    os.rmdir(os.path.join(target, "r", "appears"))
    SC.scaffold_write(plan, target)
    after = _tree(target)
    assert after["r/was_dir"] == b"now a file" and after["r/changed"] == b"new" and after["r/was_file/new.txt"] == b"n"
    assert after["q/other"] == b"o" and after["r/stays"] == b"old stays" and not any(".scaffold" in p for p in after)


def test_a_failed_write_into_a_new_target_leaves_none(spark, tmp_path):
    target = str(tmp_path / "none")
    plan = SC.scaffold_plan(_nodes(spark, [("r", "a", False, "x"), ("r", "n" * 300, False, "y")]), _existing(spark, []))
    with pytest.raises(Exception, match="too long"):
        SC.scaffold_write(plan, target)
    assert not os.path.exists(target)
