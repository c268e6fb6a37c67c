from pyspark.sql import functions as F

from treeloom.operators import paths
from treeloom.sources import tables

SF001 = "/root/testdata/sf0.001"


def naive_draw(paths_list):
    """Recursive drawing of nested dicts (brute-force comparison)."""
    tree = {}
    for p, is_dir in paths_list:
        node = tree
        for i, c in enumerate(p):
            node = node.setdefault(c, {"__dir__": False, "kids": {}})
            if i < len(p) - 1 or is_dir:
                node["__dir__"] = True
            node = node["kids"]

    def draw(kids, prefix):
        out = ""
        names = sorted(kids, key=lambda s: s.encode("utf-8"))
        for i, n in enumerate(names):
            last = i == len(names) - 1
            e = kids[n]
            out += prefix + ("└── " if last else "├── ") + n + ("/" if e["__dir__"] else "") + "\n"
            if e["kids"]:
                out += draw(e["kids"], prefix + ("    " if last else "│   "))
        return out

    return draw(tree, "")


def test_draw_tree_fixture(spark, files_of):
    f = files_of({"example-project": {"README.md": "x", "src/main.rs": "fn main() {}"}})
    t = paths.draw_tree(paths.path_closure(f)).collect()[0]["tree"]
    assert t == "example-project/\n├── README.md\n└── src/\n    └── main.rs\n"


def test_draw_tree_matches_naive_on_pages(spark):
    f = tables.page_files_table(spark, SF001)
    nodes = paths.path_closure(f)
    got = {r["root"]: r["tree"] for r in paths.draw_tree(nodes, with_root=False).collect()}
    per_root = {}
    for r in nodes.select("root", "path", "is_dir").collect():
        per_root.setdefault(r["root"], []).append((list(r["path"]), r["is_dir"]))
    assert got and all(got[k] == naive_draw(v) for k, v in per_root.items())


def test_preorder_ordinals(spark, files_of):
    f = files_of({"r": {"src/a": "1", "src-x": "2", "README.md": "3", "Źródło": "4", "__init__.py": "5", "_x": "6"}})
    got = [("/".join(r["path"]), r["ordinal"]) for r in paths.list_files(paths.path_closure(f)).orderBy("ordinal").collect()]
    assert [g[0] for g in got] == ["README.md", "__init__.py", "_x", "src/a", "src-x", "Źródło"]
    assert [g[1] for g in got] == [1, 2, 3, 4, 5, 6]


def test_closure_dirs_count(spark, files_of):
    f = files_of({"r": {"a/b/c.txt": "x", "a/d.txt": "y"}})
    n = paths.path_closure(f)
    assert paths.count_dirs(n).collect()[0]["dirs"] == 2
    # closure is idempotent
    again = paths.path_closure(n.withColumn("is_symlink", F.lit(False)))
    assert sorted(map(tuple, again.select("path", "is_dir").collect())) == sorted(map(tuple, n.select("path", "is_dir").collect()))
