"""The skew-safe formulations agree with their naive counterparts."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from treeloom.operators import paths, rules
from treeloom.operators.ordering import concatenated, ordinal_within


def test_ordinals_with_hot_key_across_partitions(spark):
    # one hot root with most rows, several small ones; 7 range partitions
    rows = [("hot", [f"d{i % 13}", f"f{i:05d}"]) for i in range(3000)] + [
        (f"r{j}", [f"x{k}"]) for j in range(20) for k in range(7)
    ]
    df = spark.createDataFrame(rows, "root string, path array<string>")
    got = ordinal_within(df, "root", "path", "ordinal", partitions=7)
    want = df.withColumn("ordinal", F.row_number().over(Window.partitionBy("root").orderBy("path")).cast("bigint"))
    key = ["root", "path", "ordinal"]
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))


def test_prune_join_equals_prefix_predicate(spark, files_of):
    entries = {f"{a}/{b}/{c}": "x" for a in ("src", "node_modules", "a.log", "pkg") for b in ("build", "lib", "x.egg-info")
               for c in ("f.py", "g.log", "Cargo.lock")}
    nodes = paths.path_closure(files_of({"r": entries}))
    own = rules.own_excluded(rules.DEFAULT_RULES, F.col("path"), F.col("is_dir"))
    pruned = paths.prune_subtrees(nodes.withColumn("excluded", own))
    direct = nodes.filter(~rules.DEFAULT_RULES.excluded(F.col("path"), F.col("is_dir")))
    assert sorted(r["path"] for r in pruned.collect()) == sorted(r["path"] for r in direct.collect())


def test_pieces_join_in_order_for_every_root(spark):
    pieces = spark.createDataFrame(
        [("big", 1, [f"n{i:04d}"], f"{i};") for i in range(900, -1, -1)] + [("big", 0, [], "head;"), ("none", 0, [], ""),
         ("s", 3, ["a", ""], "|"), ("s", 3, ["a"], "A"), ("s", 3, ["b"], "B"), ("s", 2, ["z"], "first ")],
        "root string, seq int, path array<string>, text string")
    got = {r["root"]: r["doc"] for r in concatenated(pieces, "doc").collect()}
    assert got == {"big": "head;" + "".join(f"{i};" for i in range(901)), "none": "", "s": "first A|B"}


def test_prefix_sums_with_a_hot_key(spark):
    from treeloom.operators.ordering import prefix_sums

    rows = [("hot", i % 3, [f"p{i:05d}"], i % 17) for i in range(4000)] + [(f"r{j}", 0, [f"x{k}"], k) for j in range(25) for k in range(9)]
    df = spark.createDataFrame(rows, "root string, seq int, path array<string>, length bigint").repartition(5)
    got = prefix_sums(df, "root", ["seq", "path"], "length", "start", partitions=13)
    w = Window.partitionBy("root").orderBy("seq", "path").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("start", F.coalesce(F.sum("length").over(w), F.lit(0)))
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
