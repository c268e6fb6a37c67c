from treeloom.operators import stats
from treeloom.operators.inspect import inspect_files
from treeloom.operators.secrets import secret_findings
from treeloom.operators.snapshot import WalkOptions, walk
from treeloom.sources import tables
from treeloom.streaming import files_stream as FS

SF001 = "/root/testdata/sf0.001"


def test_streaming_equals_batch(spark, tmp_path):
    files = tables.secret_docs(spark, SF001).drop("doc_id")
    # two arrivals of the same files table
    files.filter("root < 'src2'").write.parquet(str(tmp_path / "src" / "b1"))
    files.filter("root >= 'src2'").write.parquet(str(tmp_path / "src" / "b2"))
    stream = FS.read_files_stream(spark, str(tmp_path / "src" / "*"), max_files_per_trigger=1)

    q1 = FS.start(FS.findings_stream(stream), str(tmp_path / "findings"), str(tmp_path / "ck1"))
    q2 = FS.start(FS.file_stats_stream(stream), "file_stats", str(tmp_path / "ck2"), mode="update", fmt="memory")
    q3 = FS.start(FS.dir_counts_stream(stream), "dir_counts", str(tmp_path / "ck3"), mode="update", fmt="memory")
    for q in (q1, q2, q3):
        q.awaitTermination()

    got = {(r["root"], tuple(r["path"]), r["line"], r["kind"]) for r in spark.read.parquet(str(tmp_path / "findings")).collect()}
    want = {(r["root"], tuple(r["path"]), r["line"], r["kind"]) for r in secret_findings(inspect_files(files)).collect()}
    assert got == want

    w = walk(files, WalkOptions(no_ignore=True))
    batch = {r["root"]: (r["files"], r["dirs"], r["lines"], r["size"]) for r in
             stats.project_stats(inspect_files(w.files), w.nodes).collect()}
    # update mode: the memory sink keeps every update; the last one per root is the total
    fs = {}
    for r in spark.sql("select * from file_stats").collect():
        fs[r["root"]] = (r["files"], r["lines"], r["size"])
    ds = {}
    for r in spark.sql("select * from dir_counts").collect():
        ds[r["root"]] = max(ds.get(r["root"], 0), r["dirs"])
    assert {k: (v[0], ds[k], v[1], v[2]) for k, v in fs.items()} == batch
