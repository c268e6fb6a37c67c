import hashlib
import re

from treeloom.llm.exact_dedup import DigestIndex, decisions, kept_documents

from edge_cases import EDGE


def _expected(rows):
    normal = {}
    for i, t in rows:
        normal.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((i, len(t or "")))
    out = []
    for text, members in normal.items():
        keep = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))[0]
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, keep, len(members), i == keep, sha) for i, _ in members]
    return sorted(out, key=str)


def test_decisions_match_brute_force(spark, edge_docs):
    got = decisions(edge_docs, DigestIndex(spark, buckets=3)).collect()
    assert sorted(map(tuple, got), key=str) == _expected(EDGE)


def test_longest_original_stays_then_smallest_id(spark, docs_of):
    rows = [(5, "ab c"), (3, "abc"), (4, "a b  c"), (2, "a b c "), (9, "other")]
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in decisions(docs_of(rows), DigestIndex(spark)).collect()}
    assert got == {5: (2, False), 3: (2, False), 4: (2, False), 2: (2, True), 9: (9, True)}


def test_later_batches_meet_the_persistent_index(spark, docs_of):
    first, second = docs_of([(1, "alpha"), (2, "beta")]), docs_of([(3, "be ta!"), (4, "al pha"), (5, "gamma"), (6, "gamma")])
    index = DigestIndex(spark, buckets=4)
    decisions(first, index, batch=0).collect()
    again = DigestIndex(spark, index.name)  # opened by name, as a later job would
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in decisions(second, again, batch=1).collect()}
    assert got == {3: (3, True), 4: (1, False), 5: (5, True), 6: (5, False)}
    size = again.entries().count()
    again.add(spark.createDataFrame([(7, 1, "zz")], "doc_id bigint, n_chars bigint, digest string"), 1)
    assert again.entries().count() == size == 4  # a batch is applied once


def test_large_groups_take_the_broadcast_path(spark, docs_of):
    rows = [(i, "copy  me" if i % 3 == 0 else f"own {i}") for i in range(1500)]
    got = decisions(docs_of(rows), DigestIndex(spark)).collect()
    assert sorted(map(tuple, got), key=str) == _expected(rows)


def test_kept_documents_keep_their_columns(spark, edge_docs, no_docs):
    kept = kept_documents(edge_docs, DigestIndex(spark))
    assert kept.columns == edge_docs.columns
    texts = [re.sub("[\x20\x09-\x0d]", "", r["text"] or "") for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub("[\x20\x09-\x0d]", "", t or "") for _, t in EDGE})
    assert decisions(no_docs, DigestIndex(spark)).collect() == []
