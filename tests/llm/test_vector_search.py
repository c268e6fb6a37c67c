import numpy as np
import pytest

from treeloom.llm import vector_search

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id bigint, embedding array<float>, label int, list int, score double, query_id bigint"


def table(spark, rows, partitions=3):
    return spark.createDataFrame([(i, v, 0, 1, 0.5, 7) for i, v in rows], SCHEMA).repartition(partitions)


def exact(rows, every, k):
    """All pairs, in double precision over the stored floats."""
    good = [(i, np.asarray(v, np.float32).astype(float)) for i, v in rows]
    out = {}
    for q, x in good:
        if q is not None and q % every == 0:
            near = sorted((-float((x * y).sum()), i is None, i or 0) for i, y in good if i != q)
            out[q] = [(None if none else i, -s) for s, none, i in near][:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def alike(got, want):
    """The same ids in the same order, scores equal up to rounding."""
    return [i for i, _ in got] == [i for i, _ in want] and [x for _, x in got] == pytest.approx([x for _, x in want])


def recall(got, want):
    pairs = [(q, i) for q, near in want.items() for i, _ in near]
    return np.mean([i in {v for v, _ in got.get(q, [])} for q, i in pairs])


@pytest.fixture(params=["even", "clusters", "lengths"])
def cloud(request):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1200, 16))
    if request.param == "clusters":
        x += 6 * rng.normal(size=(20, 16))[rng.integers(0, 20, 1200)]
    if request.param == "lengths":
        x *= rng.lognormal(0, 1, (1200, 1))
    return [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]


def test_recall_against_brute_force(spark, monkeypatch, cloud):
    monkeypatch.setattr(vector_search, "LIST_ROWS", 40)
    monkeypatch.setattr(vector_search, "SHELF_ROWS", 100)
    monkeypatch.setattr(vector_search, "QUERY_BLOCK", 10)
    got, want = found(vector_search.nearest(table(spark, cloud), 20, 20)), exact(cloud, 20, 20)
    assert got.keys() == want.keys() and all(len(n) == 20 for n in got.values())
    assert recall(got, want) >= 0.95
    x = {i: np.asarray(v, np.float32).astype(float) for i, v in cloud}
    for q, near in got.items():
        assert near == sorted(near, key=lambda n: (-n[1], n[0])) and q not in {i for i, _ in near}
        assert all(s == pytest.approx(float((x[q] * x[i]).sum()), rel=1e-12) for i, s in near)


def test_one_vector_on_a_third_of_all_rows_is_split_over_shelves(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "LIST_ROWS", 50)
    monkeypatch.setattr(vector_search, "SHELF_ROWS", 60)
    rng = np.random.default_rng(4)
    hot = rng.normal(size=8).tolist()
    rows = [(i, hot if i % 3 == 0 else rng.normal(size=8).tolist()) for i in range(900)]
    index = vector_search.Index(table(spark, rows))
    assert max(index.shelves) > 3
    got, want = found(index.search(vector_search.queries_of(index.rows, 20), 20)), exact(rows, 20, 20)
    assert np.mean([alike(got[q], near) for q, near in want.items() if q % 3 == 0]) > 0.8  # ties: the least ids
    assert recall(got, want) >= 0.95


def test_few_rows_give_all_candidates_and_odd_vectors_take_no_part(spark):
    good = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (None, [3.0, 3.0]), (-40, [-1.0, 0.0])]
    odd = [(40, None), (60, []), (80, [0.0, 0.0]), (100, [NAN, 1.0]), (120, [INF, 1.0]), (140, [1.0, 2.0, 3.0]), (160, [None, 1.0])]
    got = found(vector_search.nearest(table(spark, good + odd), 20, 20))
    want = exact(good, 20, 20)
    assert got.keys() == want.keys() and all(alike(got[q], near) for q, near in want.items())


def test_repeated_ids(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [0.3, 0.7]), (1, [0.3, 0.7]), (2, [1.0, 1.0])]
    got = found(vector_search.nearest(table(spark, rows), 20, 20))
    assert [i for i, _ in got[20]] == [2, 1]  # the least vector asks; rows of its id are not candidates; equal rows count once


def test_empty_and_single(spark):
    assert vector_search.nearest(table(spark, [(20, [1.0, 2.0])])).collect() == []
    assert vector_search.nearest(table(spark, [(20, None)])).collect() == []
    assert vector_search.nearest(table(spark, [(20, [1.0])]).limit(0)).columns == ["query_id", "rank", "vec_id", "score"]


def test_graph_search_finds_the_nearest_centroids():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = vector_search.Centroids(vector_search.balanced_centroids(x, 150))
    ids, far = c.search(x[:100].astype(np.float32), 40)
    truth = np.argsort(c.distances(x[:100].astype(np.float32), np.arange(len(c.points))), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(ids, truth)]) > 0.95
    assert (np.diff(far, axis=1) >= 0).all()


def test_cells_are_balanced():
    x = np.random.default_rng(6).normal(size=(1000, 5))
    assert len(vector_search.balanced_centroids(x, 40)) == 40
    same = np.ones((50, 3))
    assert len(vector_search.balanced_centroids(same, 8)) == 1
