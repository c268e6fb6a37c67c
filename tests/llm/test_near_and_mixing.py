import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from edge_cases import EDGE
from treeloom.llm import minhash, mixing


def _set(text, words):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    tokens = re.findall("[^\x20\x09-\x0d]+", t)
    if not tokens:
        return frozenset()
    return frozenset(tuple(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1)))


def _components(rows, words, percent=80):
    """Least reachable id by comparing all pairs."""
    sets = {i: _set(t, words) for i, t in rows}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            k = len(sets[a] & sets[b])
            if sets[a] and 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def _corpus(seed, groups=12, size=9, length=60, rate=0.05):
    rng = np.random.default_rng(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    rows = []
    for _ in range(groups):
        base = list(rng.choice(vocabulary, length))
        for _ in range(size):
            mutated = [w if rng.random() > rate * rng.random() else str(rng.choice(vocabulary)) for w in base]
            rows.append((len(rows), " ".join(mutated).capitalize()))
    rows += [(len(rows) + i, " ".join(rng.choice(vocabulary[:30], rng.integers(1, 12)))) for i in range(60)]
    order = rng.permutation(len(rows))
    return [(int(order[i]), t) for i, t in rows]


@pytest.mark.parametrize("words", [2, 5])
def test_components_match_all_pairs(docs_of, words):
    rows = _corpus(words)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs_of(rows), words).collect()}
    assert got == _components(rows, words)


def test_long_lists_are_compared_in_blocks(docs_of, monkeypatch):
    monkeypatch.setattr(minhash, "LIST", 6)
    monkeypatch.setattr(minhash, "BLOCK", 5)
    rows = _corpus(21, groups=3, size=60, length=50, rate=0.1)  # likeness on both sides of the bound
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs_of(rows), 2).collect()}
    want = _components(rows, 2)
    assert got == want
    assert len({c for _, c in want.values()}) > 10 and max(map(len, [[i for i in want if want[i][1] == c] for _, c in want.values()])) > 20


def test_frequent_values_come_last_however_many_they_are(docs_of, monkeypatch):
    def none(*_):
        raise AssertionError("documents that share only frequent values are compared in blocks")

    monkeypatch.setattr(minhash, "LIST", 6)
    monkeypatch.setattr(minhash, "MAX_FREQUENT", 1)
    monkeypatch.setattr(minhash, "_pool_links", none)
    common = [f"c{i}" for i in range(30)]
    rows = [(i, " ".join([*common, *(f"u{i}x{j}" for j in range(60))])) for i in range(40)]
    rows += [(40 + i, t + " tail") for i, t in rows[:9]]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs_of(rows), 2).collect()}
    assert got == _components(rows, 2) and got[48][1] == 8 and got[39][1] == 39


def test_near_duplicate_edges(edge_docs, no_docs):
    got = minhash.near_duplicates(edge_docs, 2).collect()
    assert len(got) == len(EDGE)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append((r["n_shingles"], r["component_id"], r["kept"]))
    assert by[1] == by[2] and by[1][0][0] == 0 or (by[1], by[2], by[3]) == ([(0, 1, True)], [(0, 2, True)], [(0, 3, True)])
    assert by[5] == [(1, 5, True)] and by[6] == [(1, 5, False)] and by[4] == [(1, 4, True)]
    assert by[10] == [(1, 10, True)] * 2 and by[7] == [(1, 7, True)] and by[8] == [(1, 8, True)]
    assert minhash.near_duplicates(no_docs).collect() == []


def test_shared_counts_and_bounds():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 90, rng.integers(1, 60))) for _ in range(20)]
    want = [[len(np.intersect1d(a, b)) for b in sets[7:]] for a in sets[:7]]
    assert minhash.shared_counts(sets[:7], sets[7:]).tolist() == want
    for n in range(1, 52):
        assert minhash.shared_at_least(n, 0.8) == -(-8 * n // 10)


def test_keep_one_returns_documents(docs_of):
    rows = _corpus(5)
    docs = docs_of(rows)
    kept = minhash.keep_one(docs, 5)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in _components(rows, 5).values()})


# --- mixing ----------------------------------------------------------------------


def _fill(total, children):
    """Deal tokens one at a time in proportion to weights (children: name -> (capacity, weight)), as a limit."""
    amount, open_, out = min(total, sum(c for c, _ in children.values())), dict(children), {}
    while True:
        weight = sum(w for _, w in open_.values())
        full = [n for n, (c, w) in open_.items() if c * weight <= amount * w]
        if not full:
            break
        for n in full:
            out[n] = open_.pop(n)[0]
        amount -= sum(out[n] for n in full)
    for n, (_, w) in open_.items():
        out[n] = amount * w // weight
    for n in sorted(open_)[: amount - sum(out[n] for n in open_)]:
        out[n] += 1
    return out


def test_budgets_and_prefixes(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        source = f"s{rng.integers(0, 7)}" if i % 3 else "s0"
        rows.append((i, " ".join(["w"] * int(rng.integers(0, 40))), str(rng.choice(["en", "de", "fr"], p=[0.8, 0.15, 0.05])), source))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    weights = {
        "domain": F.when(F.col("domain") == "d0", 1).otherwise(4),
        "lang": F.when(F.col("lang") == "en", 5).otherwise(3),
        "source": F.length("source") + F.when(F.col("source") == "s3", 6).otherwise(0),
    }
    domain = F.concat(F.lit("d"), (F.substring("source", 2, 1).cast("int") % 2).cast("string"))
    budget = 5000
    got = mixing.mix(docs, budget, weights, domain, seed=5, max_epochs=2).collect()

    tokens, tree = {}, defaultdict(lambda: defaultdict(lambda: defaultdict(int)))
    for i, t, lang, source in rows:
        tokens[i] = len(t.split())
        tree[f"d{int(source[1]) % 2}"][lang][source] += tokens[i]
    cap = lambda x: 2 * x if isinstance(x, int) else sum(map(cap, x.values()))
    leaf = {}
    for d, a in _fill(budget, {d: (cap(v), 1 if d == "d0" else 4) for d, v in tree.items()}).items():
        for lang, b in _fill(a, {x: (cap(v), 5 if x == "en" else 3) for x, v in tree[d].items()}).items():
            for s, c in _fill(b, {x: (cap(v), 2 + 6 * (x == "s3")) for x, v in tree[d][lang].items()}).items():
                leaf[d, lang, s] = c
    assert sum(leaf.values()) == budget
    taken = defaultdict(list)
    for r in got:
        assert r["leaf_budget"] == leaf[r["domain"], r["lang"], r["source"]] and r["n_tokens"] == tokens[r["doc_id"]]
        taken[r["domain"], r["lang"], r["source"], r["epoch"]].append((r["order_key"], r["doc_id"]))
    import hashlib

    for (d, lang, s), b in leaf.items():
        members = [i for i, _, l, x in rows if (l, x) == (lang, s)]
        supply, at, epoch = sum(tokens[i] for i in members), 0, 0
        while at < b:
            order = sorted((hashlib.md5(f"5:{epoch}:{i}".encode()).hexdigest(), i) for i in members)
            want, sofar = [], 0
            for key, i in order:
                if at + sofar >= b and b - at < supply:
                    break
                want.append((key, i))
                sofar += tokens[i]
            assert sorted(taken.pop((d, lang, s, epoch), [])) == want
            at, epoch = at + supply, epoch + 1
    assert not taken


def test_mixing_edges(edge_docs, no_docs):
    weights = {k: F.lit(1) for k in mixing.LEVELS}
    whole = mixing.mix(edge_docs, 10**9, weights, F.lit(None).cast("string"), max_epochs=1).collect()
    assert len(whole) == len(EDGE)
    assert mixing.mix(edge_docs, 0, weights, F.lit("d")).collect() == []
    assert mixing.mix(no_docs, 100, weights, F.lit("d")).collect() == []
    nothing = {**weights, "lang": F.lit(0)}
    assert mixing.mix(edge_docs, 100, nothing, F.lit("d")).collect() == []
    kept = mixing.take_mixture(edge_docs, weights, F.lit("d"), seed=1, share=0.5)
    assert kept.columns == edge_docs.columns and 0 < kept.count() < len(EDGE)


def _without_ids():
    """Texts without an id, and ids that different texts share."""
    words = [f"u{i}" for i in range(50)]
    text = lambda i: " ".join(words[(i * 7 + j * (i % 11 + 1)) % 50] for j in range(20)) + f" end{i}"
    return [(None if i % 3 == 0 else i // 6, text(i)) for i in range(120)]


def test_mixture_keeps_rows_without_or_with_shared_ids(docs_of):
    rows = [*_without_ids(), (3, "copy"), (3, "copy"), (3, "copy")]
    weights = {k: F.lit(1) for k in mixing.LEVELS}
    docs = docs_of(rows)
    whole = mixing.take_mixture(docs, weights, F.lit("d"), seed=1, share=1.0)
    order = lambda found: sorted((r is None, r or 0, t) for r, t in found)
    assert order((r["doc_id"], r["text"]) for r in whole.collect()) == order(rows)
    total = sum(len(t.split()) for _, t in rows)
    part = mixing.take_mixture(docs, weights, F.lit("d"), seed=1, share=0.5).collect()
    tokens = sum(len(r["text"].split()) for r in part)
    assert total // 2 <= tokens < total // 2 + 21
    assert any(r["doc_id"] is None for r in part) and any(r["doc_id"] is not None for r in part)


def test_keep_one_compares_rows_without_or_with_shared_ids(docs_of):
    base = " ".join(f"n{i}" for i in range(60))
    rows = [(None, base + " x"), (None, base + " y"), (7, base), (9, base + " z"), (9, "quite another text of the same id"), (None, "alone here without id")]
    kept = minhash.keep_one(docs_of(rows), 2)
    want = {(7, base), (9, "quite another text of the same id"), (None, "alone here without id")}
    assert len(got := kept.collect()) == 3 and {(r["doc_id"], r["text"]) for r in got} == want


# --- pipeline --------------------------------------------------------------------


def test_pipeline_stages_take_effect(spark, tmp_path, docs_of):
    import corpus_pipeline

    rng = np.random.default_rng(2)
    words = [f"t{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(400):
        good = i % 4 != 0
        body = (" " if good else " | ").join(rng.choice(words, 80))
        rows.append((i, body))
        labels.append((i, int(good), 0))
    rows += [(400 + i, rows[4 * i + 1][1] + " ") for i in range(20)]  # equal but for blanks
    rows += [(420 + i, rows[4 * i + 2][1] + " tail") for i in range(20)]  # nearly equal
    docs_of(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "minhash", "mixing", "byte_bpe"]
    docs, left = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    columns = docs.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        left.append({r["doc_id"] for r in docs.collect()})
        assert n == 4 or docs.columns == columns
    good = {i for i, _ in rows if i >= 400 or i % 4}
    assert left[0] == good
    # the copy with a trailing blank has more code points, so it stays
    assert left[1] == good - {4 * i + 1 for i in range(20)}
    assert left[2] == left[1] - set(range(420, 440))
    assert left[3] < left[2] and len(left[3]) > 0.8 * len(left[2]) and left[4] == left[3]
    whole = {tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == {tuple(r) for r in docs.collect()}
