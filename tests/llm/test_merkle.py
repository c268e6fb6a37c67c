import hashlib
import zlib

import pytest

from edge_cases import EDGE
from treeloom.llm import merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return H(*["-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in FIELDS])


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def path_of(levels, i):
    for level in levels[:-1]:
        yield (level[i ^ 1] if i ^ 1 < len(level) else None), i % 2
        i //= 2


def brute(rows):
    by = {}
    for row in rows:
        by.setdefault(row["lang"], []).append(row)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for own in by.values():
        own.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
    trees = {lang: levels_of([leaf_of(r) for r in by[lang]]) for lang in langs}
    top = levels_of([trees[lang][-1][0] for lang in langs])
    for k, lang in enumerate(langs):
        for i, row in enumerate(by[lang]):
            way = [*path_of(trees[lang], i), *path_of(top, k)]
            node = leaf_of(row)
            if row["doc_id"] is not None and row["n_chars"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0:
                node = leaf_of(row | {"n_chars": row["n_chars"] + 1})
            for beside, right in way:
                node = H(node) if beside is None else H(beside, node) if right else H(node, beside)
            proof = H(*[s for s, _ in way if s])
            yield row["doc_id"], leaf_of(row), trees[lang][-1][0], top[-1][0], proof, node, node == top[-1][0]


SHOWN = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, digest string, level int, tree string"


def table(spark, rows):
    return spark.createDataFrame([(*[r[c] for c in FIELDS], "x", 3, "t") for r in rows], SCHEMA)


def rows_of(n, lang):
    return [{"doc_id": 3 * i, "source": "s", "lang": lang, "n_chars": i, "text": f"t{i}"} for i in range(n)]


CASES = {
    "one": rows_of(1, "en"),
    "one language": rows_of(77, None),
    "many languages": [r for i in range(40) for r in rows_of(1 + i % 5, f"l{i}")],
    "hot language": rows_of(1030, "en") + rows_of(3, "\u00e9") + rows_of(2, "z") + rows_of(5, None) + rows_of(1, ""),
    "edges": [
        {"doc_id": i, "source": None, "lang": (None, "", "en")[n % 3], "n_chars": (None, 2**63 - 1, -1)[n % 3], "text": t}
        for n, (i, t) in enumerate([*EDGE, *EDGE, (14, "b"), (16, "d"), (23, "e")])
    ],
}


@pytest.mark.parametrize("bound", [merkle.BROADCAST_BYTES, 0])
@pytest.mark.parametrize("case", CASES)
def test_equal_to_brute_force(spark, monkeypatch, case, bound):
    if bound == 0 and case not in ("hot language",):
        pytest.skip("one case with joins only")
    monkeypatch.setattr(merkle, "BROADCAST_BYTES", bound)
    got = merkle.manifest(table(spark, CASES[case])).select(*SHOWN).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute(CASES[case]), key=repr)
    if case == "hot language":
        assert {r["verified"] for r in got} == {True, False}


def test_segments_hold_one_entry_a_level(spark):
    got = merkle.manifest(table(spark, rows_of(77, "en") + rows_of(1, "fr"))).collect()
    assert {(r["lang"], len(r["segment"])) for r in got} == {("en", 8), ("fr", 1)}


def test_empty_table(spark):
    assert merkle.manifest(table(spark, rows_of(1, "en")).limit(0)).collect() == []
