import pickle
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from edge_cases import EDGE
from treeloom.llm import byte_bpe, chat, fingerprint, quality, secret_scan, token_store, toxicity

P = pytest.importorskip("public_tokenizers")
RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")


def _tiktoken():
    import tiktoken

    ranks = {t: i for i, t in enumerate(byte_bpe.load_ranks(open(RANKS, "rb").read()))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


# --- byte-level BPE --------------------------------------------------------------


def test_bpe_ids_equal_tiktoken_and_decode(edge_docs, no_docs):
    enc = _tiktoken()
    got = byte_bpe.encode_documents(edge_docs, RANKS, P.PATTERN).collect()
    assert len(got) == len(EDGE)
    texts = {(i, (t or "").encode()) for i, t in EDGE}
    for r in got:
        text = bytes(r["decoded"])
        assert (r["doc_id"], text) in texts
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == enc.encode_ordinary(text.decode())
    assert byte_bpe.encode_digests(no_docs, RANKS, P.PATTERN).collect() == []


def test_bpe_on_odd_strings():
    codec, enc = byte_bpe.codec_for(open(RANKS, "rb").read(), P.PATTERN), _tiktoken()
    rng = np.random.default_rng(5)
    alphabet = [chr(c) for c in [*range(0, 0x180), 0x85, 0x2028, 0x180E, 0x200B, 0x3000, 0x4E00, 0x1F600, 0x300, 0x660]]
    for _ in range(400):
        text = "".join(rng.choice(alphabet, rng.integers(0, 40)))
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(text) and codec.decode(ids).decode() == text


# --- token store -----------------------------------------------------------------


@pytest.mark.parametrize("top", [200, 60_000, 2**32 - 1])
def test_codes_give_random_access(top):
    rng = np.random.default_rng(top)
    for n in (0, 1, 8, 511, 512, 513, 4000):
        ids = rng.integers(0, top, n).astype("<u4")
        reader = token_store.DacReader(token_store.dac_encode(ids))
        assert np.array_equal(reader.slice(0, n), ids)
        for i in rng.integers(0, max(n, 1), 25 if n else 0):
            assert reader[int(i)] == ids[i]
            j = int(rng.integers(i, n + 1))
            assert np.array_equal(reader.slice(int(i), j), ids[i:j])


def test_written_ids_read_back_in_order(spark, edge_docs, no_docs, monkeypatch):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    path = token_store.fresh_path(spark)
    token_store.write_ids(edge_docs, WORDS, path, end_id=1)
    want, start, flat = [], 0, []
    for i, t in sorted(EDGE, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
        flat += ids
    got = sorted(map(tuple, token_store.read_ids(spark, path).collect()), key=lambda r: r[1])
    assert got == want
    places = [0, 1, len(flat) // 2, len(flat) - 1]
    picked = token_store.ids_at(spark.createDataFrame([(p,) for p in places], "position bigint"), path)
    assert {r["position"]: r["id"] for r in picked.collect()} == {p: flat[p] for p in places}
    empty = token_store.fresh_path(spark)
    token_store.write_ids(no_docs, WORDS, empty, end_id=1)
    assert token_store.read_ids(spark, empty).collect() == []


def test_word_encoder_equals_the_library():
    encoder = token_store.encoder_for(open(WORDS, encoding="utf-8").read())
    rng = np.random.default_rng(7)
    alphabet = [chr(c) for c in [*range(0, 0x180), 0x2028, 0x85, 0x3A3, 0x130, 0x212A, 0x300, 0x4E00, 0x1F600]] + ["<|endoftext|>", "'s", " "]
    for _ in range(400):
        text = "".join(rng.choice(alphabet, rng.integers(0, 30)))
        want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want, repr(text)


# --- secrets ---------------------------------------------------------------------


def _base(text):
    found = []
    rx = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    folded = re.sub(r"\(password\|passwd\|secret\|token\|api_\?key\)", lambda m: re.sub("[a-z]", lambda c: f"[{c[0]}{c[0].upper()}]", m[0]), rx)
    found += [(m.start(), 0, m.end()) for m in re.finditer(folded, text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def test_fixed_patterns_match_their_definition():
    rng = np.random.default_rng(3)
    bits = ["password", "ApiKey", "API_key", " token ", "ſecret", "toKen", "=", " : ", '"', "'", "0123456789abcdef", "AKIA", "ABCDEFGH1234567", "deadbeef",
            "é", " ", "secret=token=", "x" * 12, "-", "\n", "short"]
    for _ in range(2000):
        text = "".join(rng.choice(bits, rng.integers(1, 12)))
        assert secret_scan.fixed_spans(text) == _base(text), repr(text)


def test_random_keys_are_found_and_words_are_not(spark, docs_of):
    import base64

    rng = np.random.default_rng(11)
    rows, planted = [], {}
    for i in range(300):
        words = "internationalisation/of_long-words camelCaseIdentifierNumber2 com/acme/module-2024/index build-artifact-000000000001"
        if i % 3 == 0:
            key = base64.b64encode(rng.bytes(30)).decode()
            planted[i] = key
            words += f" blob {key} end"
        rows.append((i, words))
    got = {r["doc_id"]: r for r in secret_scan.scan(docs_of(rows)).collect()}
    hit = sum(any(f":{rows[i][1].index(k)}:" in s for s in [got[i]["spans"]]) for i, k in planted.items())
    assert hit >= 0.9 * len(planted)
    assert sum(got[i]["n_random"] for i in got if i not in planted) <= 5
    for i, r in got.items():
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (0, 0, 0)


def test_planted_keys_stay_found_when_the_corpus_is_repeated(spark, docs_of):
    rng = np.random.default_rng(59)
    alphabet = list(secret_scan.ENCODINGS["base62"])
    words = "the file of a long story camelCaseIdentifierNumber2 com/acme/module-2024/index build-artifact-000000000001"
    rows = [(i, f"{words} key {''.join(rng.choice(alphabet, 36))} end") for i in range(40)]
    once = {r["doc_id"]: r["spans"] for r in secret_scan.scan(docs_of(rows)).collect()}
    many = secret_scan.scan(docs_of([(i + 40 * n, t) for n in range(300) for i, t in rows])).collect()
    assert sum("random" in s for s in once.values()) >= 38
    assert all(r["spans"] == once[r["doc_id"] % 40] for r in many)


def test_a_strongly_random_token_is_accepted_in_a_dirty_cell():
    counts = np.zeros(secret_scan.EVIDENCE_STEPS * secret_scan.MOST_EVIDENCE + 2, np.int64)
    counts[-1], counts[:8], counts[35 * secret_scan.EVIDENCE_STEPS] = 10**8, 10**6, 1
    assert 2 < secret_scan.cutoffs({"base62/5": counts}, 0.05)["base62/5"] <= 35


def test_secret_scan_edge_cases(edge_docs, no_docs):
    got = secret_scan.scan(edge_docs).collect()
    assert len(got) == len(EDGE) and all(r["spans"] == "" for r in got)
    assert {r["base_sha256"] for r in got} == {hashlib.sha256(b"").hexdigest()}
    assert secret_scan.scan(no_docs).collect() == []


def test_battery_is_uniform_for_random_tokens():
    rng = np.random.default_rng(2)
    alphabet = list(secret_scan.ENCODINGS["base62"])
    p = [secret_scan.combined(secret_scan.battery("".join(rng.choice(alphabet, 40)), "base62")) for _ in range(600)]
    assert 0.4 < np.mean(p) < 0.65 and np.mean(np.array(p) < 0.05) < 0.08
    assert secret_scan.combined(secret_scan.battery("a1" * 20, "base62")) < 1e-6


def _brute_scan(rows, rate=0.05):
    """The scan over a few documents, each step written out: pairs, ratios, discovery control, spans."""
    S = secret_scan
    texts = [t or "" for _, t in rows]
    model = S.ordinary_text(sum(S.pair_counts(t) for t in texts))
    place = {c: i for i, c in enumerate(S.CHARACTERS)}
    found = []
    for n, text in enumerate(texts):
        for m in S.CANDIDATE.finditer(text):
            encoding = S.infer_encoding(m.group())
            if encoding is None:
                continue
            ratio = S.battery_evidence(S.combined(S.battery(m.group(), encoding)))
            for i, c in enumerate(m.group()):
                row = place[m.group()[i - 1]] if i else len(place)
                likely = model[row, place[c]] + S.SEEN * m.group()[:i].count(c) / max(i, 1)
                ratio -= math.log(len(S.ENCODINGS[encoding]) * likely)
            found.append((n, m.start(), m.end(), (encoding, S.length_class(len(m.group()))), ratio))
    cells = {}
    for f in found:
        cells.setdefault(f[3], []).append(min(math.floor(f[4] * S.EVIDENCE_STEPS) / S.EVIDENCE_STEPS, S.MOST_EVIDENCE))
    accepted = set()
    for cell, ratios in cells.items():
        good = [r for r in set(ratios) if r >= 0 and sum(x >= r for x in ratios) * rate * math.exp(r) >= len(ratios)]
        accepted |= {f[:3] for f in found if f[3] == cell and good and f[4] >= min(good)}
    out = []
    for n, (i, _) in enumerate(rows):
        fixed = S.fixed_spans(texts[n])
        random = [(s, 3, e) for m, s, e in sorted(accepted) if m == n]
        fresh = [x for x in random if not any(x[0] < e and s < x[2] for s, _, e in fixed)]
        out.append((i, ",".join(f"{S.KINDS[k]}:{s}:{e}" for s, k, e in sorted(fixed + fresh)), len(random)))
    return out


def test_scan_equals_a_brute_force(docs_of, edge_docs):
    rng = np.random.default_rng(11)
    key = lambda n, a: "".join(rng.choice(list(a), n))
    rows = []
    for i in range(60):
        words = ["the", "a1b2c3", "section/of/path12", "user_name_2024", "ordinary", "version-1-of-the-file", f"id{i}"]
        body = list(rng.choice(words, 60))
        if i % 3 == 0:
            body.insert(20, key(int(rng.integers(20, 60)), secret_scan.ENCODINGS["base62"]))
        if i % 7 == 0:
            body.insert(5, "token=" + key(24, secret_scan.ENCODINGS["base62"]))
        if i % 10 == 0:
            body.insert(9, key(40, secret_scan.ENCODINGS["hex"]))
        rows.append((i, " ".join(body)))
    rows += [(100, None), (101, ""), (102, "AKIA" + key(16, secret_scan.ENCODINGS["BASE36"])), (102, "repeated id")]
    got = [(r["doc_id"], r["spans"], r["n_random"]) for r in secret_scan.scan(docs_of(rows)).collect()]
    want = _brute_scan(rows)
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(n for _, _, n in want) >= 15


def test_scan_of_very_long_tokens(docs_of):
    import time

    rng = np.random.default_rng(1)
    random = "".join(rng.choice(list(secret_scan.ENCODINGS["base64"]), 1_000_000))
    rows = [(1, "z1" * 100_000), (2, random), (3, "plain words " * 500), (4, "token: " + random[:200_000])]
    began = time.time()
    got = {r["doc_id"]: r for r in secret_scan.scan(docs_of(rows)).collect()}
    assert time.time() - began < 120
    assert got[1]["spans"] == "" and got[2]["n_random"] == 1 and got[3]["spans"] == "" and got[4]["n_assign"] == 1


# --- fingerprints ----------------------------------------------------------------


def test_fingerprint_edits_neighbours_and_edges(spark, docs_of, edge_docs, no_docs):
    rng = np.random.default_rng(4)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru", "te") for b in ("na", "so", "vi", "per", "dun")]
    rows = [(i * 7 - 3, " ".join(rng.choice(words, rng.integers(40, 4000)))) for i in range(25)]
    rows[5] = (rows[5][0], rows[4][1])
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(docs_of(rows)).collect()}
    order = sorted(rows)
    for n, (i, t) in enumerate(order):
        k = len(t) // 4
        edited = t[: len(t) - k] + order[(n + 1) % len(order)][1][:k]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        assert got[i]["near_edited"] > 0.3 and got[i]["edited_shift"] == 0
    assert got[rows[4][0]]["near_next"] == 1.0 and got[rows[4][0]]["fingerprint"] == got[rows[5][0]]["fingerprint"]
    assert all(r["near_next"] < 0.3 for i, r in got.items() if i != rows[4][0])

    edge = fingerprint.fingerprints(edge_docs).collect()
    assert len(edge) == len(EDGE)
    by_text = {r["n_chars"]: r for r in edge}
    assert by_text[0]["fingerprint"] == "" and by_text[200_000]["fingerprint"]
    assert fingerprint.fingerprints(no_docs).collect() == []
    one = fingerprint.fingerprints(docs_of([(4, "only this one")])).collect()[0]
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"only this onl").hexdigest()


def test_a_short_passage_is_seen_in_a_long_text(docs_of):
    rng = np.random.default_rng(12)
    words = lambda stem, n: list(rng.choice([f"{stem}{i}" for i in range(4000)], n))
    passage = words("p", 60)
    long = " ".join([*words("a", 9000), *passage, *words("a", 9000)])
    rows = [(1, long), (2, " ".join([*words("b", 300), *passage, *words("b", 300)]))]
    assert len(long) > 90_000
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(docs_of(rows)).collect()}
    found = {i: dict(reversed([x.split("@") for x in r["fingerprint"].split(",")])) for i, r in got.items()}
    common = found[1].keys() & found[2].keys()
    assert len(common) >= 15 and {int(found[1][h]) - int(found[2][h]) for h in common} == {8700}
    want = len(common) / len(found[1].keys() | found[2].keys())
    assert got[1]["near_next"] == got[2]["near_next"] == want


def _hash(*longs):
    """Spark's xxhash64 of a string or of bigints, each seeded by the hash before it."""
    import xxhash

    seed = 42
    for x in longs:
        raw = x.encode() if isinstance(x, str) else (x & (2**64 - 1)).to_bytes(8, "little")
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - 2**64 if seed >= 2**63 else seed


def _anchors(text):
    """Every closed syncmer by definition: {position: hash}."""
    import regex

    hashes = [_hash(s) for s in regex.findall(
        r"[\p{Ideographic}\p{Hiragana}\p{Katakana}]|[\p{L}\p{M}\p{N}]{1,6}|[^\s\p{L}\p{M}\p{N}]", text)]
    k, s = fingerprint.K, fingerprint.S
    if len(hashes) < k:
        return dict(enumerate(hashes))
    out = {}
    for i in range(len(hashes) - k + 1):
        inner = [_hash(*hashes[j : j + s]) for j in range(i, i + k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            whole = hashes[i]
            for h in hashes[i + 1 : i + k]:
                whole = _hash(whole, h)
            out[i] = whole
    return out


def _alike(a, b):
    a, b = set(a.values()), set(b.values())
    return len(a & b) / len(a | b) if a | b else 1.0


def _shift(a, b):
    first = lambda x: {h: p for p, h in sorted(x.items(), reverse=True)}
    a, b = first(a), first(b)
    apart = sorted(b[h] - a[h] for h in a.keys() & b.keys())
    return apart[(len(apart) - 1) // 2] if apart else None


def test_fingerprints_equal_a_brute_force(docs_of):
    rng = np.random.default_rng(7)
    words = ["a", "bb", "ccc", "stretched", ",", ".", "\u00e9t\u00e9", "\u4f8b\u3048", "12", "x" * 14, "\n", "  "]
    rows = [(i, "".join(w + " " * int(rng.integers(0, 2)) for w in rng.choice(words, rng.integers(0, 120)))) for i in range(60)]
    rows += [(60 + i, " ".join("abcdefgh"[: i + 1])) for i in range(8)] + [(80, ""), (81, "z" * 90), (82, "a b c d e f g      "), (83, None)]
    rows += [(84, " ".join(["same words here again"] * 30)), (85, " ".join(["same words here again"] * 31))]
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(docs_of(rows)).collect()}
    for n, (i, text) in enumerate(rows):
        text, after = text or "", rows[(n + 1) % len(rows)][1] or ""
        k = len(text) // 4
        edited = text[: len(text) - k] + after[:k]
        a, b, r = _anchors(text), _anchors(edited), got[i]
        shown = lambda x: ",".join(f"{h & (2**64 - 1):016x}@{p}" for p, h in sorted(x.items()))
        assert (r["fingerprint"], r["edited_fingerprint"]) == (shown(a), shown(b)), i
        assert r["near_edited"] == pytest.approx(_alike(a, b)) and r["near_next"] == pytest.approx(_alike(a, _anchors(after)))
        assert r["edited_shift"] == _shift(a, b), i


# --- classifiers -----------------------------------------------------------------


def _labelled(spark, docs_of, n=900):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(80)]
    rows, labels = [], []
    for i in range(n):
        body = " ".join(rng.choice(words, 40))
        good, bad = int(rng.random() > 0.25), int(rng.random() < 0.2)
        if not good:
            body = " | ".join(rng.choice(words, 40))
        if bad:
            body += " idiot scumbag"
        rows.append((i, body))
        labels.append((i, good, bad))
    return docs_of(rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), labels


def test_classifiers_on_held_out_rows(spark, docs_of):
    docs, labels, truth = _labelled(spark, docs_of)
    for got, at in ((quality.classify(docs, labels).collect(), 1), (toxicity.classify(docs, labels).collect(), 2)):
        right = [r["predicted"] == truth[r["doc_id"]][at] for r in got if r["held_out"]]
        assert len(right) > 100 and np.mean(right) > 0.97
        for r in got:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1


def test_classifiers_never_learn_from_held_out_labels(spark, docs_of):
    docs, labels, _ = _labelled(spark, docs_of, 400)
    flipped = spark.createDataFrame(
        [(r["doc_id"], 1 - r["quality"], 1 - r["toxic"]) if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 else tuple(r) for r in labels.collect()],
        "doc_id bigint, quality int, toxic int")
    for f in (quality.classify, toxicity.classify):
        a, b = ({r["doc_id"]: r["score"] for r in f(docs, x).collect()} for x in (labels, flipped))
        assert a.keys() == b.keys() and all(math.isclose(a[i], b[i], abs_tol=1e-9) for i in a)


def test_classifiers_edge_cases(spark, edge_docs, no_docs):
    schema = "doc_id bigint, quality int, toxic int, extra string"
    none = spark.createDataFrame([], schema)
    odd = spark.createDataFrame([(4, 1, 0, "x"), (4, 0, 1, "x"), (5, None, None, "x"), (None, 1, 1, "x"), (6, 0, 1, "x"), (7, 1, 0, "x"), (8, 1, 0, "x")], schema)
    for f in (quality.classify, toxicity.classify):
        for labels in (none, odd):
            got = f(edge_docs, labels).collect()
            assert len(got) == len(EDGE) and all(0 <= r["score"] <= 1 for r in got)
            assert not any(r["held_out"] for r in got if r["doc_id"] is None)
        assert f(no_docs, odd).collect() == []


def test_block_max_search_is_exact():
    rng = np.random.default_rng(6)

    def unit():
        ids = np.sort(rng.choice(60, rng.integers(1, 12), replace=False))
        w = rng.random(len(ids)) + 0.05
        return ids, w / np.sqrt((w**2).sum())

    rows = [unit() for _ in range(700)]
    rows += rows[:40]  # ties
    dense = np.zeros((len(rows), 60))
    for i, (ids, w) in enumerate(rows):
        dense[i, ids] = w.astype(np.float32)
    index = toxicity.BlockMaxIndex(
        np.concatenate([r[0] for r in rows]), np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows]),
        np.concatenate([r[1] for r in rows]), 60, len(rows), block=16)
    for n in range(80):
        ids, w = unit() if n % 2 else rows[n]
        cosines = dense[:, ids] @ w
        if n % 4 == 0:
            cosines[n] = 0
        want = [i for i in np.lexsort((np.arange(len(rows)), -cosines.round(9)))[:15] if cosines[i] > 0]
        got = index.search(ids, w, 15, n if n % 4 == 0 else -1)
        assert np.allclose([s for s, _ in got], cosines[want]) and {i for _, i in got if i >= 700} <= set(range(700, 740))
        assert len(got) == len(want)


def test_many_searches_at_once_equal_single_ones_and_terms_are_hashed_once(monkeypatch):
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(300):
        ids = rng.permutation(np.concatenate([rng.choice(8, 5, replace=False), 8 + rng.choice(500, 6, replace=False)]))  # some common, some rare
        w = rng.random(len(ids)) + 0.05
        rows.append((ids, w / np.sqrt((w**2).sum())))
    rows += rows[:1] * 60  # more copies than are asked for
    example = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    index = toxicity.ExactIndex(np.concatenate([r[0] for r in rows]), example, np.concatenate([r[1] for r in rows]), 508, len(rows), block=7)
    dense = np.zeros((len(rows), 508), np.float32)
    for i, (ids, w) in enumerate(rows):
        dense[i, ids] = w
    left_out = [i if i % 3 else -1 for i in range(len(rows))]
    together = pickle.loads(pickle.dumps(index)).search_all(rows, 15, left_out)
    for i, (ids, w) in enumerate(rows):
        cosines = np.zeros(len(rows))
        for t, x in zip(ids, w):  # in the query's order
            cosines += x * dense[:, t].astype(float)
        if left_out[i] >= 0:
            cosines[i] = 0
        want = [(cosines[j], j) for j in np.lexsort((np.arange(len(rows)), -cosines))[:15] if cosines[j] > 0]
        assert together[i] == want == index.search(ids, w, 15, left_out[i])

    text = "Some words, SOME other words beginning beginnings begin and, somewhat, ^begi beginning"
    for keep in (slice(0, None, 2), slice(1, None, 2), slice(None), slice(0, 0)):
        counts = toxicity.terms(text)
        model = toxicity.NearestExamples(np.sort(toxicity.hashed(counts)[0])[keep], 0.5)
        want = model.known(*toxicity.hashed(counts))
        with monkeypatch.context() as m:
            for _ in range(2):
                assert all(np.array_equal(x, y) for x, y in zip(model.numbered(text), want, strict=True))
                m.setattr(toxicity, "hashed_terms", None)  # all words are known now
        assert not len(model.numbered("")[0]) and not len(model.numbered("unheard, of")[1])


def test_toxicity_looks_up_the_new_words_of_many_texts_at_once(monkeypatch):
    """One call hashes what a batch adds; each text's terms and their order are those of the pattern."""
    every = "".join(chr(i) + ("x" if i % 3 else " ") for i in range(0x30000) if not 0xD800 <= i < 0xE000)
    texts = [
        "", "Plain words, PLAIN beginnings begin_beginning\x1f\x00tab\tend", "Ünïcode wörds \u2014 wörds\u00a0\u3000und\u0301 Anfänge anfängt \u4e2d\u6587",
        "İstanbul ß straße STRASSE \u00b2 \u0661\u0662 \u2028 _a-b", "unseen thing", "plain words", every[:400], every,
    ]
    for t in texts:
        assert toxicity.words_of(t) == toxicity.WORD.findall(t.lower())
    keys = np.unique(np.concatenate([toxicity.hashed(toxicity.terms(t))[0] for t in texts if "unseen" not in t]))
    want = [toxicity.NearestExamples(keys, 0.5).known(*toxicity.hashed(toxicity.terms(t))) for t in texts]
    hashed, calls = toxicity.hashed_terms, []
    monkeypatch.setattr(toxicity, "hashed_terms", lambda found: calls.append(len(found)) or hashed(found))
    for remembered in (toxicity.REMEMBERED, 5):
        monkeypatch.setattr(toxicity, "REMEMBERED", remembered)
        model = toxicity.NearestExamples(keys, 0.5)
        for again in range(3):
            calls.clear()
            got = model.numbered_all(texts)
            assert len(calls) == (0 if again else 1)
            assert all(np.array_equal(x, y) for g, w in zip(got, want, strict=True) for x, y in zip(g, w, strict=True))
        assert len(model.numbered_all(["other words", "words other new"])) == 2 and len(calls) == 1


def test_toxicity_neighbours_equal_a_brute_force(spark, docs_of):
    """Whole documents: every term of the examples, frequencies over all documents, exact cosines."""
    rng = np.random.default_rng(15)
    words = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(160):
        body = " ".join(rng.choice(words, rng.integers(1, 60)))
        bad = int(i % 9 == 0)
        rows.append((i, body + (" scumbag" if bad else "") + (" tellingword" if i in (9, 27, 90, 99, 130) else "")))
        if i < 120:
            labels.append((i, bad))
    model, vectors = toxicity.train(docs_of(rows), spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    counted = {i: toxicity.terms(t) for i, t in rows}
    df = {}
    for c in counted.values():
        for t in c:
            df[t] = df.get(t, 0) + 1
    used = {i: y for i, y in labels if zlib.crc32(str(i).encode()) % 5}
    share = sum(used.values()) / len(used)
    ex_df = {}
    for i, y in used.items():
        for t in counted[i]:
            a, b = ex_df.get(t, (0, 0))
            ex_df[t] = (a + 1, b + y)

    def vector(i):
        out = {}
        for t, tf in counted[i].items():
            if t in ex_df:
                n, bad = ex_df[t]
                p = bad / n
                e = n * sum(x * math.log(x / y) for x, y in ((p, share), (1 - p, 1 - share)) if x > 0)
                g = toxicity.FLOOR + (1 - toxicity.FLOOR) * e / (e + toxicity.HALF)
                out[t] = (1 + math.log(tf)) * (math.log((len(rows) + 1) / (df[t] + 1)) + 1) * g
        norm = math.sqrt(sum(w * w for w in out.values()))
        return {t: w / norm for t, w in out.items()}

    every = {i: vector(i) for i in used}
    told = {int(r["doc_id"]): r for r in vectors.collect()}
    assert len(told) == len(rows)
    for i, _ in rows:
        q = vector(i)
        want = sorted((sum(w * v.get(t, 0.0) for t, w in q.items()) for v in every.values()), reverse=True)[: toxicity.NEIGHBOURS]
        near = model.votes(np.array(told[i]["ids"], np.int64), np.array(told[i]["tf"], np.int32))[1]
        assert np.allclose([s for s, _ in near], [w for w in want if w > 0], atol=1e-6), i
        if i in (9, 27, 90, 99, 130):  # a term of a few examples still finds them
            assert {9, 27, 90, 99} & used.keys() - {i} <= {model.ids[j] for _, j in near}


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(8)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.AdditiveModel(pairs=2).fit(x, y)
    assert np.mean((model.score(x) > 0.5) == y) > 0.95


# --- chats -----------------------------------------------------------------------


def test_tool_calls_link_order_and_validate(spark):
    messages = spark.createDataFrame([(1, 0, "user", "hi \"x\"\n"), (1, 1, None, None)], "conv_id bigint, turn bigint, role string, text string")
    calls = spark.createDataFrame([
        (1, 1, "a", "find", '{"n": 3, "q": "z", "after": ["b"]}'), (1, 2, "b", "find", '{ "q":"y","n":1 }'),
        (1, 3, "c", "find", '{"q": 5, "extra": {"z":1,"a":2}}'), (1, 4, "d", "find", "[1]"), (1, 4, "e", "nope", "{}"),
        (1, 5, "x", "find", '{"q":"q","n":1,"after":["y"]}'), (1, 5, "y", "find", '{"q":"q","n":1,"after":["x"]}'),
        (1, 6, "z", "find", '{"q":"q","n":9,"after":["x","gone"]}'), (1, 7, "a", "find", "{}"), (1, 8, None, "find", None), (2, 1, "a", "find", None),
    ], "conv_id bigint, turn bigint, call_id string, name string, arguments string")
    results = spark.createDataFrame([(1, 9, "a", "second"), (1, 2, "a", "first"), (1, 3, "b", None), (1, 3, "lost", "?"), (3, 1, None, "?")],
                                    "conv_id bigint, turn bigint, call_id string, content string")
    schemas = spark.createDataFrame([("find", "q", "string", True, None), ("find", "n", "integer", True, ["1", "2", "3"]), ("find", "after", "array", False, None)],
                                    "name string, param string, type string, required boolean, allowed array<string>")
    got = chat.format_chats(messages, calls, results, schemas).collect()
    assert len(got) == 2 + 11 + 5
    by = {(r["conv_id"], r["turn"], r["part"], r["call_id"]): r for r in got}
    assert by[1, 0, 0, None]["json"] == '{"content":"hi \\"x\\"\\n","role":"user","type":"message"}'
    assert by[1, 1, 0, None]["json"] == '{"content":null,"role":null,"type":"message"}'
    a, b = by[1, 1, 1, "a"], by[1, 2, 1, "b"]
    assert (a["status"], a["level"], b["status"], b["level"]) == ("ok", 1, "ok", 0)
    assert a["json"] == '{"arguments":{"after":["b"],"n":3,"q":"z"},"errors":[],"id":"a","level":1,"name":"find","type":"call"}'
    c = by[1, 3, 1, "c"]
    assert c["status"] == "invalid" and '"errors":["missing:n","type:q","undeclared:extra"]' in c["json"] and '"extra":{"a":2,"z":1}' in c["json"]
    assert '"errors":["arguments"]' in by[1, 4, 1, "d"]["json"] and '"errors":["tool"]' in by[1, 4, 1, "e"]["json"]
    assert by[1, 5, 1, "x"]["status"] == by[1, 5, 1, "y"]["status"] == by[1, 6, 1, "z"]["status"] == "cycle"
    assert '"errors":["after:gone","value:n"]' in by[1, 6, 1, "z"]["json"]
    assert by[1, 7, 1, "a"]["status"] == "repeated" and by[1, 8, 1, None]["status"] == "invalid" and by[2, 1, 1, "a"]["status"] == "invalid"
    assert (by[1, 2, 2, "a"]["status"], by[1, 9, 2, "a"]["status"], by[1, 3, 2, "lost"]["status"]) == ("ok", "repeated", "orphan")
    empty = [x.limit(0) for x in (messages, calls, results, schemas)]
    assert chat.format_chats(*empty).collect() == []
