import random
import hashlib
from collections import Counter

import numpy as np
import pytest

from edge_cases import EDGE
from treeloom.llm import alignment

P = pytest.importorskip("public_tokenizers")
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
CHARS = [*" \t\n.,'<>|_aébß例🌲▁ ​　᠎\x00\x1c\x85", "  ", " the", "<|endoftext|>", "<s>", "<0x41>", "word", "12", "'s", "\n ", "Latin words here", " only "]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    byte_of = {c: n for n, c in enumerate(alignment.byte_characters())}

    def bytes_a(i):
        return bytes(byte_of[c] for c in a.id_to_token(i))

    def bytes_b(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    def encode(text):
        if not text:
            return [], []
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        whole = (" " + text).encode()
        same = b"".join(map(bytes_a, x)) == whole and b"".join(map(bytes_b, y)) == whole
        return (x, y) if same else ([], [])

    return encode, bytes_a, bytes_b


def brute(texts, libraries):
    """Ends of every token by offset, groups between shared offsets, links by comparing all pairs of ends."""
    encode, bytes_a, bytes_b = libraries
    facts, links = [], []
    for text in texts:
        x, y = encode(text)
        ends_a = np.cumsum([len(bytes_a(i)) for i in x]).tolist()
        ends_b = np.cumsum([len(bytes_b(i)) for i in y]).tolist()
        common = sorted(set(ends_a) & set(ends_b))
        number = lambda ends: np.searchsorted(common, ends)  # noqa: B023, E731  the group that an end falls into
        sides = [[[] for _ in common] for _ in range(2)]
        for side, ids, ends in ((0, x, ends_a), (1, y, ends_b)):
            for i, g in zip(ids, number(ends)):
                sides[side][g].append(str(i))
        groups = [",".join(p) + "|" + ",".join(q) for p, q in zip(*sides)]
        at_a, at_b = dict(zip(ends_a, x)), dict(zip(ends_b, y))
        links.append([(at_a[e], at_b[e]) for e in common])
        facts.append((len(x), len(y), len(groups), ";".join(groups)))
    count = Counter(p for own in links for p in own)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    return [
        (*f[:3], len(own), sum(count[p] == most[p[1]] for p in own), sum(count[p] for p in own),
         hashlib.sha256(f[3].encode()).hexdigest() if f[0] else "")
        for f, own in zip(facts, links)
    ]


def odd_texts(n=300):
    rng = np.random.default_rng(13)
    return ["".join(rng.choice(CHARS, rng.integers(0, 30))) for _ in range(n)]


def test_ids_of_words_are_those_of_whole_texts(libraries):
    aligner = alignment.aligner_for(open(A, "rb").read(), open(B, "rb").read())
    assert aligner.ranked is not None
    for text in odd_texts(2000):
        x, y = libraries[0](text)
        got = aligner.align(text)
        assert got[:2] == (len(x), len(y)), repr(text)
        ids = [g.split("|") for g in got[3].split(";")] if got[3] else []
        assert [int(i) for g in ids for i in g[0].split(",")] == x
        assert [int(i) for g in ids for i in g[1].split(",")] == y


@pytest.mark.parametrize("bound", [alignment.BROADCAST_BYTES, 0])
def test_equal_to_brute_force(docs_of, libraries, bound):
    rows = [*EDGE, *[(100 + i, t) for i, t in enumerate(odd_texts())], (None, "the same"), (100, "the same")]
    got = alignment.alignment_counts(docs_of(rows), A, B, bound).collect()
    want = [(i, *f) for (i, _), f in zip(rows, brute([t for _, t in rows], libraries))]
    assert Counter(map(tuple, got)) == Counter(want)


def test_empty_table(no_docs):
    assert alignment.alignment_counts(no_docs, A, B).collect() == []
    assert alignment.alignment_counts(no_docs, A, B, 0).collect() == []


def test_windows_are_remembered_by_their_ids(libraries):
    aligner = alignment.Aligner(open(A, "rb").read(), open(B, "rb").read())
    aligner.align("one two\n one two")
    seen = dict(aligner.windows)
    assert aligner.align("two one two\n two one")[2] and aligner.windows == seen


def test_known_words_are_not_encoded_again_and_give_what_whole_texts_give():
    aligner, other = (alignment.Aligner(open(A, "rb").read(), open(B, "rb").read()) for _ in range(2))
    assert aligner.by_words
    marks = ["a", "b", " ", "  ", "\n", "\t", "é", "日本", "́", "'s", "1", ".", "<s>", "　", "​", " the", "ing ", "x" * 70, "▁"]
    rng = random.Random(13)
    texts = [None, "", *("".join(rng.choices(marks[: -(i % 3 > 0) or None], k=rng.randint(1, 40))) for i in range(600))]
    got = aligner.align_all(texts)
    assert any(g[0] for g in got) and any(t and not g[0] for t, g in zip(texts, got))
    for text, one in zip(texts, got):
        want = (text and other.whole(text)) or (0, 0, 0, "", np.zeros(0, np.int64))
        assert one[:4] == want[:4] and np.array_equal(one[4], want[4]), text
    aligner.align("one two three")
    aligner.shared = None  # nothing is encoded now
    assert aligner.align("three one two one")[0] == other.whole("three one two one")[0]


def test_every_text_is_encoded_by_both_tokenizers():
    aligner, other = (alignment.Aligner(open(A, "rb").read(), open(B, "rb").read()) for _ in range(2))
    aligner.align("one two three")
    seen, encoded, b = [[], []], aligner.encoded, aligner.b

    class Noted:
        def encode(self, text, **how):
            seen[1].append(text)
            return b.encode(text, **how)

    aligner.encoded = lambda text: (seen[0].append(text), encoded(text))[1]
    aligner.b = Noted()
    texts = ["three one two one", None, "one", " ends with blanks \n ", "a ▁ that is not given back", "one", "", "  two 日本 three" * 2000, "one two three"]
    got = aligner.align_all(texts)
    assert seen[0] == seen[1] == [t for t in texts if t]
    for text, one in zip(texts, got):
        want = (text and other.whole(text)) or (0, 0, 0, "", np.zeros(0, np.int64))
        assert one[:4] == want[:4] and np.array_equal(one[4], want[4])
    assert [g[0] > 0 for g in got] == [True, False, True, True, False, True, False, True, True]
