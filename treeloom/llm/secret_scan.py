"""Secret scans: fixed patterns plus a randomness battery (operator 2).

Every maximal token of key-like characters gets an inferred encoding (the
smallest alphabet that holds it; a token of one character class has none).
Three tests ask whether it could be uniform draws from that alphabet:
chi-squared uniformity (whole alphabet and wide bins), the Wald-Wolfowitz runs
test about the alphabet's middle, and the lag-one serial correlation. Fisher's
method combines them to one p-value, uniform for random tokens and near zero for
words, paths and names.

Two likelihood ratios of random draws to ordinary text are multiplied to an
e-value of the token alone. The battery's is ``p ** (1 - KAPPA) / KAPPA``: its
p-value is uniform for random tokens, and for ordinary text heaped up near zero
(density ``KAPPA * p ** (KAPPA - 1)``). The other is that of the characters, uniform
draws to a model of ordinary text (neighbouring characters as in the corpus's
other text, runs of one character class, repeats and counting up). So a small p
asks for more evidence and refuses nothing by itself. False discoveries are controlled per encoding and length
class by the e-value form of Benjamini-Hochberg: the ``k`` tokens of ``n`` with
the greatest ratios are accepted if each is at least ``n / (k * rate)``. Only the
share ``k / n`` counts, so repeating a corpus changes nothing, and a ratio of
``n / rate`` is accepted whatever else its class holds. The counts behind it are
bounded tables (characters x characters, and encodings x length classes x bins).

Defined cases: null text counts as empty and has no spans; positions are code
points, end exclusive; equal spans of different kinds are all reported; a span of
the battery that overlaps a fixed-pattern span is counted in ``n_random`` but not
repeated in ``spans``. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, text_or_empty, written

KINDS = ("assign", "access", "hex", "random")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# Letters of the keyword in either case, ASCII only.
ASSIGN = re.compile(
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# A run of 16 or more is a leftmost maximal match of [0-9a-f]+ that is long enough.
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}")

DIGITS, LOWER, CAPITALS = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = {
    "hex": DIGITS + LOWER[:6],
    "HEX": DIGITS + CAPITALS[:6],
    "base32": CAPITALS + "234567",
    "base36": DIGITS + LOWER,
    "BASE36": DIGITS + CAPITALS,
    "base62": DIGITS + CAPITALS + LOWER,
    "base64": CAPITALS + LOWER + DIGITS + "+/",
    "base64url": CAPITALS + LOWER + DIGITS + "-_",
}
_VALUES = {name: {c: i for i, c in enumerate(alphabet)} for name, alphabet in ENCODINGS.items()}
_SETS = {name: frozenset(alphabet) for name, alphabet in ENCODINGS.items()}
# Lower ends of the length classes.
LENGTHS = (16, 18, 20, 24, 28, 32, 40, 48, 64, 96, 128, 256)
# Exponent of the battery's p-value under ordinary text.
KAPPA = 0.5
# Characters of tokens; the place after them stands for any other one.
CHARACTERS = CAPITALS + LOWER + DIGITS + "+/_-"
_CODES = np.full(128, len(CHARACTERS), np.int64)
_CODES[[ord(c) for c in CHARACTERS]] = np.arange(len(CHARACTERS))
_CLASS = np.repeat([0, 1, 2, 3], [26, 26, 10, 4])
_CLASS_SIZE = np.array([26, 26, 10, 4])[_CLASS]
# Shares of the model of ordinary text: pairs of the corpus, same class, same or next character, character seen before, any.
PAIRS, SAME, STEP, SEEN, ANY = 0.5, 0.25, 0.1, 0.05, 0.1
# Bins of the logarithm of the likelihood ratio: from 0, this many a unit, up to a greatest value.
EVIDENCE_STEPS, MOST_EVIDENCE = 4, 80


def fixed_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the fixed patterns, in order."""
    spans = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def infer_encoding(token: str) -> str | None:
    """The smallest alphabet holding the token; none unless it mixes digits with letters."""
    used = frozenset(token)
    if used.isdisjoint(DIGITS) or not any(c.isalpha() for c in used):
        return None
    return next((name for name, alphabet in _SETS.items() if used <= alphabet), None)


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi2_tail(x: float, dof: float) -> float:
    """Upper tail of chi-squared by the cube-root normal approximation."""
    if x <= 0:
        return 1.0
    v = 2 / (9 * dof)
    return _normal_tail(((x / dof) ** (1 / 3) - (1 - v)) / math.sqrt(v))


def battery(token: str, encoding: str) -> tuple[float, float, float]:
    """p-values of uniformity, runs and serial correlation for draws from the encoding's alphabet."""
    values = _VALUES[encoding]
    x = np.fromiter((values[c] for c in token), float, len(token))
    n, size = len(x), len(values)
    counts = np.bincount(x.astype(int), minlength=size)
    # over the whole alphabet; for n draws the statistic's variance is smaller by (n-1)/n
    whole = size / n * float((counts.astype(float) ** 2).sum()) - n
    p_whole = _chi2_tail(whole * n / (n - 1), (size - 1) * n / (n - 1))
    wide = max(3, min(8, n // 5))
    edges = np.arange(size) * wide // size
    seen, expected = np.bincount(edges, counts, wide), np.bincount(edges, minlength=wide) * n / size
    p_wide = _chi2_tail(float(((seen - expected) ** 2 / expected).sum()), wide - 1)
    p_uniform = min(1.0, 2 * min(p_whole, p_wide))

    above = x >= size / 2
    a = int(above.sum())
    b = n - a
    if a and b:
        mean = 1 + 2 * a * b / n
        spread = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
        runs = 1 + int((above[1:] != above[:-1]).sum())
        p_runs = min(1.0, 2 * _normal_tail(max(0.0, abs(runs - mean) - 0.5) / spread))
    else:
        p_runs = 2.0 ** (1 - n)

    centred = x - x.mean()
    power = float((centred**2).sum())
    if power > 0:
        r = float((centred[1:] * centred[:-1]).sum()) / power
        p_serial = 2 * _normal_tail(abs(r + 1 / n) * math.sqrt(n))
    else:
        p_serial = 0.0
    return p_uniform, p_runs, min(1.0, p_serial)


def combined(p_values: tuple[float, ...]) -> float:
    """Fisher's combination of three p-values (closed form for six degrees of freedom)."""
    half = -sum(math.log(max(p, 1e-300)) for p in p_values)
    return min(1.0, math.exp(-half) * (1 + half + half * half / 2))


def length_class(n: int) -> int:
    return int(np.searchsorted(LENGTHS, n, side="right")) - 1


def pair_counts(text: str) -> np.ndarray:
    """Counts of neighbouring characters of a text outside the tokens that are tested."""
    rest = CANDIDATE.sub(lambda m: " " if infer_encoding(m.group()) else m.group(), text)
    codes = _CODES[np.minimum(np.frombuffer(rest.encode("ascii", "replace"), np.uint8), 127)]
    size = len(CHARACTERS) + 1
    return np.bincount(codes[:-1] * size + codes[1:], minlength=size * size) if len(codes) > 1 else np.zeros(size * size, np.int64)


def ordinary_text(counts: np.ndarray) -> np.ndarray:
    """Probabilities of a token's next character (column) after each one (row; the last row is a token's start)."""
    n = len(CHARACTERS)
    inside = counts.reshape(n + 1, n + 1)[:, :n].astype(float)
    total = inside.sum(axis=1, keepdims=True)
    pairs = np.where(total > 0, inside / np.maximum(total, 1), 1 / n)
    out = PAIRS * pairs + ANY / n
    out[:n] += SAME * (_CLASS[:, None] == _CLASS[None, :]) / _CLASS_SIZE
    step = np.zeros((n, n))
    step[np.arange(n), np.arange(n)] += 0.5
    step[np.arange(n), (np.arange(n) + 1) % n] += 0.5
    out[:n] += STEP * step
    return out


def evidence(token: str, encoding: str, model: np.ndarray) -> float:
    """Logarithm of the likelihood ratio of uniform draws from the encoding's alphabet to ordinary text."""
    codes = _CODES[np.frombuffer(token.encode("ascii"), np.uint8)]
    n = len(codes)
    before = np.concatenate(([len(CHARACTERS)], codes[:-1]))
    # how often each character stands before its place: its rank among the equal ones
    order = np.argsort(codes, kind="stable")
    first = np.searchsorted(codes[order], codes[order])
    seen = np.empty(n)
    seen[order] = np.arange(n) - first
    likely = model[before, codes] + SEEN * seen / np.maximum(np.arange(n), 1)
    return float(-n * math.log(len(ENCODINGS[encoding])) - np.log(likely).sum())


def battery_evidence(p: float) -> float:
    """Logarithm of the battery's likelihood ratio of random draws to ordinary text."""
    return (1 - KAPPA) * math.log(max(p, 1e-300)) - math.log(KAPPA)


def candidates(text: str, model: np.ndarray) -> list[tuple[int, int, str, float]]:
    """``(start, end, encoding and length class, evidence)`` of every token with an inferred encoding."""
    out = []
    for m in CANDIDATE.finditer(text):
        token = m.group()
        encoding = infer_encoding(token)
        if encoding:
            cell = f"{encoding}/{length_class(len(token))}"
            both = battery_evidence(combined(battery(token, encoding))) + evidence(token, encoding, model)
            out.append((m.start(), m.end(), cell, both))
    return out


def cutoffs(histogram: dict[str, np.ndarray], rate: float) -> dict[str, float]:
    """Least evidence to accept in each cell.

    ``histogram`` has a cell's tokens by bins of evidence; its last place counts
    those that speak for ordinary text (evidence below 0).
    """
    out = {}
    for cell, counts in histogram.items():
        accepted = np.cumsum(counts[:-1][::-1])[::-1].astype(float)
        edges = np.arange(len(accepted)) / EVIDENCE_STEPS
        good = np.flatnonzero((accepted > 0) & (np.log(np.maximum(accepted, 1) * rate / counts.sum()) + edges >= 0))
        if len(good):
            out[cell] = float(edges[good[0]])
    return out


def apart(tokens: list[tuple], fixed: list[tuple]) -> list[tuple]:
    """The tokens that no fixed span overlaps; both ascend by start, tokens do not overlap each other."""
    out, at, reach = [], 0, -1
    for start, kind, end in tokens:
        while at < len(fixed) and fixed[at][0] < end:
            reach = max(reach, fixed[at][2])
            at += 1
        if reach <= start:
            out.append((start, kind, end))
    return out


def scan(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random)`` of every document.

    Texts are read twice: for the counts of neighbouring characters, and for what
    they yield (spans and candidates), which is written and reread, first for the
    corpus counts and then for the decisions.
    """
    spark = prepare(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_or_empty().alias("text"))
    size = (len(CHARACTERS) + 1) ** 2

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for t in batch["text"]:
                total += pair_counts(t)
        there = np.flatnonzero(total)
        yield pd.DataFrame({"pair": there, "n": total[there]})

    pairs = np.zeros(size, np.int64)
    # at most characters x characters rows
    for row in narrow.select("text").mapInPandas(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        pairs[row["pair"]] = row["n"]
    ordinary = spark.sparkContext.broadcast(ordinary_text(pairs))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fixed = [fixed_spans(t) for t in batch["text"]]
            tokens = [candidates(t, ordinary.value) for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "start": [[s for s, _, _ in f] for f in fixed],
                    "kind": [[k for _, k, _ in f] for f in fixed],
                    "end": [[e for _, _, e in f] for f in fixed],
                    "token_start": [[c[0] for c in t] for t in tokens],
                    "token_end": [[c[1] for c in t] for t in tokens],
                    "cell": [[c[2] for c in t] for t in tokens],
                    "evidence": [[c[3] for c in t] for t in tokens],
                }
            )

    schema = (
        "doc_id string, start array<bigint>, kind array<bigint>, end array<bigint>, "
        "token_start array<bigint>, token_end array<bigint>, cell array<string>, evidence array<double>"
    )
    found = written(narrow.mapInPandas(find, schema), "secret_spans")

    bins = EVIDENCE_STEPS * MOST_EVIDENCE + 1
    place = F.least(F.floor(F.col("t.evidence") * EVIDENCE_STEPS), F.lit(bins - 1))
    refuted = F.col("t.evidence") < 0
    counts = (
        found.select(F.explode(F.arrays_zip("cell", "evidence")).alias("t"))
        .groupBy(F.col("t.cell").alias("cell"), F.when(refuted, bins).otherwise(place).alias("bin"))
        .count()
        .collect()  # at most encodings x length classes x bins rows
    )
    histogram: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(bins + 1, np.int64))
    for row in counts:
        histogram[row["cell"]][row["bin"]] += row["count"]
    least = spark.sparkContext.broadcast(cutoffs(dict(histogram), rate))

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        accept = least.value
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                fixed = list(zip(r.start, r.kind, r.end, strict=True))
                random = [
                    (s, 3, e)
                    for s, e, c, v in zip(r.token_start, r.token_end, r.cell, r.evidence, strict=True)
                    if c in accept and v >= accept[c]
                ]
                fresh = apart(random, fixed)
                base = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in fixed)
                every = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(fixed + fresh))
                kinds = [k for _, k, _ in fixed]
                rows.append(
                    (
                        None if r.doc_id is None else int(r.doc_id), kinds.count(0), kinds.count(1), kinds.count(2),
                        hashlib.sha256(base.encode()).hexdigest(), every, len(random),
                    )
                )
            yield pd.DataFrame(
                rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"]
            )

    return found.mapInPandas(
        decide,
        "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_random bigint",
    )
