"""Quality classifier: an additive model with pairwise interactions (operator 5).

Numeric features of the whole text are cut into quantile bins. Boosting goes
round the features in turn and fits a tree of at most four leaves to the
gradient histogram of one feature; its leaf values are added to that feature's
lookup table. Then the pairs of features that explain most of what is left get
two-dimensional tables in the same way. A score is the intercept plus one table
entry per feature and pair, added column by column.

Training reads at most ``max_train`` labelled rows (a documented bound, taken in
the order of a hash of doc_id); features and scores cover every document.

Defined cases: null and empty texts get the features of an empty text; null
labels are ignored, of several labels of one document the smallest counts; with
no labels or one class only, every score is the smoothed share of label 1.
A null doc_id is not held out and never trains. Extra columns are ignored.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, text_or_empty

FEATURES = [
    "log_chars", "log_words", "word_length", "letters", "upper", "digits", "blanks", "symbols", "distinct_words",
    "top_word", "same_as_last", "distinct_lines", "log_line", "wordless", "caps_words", "symbol_ends", "distinct_pairs",
    "top_symbol",
]

LETTER, UPPER, DIGIT, BLANK, SYMBOL = range(5)
_CLASS: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """Character class of each code point of the basic plane; the rest counts as symbols."""
    if not _CLASS:
        kind = {"Lu": UPPER, "Lt": UPPER, "Nd": DIGIT, "Nl": DIGIT, "No": DIGIT, "Zs": BLANK, "Zl": BLANK, "Zp": BLANK}
        table = np.full(0x10001, SYMBOL, np.uint8)
        for c in range(0x10000):
            ch = chr(c)
            category = unicodedata.category(ch)
            table[c] = BLANK if ch in "\t\n\r\v\f" else kind.get(category, LETTER if category[0] in "LM" else SYMBOL)
        _CLASS.append(table)
    return _CLASS[0]


def features(text: str) -> list[float]:
    """The numeric features of one whole text, in the order of ``FEATURES``."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    n = len(points)
    if not n:
        return [0.0] * len(FEATURES)
    kinds = _classes()[np.minimum(points, 0x10000)]
    count = np.bincount(kinds, minlength=5)
    letters = count[LETTER] + count[UPPER]
    symbols = points[(kinds == SYMBOL) & (points < 0x250)]
    words = text.split()
    m = len(words)
    lines = [x for x in text.split("\n") if x]
    if m:
        counts = Counter(words)
        distinct, top = len(counts) / m, max(counts.values()) / m
        pairs = len(set(zip(words, words[1:], strict=False))) / max(1, m - 1)
        same = sum(map(str.__eq__, words, words[1:])) / m
        odd = [(w, c) for w, c in counts.items() if not w.isalpha()]
        wordless = sum(c for w, c in odd if not w.isalnum() and not any(map(str.isalnum, w))) / m
        caps = sum(c for w, c in counts.items() if w.isupper() and len(w) > 1) / m
        ends = sum(c for w, c in odd if len(w) > 1 and w[-1] not in ".,;:?!)\"'" and not w[-1].isalnum()) / m
    else:
        distinct = top = pairs = same = wordless = caps = ends = 0.0
    return [
        math.log1p(n),
        math.log1p(m),
        (n - int(count[BLANK])) / max(1, m),
        letters / n,
        count[UPPER] / max(1, letters),
        count[DIGIT] / n,
        count[BLANK] / n,
        count[SYMBOL] / n,
        distinct,
        top,
        same,
        len(set(lines)) / max(1, len(lines)),
        math.log1p(n / max(1, len(lines))),
        wordless,
        caps,
        ends,
        pairs,
        (int(np.bincount(symbols).max()) if len(symbols) else 0) / n,
    ]


def feature_matrix(texts) -> np.ndarray:
    return np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))


def _leaf(g: float, h: float) -> float:
    return -g / (h + 1.0)


def _gain(g, h):
    return g * g / (h + 1.0)


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Best gain of cutting a histogram in two, and where (0: not at all)."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = _gain(gl, hl) + _gain(g.sum() - gl, h.sum() - hl) - _gain(g.sum(), h.sum())
    gain = np.where((hl < 1e-3) | (h.sum() - hl < 1e-3), 0.0, gain)
    at = int(np.argmax(gain))
    return (float(gain[at]), at + 1) if gain[at] > 1e-9 else (0.0, 0)


def _tree_1d(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values per bin of a shallow tree over ordered bins."""
    _, at = _cut(g, h) if depth else (0.0, 0)
    if not at:
        return np.full(len(g), _leaf(g.sum(), h.sum()))
    return np.concatenate([_tree_1d(g[:at], h[:at], depth - 1), _tree_1d(g[at:], h[at:], depth - 1)])


def _tree_2d(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree that cuts one axis and then the other on each side; its values and gain."""
    best, values = 0.0, np.full(g.shape, _leaf(g.sum(), h.sum()))
    whole = _gain(g.sum(), h.sum())
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        ga, ha = a.sum(1), b.sum(1)
        for at in range(1, len(ga)):
            gain, halves = -whole, []
            for part_g, part_h in ((a[:at], b[:at]), (a[at:], b[at:])):
                gs, hs = part_g.sum(0), part_h.sum(0)
                more, cut = _cut(gs, hs)
                gain += _gain(gs.sum(), hs.sum()) + more
                row = np.empty(len(gs))
                for part in (slice(0, cut), slice(cut, None)):
                    row[part] = _leaf(gs[part].sum(), hs[part].sum()) if len(gs[part]) else 0.0
                halves.append(np.tile(row, (part_g.shape[0], 1)))
            if gain > best + 1e-9 and ha[:at].sum() > 1e-3 and ha[at:].sum() > 1e-3:
                best = gain
                values = np.concatenate(halves)
                values = values.T if turned else values
    return values, best


class AdditiveModel:
    """Lookup tables per feature and per chosen pair; ``score`` only adds table entries."""

    def __init__(self, bins: int = 48, coarse: int = 8, rounds: int = 160, pair_rounds: int = 60, pairs: int = 5, rate: float = 0.12):
        self.bins, self.coarse, self.rounds, self.pair_rounds = bins, coarse, rounds, pair_rounds
        self.n_pairs, self.rate = pairs, rate
        self.edges: list[np.ndarray] = []
        self.coarse_edges: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        self.base = 0.0

    @staticmethod
    def _edges(x: np.ndarray, n: int) -> np.ndarray:
        return np.unique(np.quantile(x, np.linspace(0, 1, n + 1)[1:-1], method="lower"))

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        share = (y.sum() + 1.0) / (len(y) + 2.0)
        self.base = math.log(share / (1 - share))
        if len(np.unique(y)) < 2:
            return self
        n, d = x.shape
        self.edges = [self._edges(x[:, j], self.bins) for j in range(d)]
        self.coarse_edges = [self._edges(x[:, j], self.coarse) for j in range(d)]
        fine = [np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        logit = np.full(n, self.base)
        for _ in range(self.rounds):
            for j in range(d):
                p = 1 / (1 + np.exp(-logit))
                size = len(self.tables[j])
                step = self.rate * _tree_1d(np.bincount(fine[j], p - y, size), np.bincount(fine[j], p * (1 - p), size))
                self.tables[j] += step
                logit += step[fine[j]]
        wide = [np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.coarse_edges)]
        sizes = [len(e) + 1 for e in self.coarse_edges]

        def histogram(i: int, j: int, weights: np.ndarray) -> np.ndarray:
            return np.bincount(wide[i] * sizes[j] + wide[j], weights, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])

        p = 1 / (1 + np.exp(-logit))
        gains = []
        for i in range(d):
            for j in range(i + 1, d):
                gains.append((-_tree_2d(histogram(i, j, p - y), histogram(i, j, p * (1 - p)))[1], i, j))
        self.pairs = [(i, j, np.zeros((sizes[i], sizes[j]))) for _, i, j in sorted(gains)[: self.n_pairs]]
        for _ in range(self.pair_rounds):
            for i, j, grid in self.pairs:
                p = 1 / (1 + np.exp(-logit))
                step = self.rate * _tree_2d(histogram(i, j, p - y), histogram(i, j, p * (1 - p)))[0]
                grid += step
                logit += step[wide[i], wide[j]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row."""
        logit = np.full(len(x), self.base)
        for j, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            logit += values[np.searchsorted(edges, x[:, j], side="left")]
        for i, j, grid in self.pairs:
            a = np.searchsorted(self.coarse_edges[i], x[:, i], side="left")
            b = np.searchsorted(self.coarse_edges[j], x[:, j], side="left")
            logit += grid[a, b]
        return 1 / (1 + np.exp(-np.clip(logit, -35, 35)))


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_train: int) -> DataFrame:
    """``(text, label)`` of at most ``max_train`` labelled documents that are not held out.

    The bounded set of ids is broadcast, so the documents are neither shuffled
    nor collected.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy(F.col("doc_id").cast("bigint").alias("__id"))
        .agg(F.min(F.col(label).cast("int")).alias("__label"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(max_train)
    )
    return docs.select(F.col("doc_id").cast("bigint").alias("__id"), text_or_empty().alias("text")).join(
        F.broadcast(chosen), "__id"
    ).select("text", F.col("__label").alias("label"))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = 12_000) -> AdditiveModel:
    """Fit the model on the bounded sample; only its numeric features reach the driver."""
    prepare(docs.sparkSession)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame(feature_matrix(batch["text"]), columns=FEATURES)
            out["label"] = batch["label"].to_numpy()
            yield out

    schema = ", ".join(f"{f} double" for f in FEATURES) + ", label int"
    sample = training_rows(docs, labels, label, max_train).mapInPandas(rows, schema).toPandas()
    sample = sample.sort_values([*FEATURES, "label"], kind="stable")  # the same model whatever the partitions
    return AdditiveModel().fit(sample[FEATURES].to_numpy(float), sample["label"].to_numpy(float))


def quality_score(docs: DataFrame, model: AdditiveModel, text: str = "text") -> Column:
    """Score column over the whole text; the small model travels as a broadcast variable."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(held.value.score(feature_matrix(texts)))

    return score(text_or_empty(text))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document."""
    model = train(docs, labels, label)
    scored = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), quality_score(docs, model).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """The documents whose predicted label is 1, all columns unchanged."""
    model = train(docs, labels, label)
    return docs.where(quality_score(docs, model) >= threshold)
