"""Toxicity by the nearest labelled examples (operator 8).

Terms are lower-cased words and five-letter word beginnings, known by a 64-bit
hash. The vocabulary is every term of a bounded sample of labelled documents;
document frequencies, and so the inverse ones, come from all documents. A term's
weight also rises smoothly with what the sample's labels say about it: with the
nats of evidence ``e`` that its share of label 1 differs from the whole share, it
is multiplied by ``FLOOR + (1 - FLOOR) * e / (e + HALF)``, so no term is left out.

A search adds up all postings of a document's terms in single precision: those of
common terms as a matrix product for many documents at once, the others by an
inverted index. Examples that come within the rounding error of the k-th best get
their cosines in double precision: the k nearest examples are exact. Their votes,
weighted by cosine and by how many labelled documents an example stands for, are
calibrated on leave-one-out votes of the examples (monotone regression). The
nearest examples are the evidence.

Documents are read once: their known terms are written, counted for the
frequencies, and searched from there.

Documented bounds: ``MAX_TOXIC`` and ``MAX_CLEAN`` examples (in the order of a
hash of doc_id). The index is bounded by their texts, and broadcast. Every document
is scored over its whole text.

Defined cases: null and empty texts have no terms and get the score of documents
without terms, as has any document without a known term; null labels are
ignored, of several labels of a document the greatest counts; without labels of
both classes the score is the smoothed share of label 1. Of equally near examples
those of smaller number count. Of several rows of one doc_id the least text is the
example. A null doc_id is neither held out nor an example. Extra columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Collection, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, text_or_empty, written
from .quality import held_out

MAX_TOXIC, MAX_CLEAN = 3000, 3000
# Of a term's weight, the part that labels don't change, and the nats of evidence that give half of the rest.
FLOOR, HALF = 0.02, 8.0
PREFIX = 5
# Documents searched together.
BLOCK = 256
# Terms that at least one in so many examples has are common; of them, the most that lie in a matrix.
COMMON, DENSE = 15, 2048
# Texts whose new words are looked up together.
TOGETHER = 64
# Words whose numbers a worker remembers.
REMEMBERED = 300_000
NEIGHBOURS = 15
PRIOR = 0.5

WORD = re.compile(r"\w+")
# What is no part of a word becomes a space.
ASCII_MARKS = {i: " " for i in range(128) if not WORD.match(chr(i))}
# Texts with more kinds of marks than these are cut by the pattern.
MARKS = 48


def words_of(text: str) -> list[str]:
    """What ``WORD`` finds in the lower-cased text, in its order."""
    text = text.lower()
    if text.isascii():
        return text.translate(ASCII_MARKS).split()
    marks = [c for c in set(text) if not (c.isalnum() or c == "_")]
    if len(marks) > MARKS:
        return WORD.findall(text)
    for c in marks:
        text = text.replace(c, " ")
    return text.split()


def terms(text: str) -> Counter:
    """Counts of words and word beginnings (marked by a leading ``^``) of a whole text."""
    words = Counter(words_of(text))
    out = Counter(words)
    for w, c in words.items():
        if len(w) > PREFIX:
            out["^" + w[:PREFIX]] += c
    return out


def hashed(counts: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Terms' hashes (as signed 64-bit integers) and their counts."""
    return hashed_terms(counts), np.fromiter(counts.values(), np.int32, len(counts))


def hashed_terms(found: Collection[str]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found)).view(np.int64)


def _ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, one range after the other, and the ranges' lengths."""
    sizes = ends - starts
    skipped = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) + np.repeat(starts - skipped, sizes), sizes


class ExactIndex:
    """Exact top-k cosine search over unit vectors given as postings (term, example, weight), ``block`` queries at a time."""

    def __init__(self, term: np.ndarray, example: np.ndarray, weight: np.ndarray, n_terms: int, n: int, block: int = BLOCK):
        order = np.lexsort((example, term))
        self.n, self.block = n, block
        self.docs, self.weights = example[order].astype(np.int32, copy=False), weight[order].astype(np.float32, copy=False)
        self.starts = np.searchsorted(term[order], np.arange(n_terms + 1, dtype=term.dtype))
        self._made = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_made": None}

    def _tables(self) -> tuple:
        """Made once in each worker: the common terms' columns and weights, and all postings by example."""
        if self._made is None:
            held = np.diff(self.starts)
            common = np.argsort(-held, kind="stable")[:DENSE]
            common = common[held[common] >= max(1, self.n // COMMON)]
            column = np.full(len(held), -1, np.int32)
            column[common] = np.arange(len(common))
            dense = np.zeros((len(common), self.n), np.float32)
            at, sizes = _ranges(self.starts[common], self.starts[common + 1])
            dense[np.repeat(np.arange(len(common)), sizes), self.docs[at]] = self.weights[at]
            order = np.argsort(self.docs, kind="stable")
            own = np.searchsorted(self.docs[order], np.arange(self.n + 1))
            terms = np.repeat(np.arange(len(held), dtype=np.int32), held)[order]
            both = np.stack([self.docs, self.weights.view(np.int32)], axis=1).view(np.int64).ravel()  # in one array, cut once
            self._made = column, dense, own, terms, self.weights[order], np.full(len(held), -1, np.int32), both
        return self._made

    def search(self, ids: np.ndarray, query: np.ndarray, k: int, without: int = -1) -> list[tuple[float, int]]:
        """The k greatest cosines above zero, descending, ties to the smaller number; ``without`` leaves one example out."""
        return self.search_all([(ids, query)], k, [without])[0]

    def search_all(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """``search`` of each query."""
        without = without or [-1] * len(queries)
        return [
            found for at in range(0, len(queries), self.block)
            for found in self._search_block(queries[at : at + self.block], k, without[at : at + self.block])
        ]

    def _search_block(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int]) -> list[list[tuple[float, int]]]:
        column, dense, *_, both = self._tables()
        product = np.zeros((len(queries), len(dense)), np.float32)
        rest = []
        for row, (ids, query) in zip(product, queries):
            at = column.take(ids)
            common, rare = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
            row[at.take(common)] = query.take(common)
            rest.append((ids.take(rare), query.take(rare)))
        nearly = product @ dense
        out = []
        for row, (ids, query), (rare, shares), left_out in zip(nearly, queries, rest, without):
            if len(rare):
                at, sizes = _ranges(self.starts.take(rare), self.starts.take(rare + 1))
                met = both.take(at).view(np.int32)
                row += np.bincount(met[::2], np.repeat(shares, sizes) * met.view(np.float32)[1::2], self.n)
            if left_out >= 0:
                row[left_out] = 0.0
            least = 0.0
            if k < self.n:
                # sums in single precision are off by less than half of this, as all products add up to 1 at most
                least = np.partition(row, self.n - k)[self.n - k] - (len(ids) + 8) * 2.0**-22
            near = np.flatnonzero((row > 0) & (row >= least))
            scores = self._cosines(ids, query, near)
            best = np.lexsort((near, -scores))[:k]
            out.append([(float(scores[i]), int(near[i])) for i in best])
        return out

    def _cosines(self, ids: np.ndarray, query: np.ndarray, examples: np.ndarray) -> np.ndarray:
        """Cosines with ``examples`` in double precision, added up in the query's order."""
        _, _, own, terms, weights, place, _ = self._tables()
        if not len(examples):
            return np.zeros(0)
        spans = [*zip(own[examples].tolist(), own[examples + 1].tolist())]
        place[ids] = np.arange(len(ids))
        places = place.take(np.concatenate([terms[a:b] for a, b in spans]))
        place[ids] = -1
        shared = np.flatnonzero(places >= 0)
        # numbers of two bytes are sorted by radix
        shared = shared.take(np.argsort(places.take(shared).astype(np.min_scalar_type(len(ids))), kind="stable"))
        which = np.repeat(np.arange(len(examples)), [b - a for a, b in spans])
        held = np.concatenate([weights[a:b] for a, b in spans])
        return np.bincount(which.take(shared), query.take(places.take(shared)) * held.take(shared), len(examples))


BlockMaxIndex = ExactIndex  # the name it had


class NearestExamples:
    """Vocabulary, index, votes and calibration; bounded by the sample, so it is broadcast."""

    def __init__(self, vocabulary: np.ndarray, base: float):
        self.vocabulary, self.base = vocabulary, base
        self.factor = np.zeros(len(vocabulary))
        self.index: BlockMaxIndex | None = None
        self.labels = self.stands_for = np.zeros(0)
        self.ids: list[int] = []
        self.steps = (np.array([base]), np.array([base]))
        self.numbers: dict[str, int] = {}
        self._first: np.ndarray | None = None

    def numbered(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """``known`` of the hashes of a text's terms."""
        return self.numbered_all([text])[0]

    def numbered_all(self, texts: Collection[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """``numbered`` of each text; a word met before needs no hash, nor does its beginning, and new ones are looked up together."""
        counted = [Counter(words_of(t)) for t in texts]
        pairs = [[*map(self.numbers.get, words)] for words in counted]
        new = [*{w: None for words, told in zip(counted, pairs) if None in told for w, n in zip(words, told) if n is None}]
        if new:
            begun = [i for i, w in enumerate(new) if len(w) > PREFIX]
            keys = hashed_terms(new + ["^" + new[i][:PREFIX] for i in begun])
            order = np.argsort(keys)  # looked up in ascending order
            at, where = self.known(keys[order], order)
            both = np.full(len(keys), -1, np.int64)
            both[where] = at
            starts = np.full(len(new), -1, np.int64)
            starts[begun] = both[len(new) :]
            told = dict(zip(new, (both[: len(new)] << 32 | starts + 1).tolist()))
            pairs = [[told[w] if n is None else n for w, n in zip(words, was)] if None in was else was for words, was in zip(counted, pairs)]
            if len(self.numbers) + len(new) > REMEMBERED:
                self.numbers.clear()
            self.numbers.update(told)
        return [self._counted(np.array(told, np.int64), words) for told, words in zip(pairs, counted)]

    def _counted(self, numbers: np.ndarray, words: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Known words, then known beginnings, each in the order in which they come first."""
        counts = np.fromiter(words.values(), np.int32, len(words))
        ids, begun = numbers >> 32, (numbers & 0xFFFFFFFF) - 1
        there, with_start = np.flatnonzero(ids >= 0), np.flatnonzero(begun >= 0)
        begun = begun.take(with_start)
        if self._first is None:
            self._first = np.zeros(len(self.vocabulary), np.int32)
        self._first[begun[::-1]] = np.arange(len(begun) - 1, -1, -1)  # of equal ones, the last assigned stays
        first = self._first.take(begun) if len(begun) else begun
        sums = np.bincount(first, counts.take(with_start), len(begun)).astype(np.int32)
        own = np.flatnonzero(first == np.arange(len(begun)))
        return np.concatenate([ids.take(there), begun.take(own)]), np.concatenate([counts.take(there), sums.take(own)])

    def known(self, keys: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and counts of the terms that the vocabulary has."""
        if not len(self.vocabulary):
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        at = np.minimum(np.searchsorted(self.vocabulary, keys), len(self.vocabulary) - 1)
        there = self.vocabulary[at] == keys
        return at[there], tf[there]

    def vector(self, ids: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """Unit TF-IDF vector (logarithmic term frequency)."""
        weights = (1 + np.log(tf)) * self.factor[ids]
        return weights / np.sqrt((weights * weights).sum()) if len(weights) else weights

    def add_examples(self, rows: list[tuple[np.ndarray, np.ndarray]], labels, ids, stands_for, frequency: np.ndarray) -> None:
        """Examples of one label that share their weightiest term lie next to each other.

        A term that no other document has can't add to any cosine: it counts in its
        example's length and needs no posting.
        """
        top, met = [], []
        for row in rows:
            v, elsewhere = self.vector(*row), frequency[row[0]] > 1
            top.append(int(row[0][np.argmax(v)]) if len(v) else -1)
            met.append((row[0][elsewhere].astype(np.int32), v[elsewhere].astype(np.float32)))
        order = sorted((i for i in range(len(rows)) if len(rows[i][0])), key=lambda i: (labels[i], top[i], ids[i]))
        term = np.concatenate([np.zeros(0, np.int32), *(met[i][0] for i in order)])
        weight = np.concatenate([np.zeros(0, np.float32), *(met[i][1] for i in order)])
        example = np.repeat(np.arange(len(order), dtype=np.int32), [len(met[i][0]) for i in order])
        del met
        self.index = ExactIndex(term, example, weight, len(self.vocabulary), len(order))
        self.labels = np.array([labels[i] for i in order], float)
        self.stands_for = np.array([stands_for[i] for i in order], float)
        self.ids = [int(ids[i]) for i in order]

    def votes(self, ids: np.ndarray, tf: np.ndarray, without: int = -1) -> tuple[float, list[tuple[float, int]]]:
        return self.votes_all([(ids, tf)], [without])[0]

    def votes_all(
        self, rows: list[tuple[np.ndarray, np.ndarray]], without: list[int] | None = None
    ) -> list[tuple[float, list[tuple[float, int]]]]:
        """The share of label 1 among each row's nearest examples, and these."""
        found: list[list[tuple[float, int]]] = [[] for _ in rows]
        if self.index and self.index.n:
            some = [i for i, (ids, _) in enumerate(rows) if len(ids)]
            queries = [(rows[i][0], self.vector(*rows[i])) for i in some]
            left_out = [without[i] for i in some] if without else None
            for i, near in zip(some, self.index.search_all(queries, NEIGHBOURS, left_out)):
                found[i] = near
        out = []
        for near in found:
            weight = sum(s * self.stands_for[i] for s, i in near)
            toxic = sum(s * self.stands_for[i] * self.labels[i] for s, i in near)
            out.append(((toxic + PRIOR * self.base) / (weight + PRIOR), near))
        return out

    def calibrate(self, raw: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> None:
        """Monotone (pool-adjacent-violators) regression of the labels on the raw votes."""
        order = np.argsort(raw, kind="stable")
        pools: list[list[float]] = []  # weight, weight of label 1, sum of raw by weight
        for r, y, w in zip(raw[order], labels[order], weights[order], strict=True):
            pools.append([w, w * y, w * r])
            while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
        x = np.array([p[2] / p[0] for p in pools])
        y = np.array([(p[1] + self.base) / (p[0] + 1) for p in pools])
        self.steps = (x, np.maximum.accumulate(y))

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, list[tuple[float, int]]]]:
        return [(float(np.interp(raw, *self.steps)), near) for raw, near in self.votes_all(rows)]


def _sample(docs: DataFrame, labels: DataFrame, label: str) -> tuple[DataFrame, dict[int, int]]:
    """Bounded examples ``(doc_id, label, text)`` that are not held out, and the number of labels by class."""
    one = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.max(F.col(label).cast("int")).alias("label"))
    )
    total = {r["label"]: r["count"] for r in one.groupBy("label").count().collect()}
    by_hash = lambda y, n: one.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = by_hash(1, MAX_TOXIC).unionByName(by_hash(0, MAX_CLEAN))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id")  # MAX_TOXIC + MAX_CLEAN rows
    return found.groupBy("doc_id").agg(F.max("label").alias("label"), F.min("text").alias("text")), total


def evidence(df: np.ndarray, toxic: np.ndarray, share: float) -> np.ndarray:
    """Nats by which each term's share of label 1 in the sample differs from ``share``."""
    own = toxic / df
    part = lambda p, q: np.where(p > 0, p * np.log(np.maximum(p, 1e-300) / q), 0.0)
    return df * (part(own, share) + part(1 - own, 1 - share))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> tuple[NearestExamples, DataFrame]:
    """The model, and ``(doc_id, held_out, ids, tf)``: the written known terms of every document."""
    spark = prepare(docs.sparkSession)
    sample, total = _sample(docs, labels, label)
    base = (total.get(1, 0) + 1) / (sum(total.values()) + 2)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [hashed(terms(t)) for t in batch["text"]]
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"], "label": batch["label"], "key": [k for k, _ in found], "tf": [c for _, c in found]}
            )

    examples = written(sample.mapInPandas(count, "doc_id bigint, label int, key array<bigint>, tf array<int>"), "toxicity_examples")
    sizes = {r["label"]: r["count"] for r in examples.groupBy("label").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    told = (
        examples.select("label", F.explode("key").alias("key")).groupBy("key")
        .agg(F.count(F.lit(1)).alias("df"), F.sum("label").alias("toxic")).orderBy("key").toArrow()
    )
    keys, df, toxic = (told.column(c).to_numpy() for c in ("key", "df", "toxic"))
    model = NearestExamples(keys if n1 and n0 else keys[:0], base)
    words = spark.sparkContext.broadcast(model)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column("text").to_pylist()
                found = [x for i in range(0, len(texts), TOGETHER) for x in words.value.numbered_all(texts[i : i + TOGETHER])]
                ends = pa.array(np.cumsum([0, *(len(i) for i, _ in found)]), pa.int32())
                lists = (pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x).astype(np.int32))) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), *lists], ["doc_id", "held_out", "ids", "tf"])

    rows = docs.select(
        F.col("doc_id").cast("bigint").cast("string").alias("doc_id"), held_out().alias("held_out"), text_or_empty().alias("text")
    )
    vectors = written(rows.mapInArrow(encode, "doc_id string, held_out boolean, ids array<int>, tf array<int>"), "toxicity_terms")
    if not n1 or not n0:
        return model, vectors
    # a row for each term of the vocabulary at most
    seen = vectors.select(F.explode("ids").alias("id")).groupBy("id").count().toArrow()
    frequency = np.zeros(len(keys), np.int64)
    frequency[seen.column("id").to_numpy()] = seen.column("count").to_numpy()
    factor = evidence(df.astype(float), toxic.astype(float), n1 / (n1 + n0))
    model.factor = (np.log((vectors.count() + 1) / (frequency + 1)) + 1) * (FLOOR + (1 - FLOOR) * factor / (factor + HALF))
    held = examples.orderBy("doc_id").toArrow()
    y, ids = held.column("label").to_numpy(), held.column("doc_id").to_pylist()
    known = []
    for k, c in zip(held.column("key"), held.column("tf")):
        at, tf = model.known(k.values.to_numpy(), c.values.to_numpy())
        known.append((at.astype(np.int32), tf))
    del held
    stands = np.where(y == 1, total.get(1, 0) / n1, total.get(0, 0) / n0)
    model.add_examples(known, y.tolist(), ids, stands.tolist(), frequency)
    place = {doc: i for i, doc in enumerate(model.ids)}
    told = spark.sparkContext.broadcast((model, place))

    def leave_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nearest, place = told.value
        for batch in batches:
            found = [nearest.known(k, c) for k, c in zip(batch["key"], batch["tf"])]
            votes = [v for v, _ in nearest.votes_all(found, [place.get(doc, -1) for doc in batch["doc_id"]])]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "raw": votes})

    spread = examples.select("doc_id", "key", "tf").repartition(spark.sparkContext.defaultParallelism, "doc_id")
    raw = dict(map(tuple, spread.mapInPandas(leave_out, "doc_id bigint, raw double").collect()))  # a row for each example
    told.unpersist()
    model.calibrate(np.array([raw[i] for i in ids]), y.astype(float), stands)
    return model, vectors


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.5) -> DataFrame:
    """``(doc_id, held_out, score, predicted, evidence)`` of every document.

    ``evidence`` names the five nearest examples as ``doc_id:cosine``.
    """
    model, vectors = train(docs, labels, label)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nearest = held.value
        for batch in batches:
            found = nearest.scores([*zip(batch["ids"], batch["tf"])])
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": [s for s, _ in found],
                    "predicted": [int(s >= threshold) for s, _ in found],
                    "evidence": [",".join(f"{nearest.ids[i]}:{s:.4f}" for s, i in near[:5]) for _, near in found],
                }
            )

    out = vectors.mapInPandas(run, "doc_id string, held_out boolean, score double, predicted int, evidence string")
    return out.withColumn("doc_id", F.col("doc_id").cast("bigint"))
