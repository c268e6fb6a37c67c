"""Approximate nearest neighbours over balanced posting lists (operator 12).

Largest inner product becomes smallest distance: with all vectors divided by the
largest norm, each gets one more component that makes it a unit vector, and a
query gets a zero there.

* Lists: centroids of a bounded sample (``SAMPLE`` rows of least hash) that is
  halved again and again at the median along the line between two means, so all
  cells hold equally many sample rows. One list for every ``LIST_ROWS`` rows, at
  most ``MAX_LISTS``.
* Centroid search: a graph of each centroid's nearest ones and a few far ones,
  searched best first in memory (broadcast, bounded by ``MAX_LISTS``).
* Rows: every row is in its nearest list, and boundary rows also in lists that
  are at most ``BOUNDARY`` times as far, in ``REPLICAS`` lists at most.
* Queries: the lists at most ``ratio`` times as far as the nearest one. The ratio
  is the least one with which ``TARGET`` of the exact neighbours of up to
  ``CALIBRATION`` queries (found by brute force over all rows) are reached. Lists
  are added until they are home to more than ``k`` rows.
* Search: lists are packed on shelves of about ``SHELF_ROWS`` rows, larger ones
  split over several; a shelf meets the queries that visit it in blocks of
  ``QUERY_BLOCK``. Each block leaves at most k rows a query, map tasks rank these
  before they are dealt by query.

Scores are inner products of the original vectors in double precision, summed
alike for every pair, so equal vectors tie exactly.

Defined cases: vectors that are null, zero, of another length than most, or hold a
null or non-finite component take no part. A row without vec_id is a candidate
(last among ties), never a query. A vec_id on several rows is one query, with its
least vector; these rows are no candidates of it; as candidates of others they
count separately unless their scores are equal. Extra columns are ignored; an
empty table, or one row alone, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import checked_broadcast
from .common import partitions, prepare, written

SAMPLE = 32_768
LIST_ROWS = 256
MAX_LISTS = 4096
REPLICAS = 4
BOUNDARY = 1.02
NEIGHBOURS = 16
FAR_LINKS = 4
CALIBRATION = 200
TARGET = 0.98
SHELF_ROWS = 8192
QUERY_BLOCK = 4096
# Queries scored against a list at once.
SCORED_TOGETHER = 256
SEED = 12

RESULT_SCHEMA = "query_id bigint, vec_id bigint, score double"


class Centroids:
    """Unit centroids of the lists and the graph that searches them."""

    def __init__(self, points: np.ndarray):
        self.points = points.astype(np.float32)
        count = len(points)
        rng = np.random.default_rng(SEED)
        near = np.empty((count, min(NEIGHBOURS, max(count - 1, 1))), np.int32)
        for at in range(0, count, 512):
            far = self.distances(self.points[at : at + 512], np.arange(count))
            far[np.arange(len(far)), np.arange(at, at + len(far))] = np.inf
            near[at : at + 512] = np.argsort(far, axis=1, kind="stable")[:, : near.shape[1]]
        links = rng.integers(0, count, (count, FAR_LINKS)).astype(np.int32)
        chain = ((np.arange(count) + 1) % count).astype(np.int32)[:, None]  # every centroid can be reached
        self.links = np.concatenate([near, links, chain], axis=1)
        self.entries = np.unique(np.linspace(0, count - 1, min(count, 8)).astype(np.int32))

    def distances(self, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Distances of unit vectors to the centroids ``ids``, the same for all rows or one set for each."""
        c = self.points[ids]
        inner = x @ c.T if c.ndim == 2 else np.einsum("md,mcd->mc", x, c)
        square = (c * c).sum(-1)
        return np.sqrt(np.maximum(1.0 + square - 2.0 * inner, 1e-12))

    def search(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest centroids found for each row of ``x`` and their distances, nearest first."""
        rows, width = np.arange(len(x)), min(width, len(self.points))
        seen = np.zeros((len(x), len(self.points)), bool)
        seen[:, self.entries] = True
        ids = np.repeat(self.entries[None], len(x), 0)
        far = self.distances(x, self.entries)
        open_ = np.ones(ids.shape, bool)
        while True:
            best = np.argmin(np.where(open_, far, np.inf), axis=1)
            active = open_[rows, best]
            if not active.any():
                return ids, far
            who = rows[active]
            open_[who, best[who]] = False
            found = self.links[ids[who, best[who]]]
            fresh = np.full((len(x), found.shape[1]), -1, np.int32)
            for c in range(found.shape[1]):  # a link may stand twice in a row
                new = ~seen[who, found[:, c]]
                seen[who[new], found[new, c]] = True
                fresh[who[new], c] = found[new, c]
            gone = fresh < 0
            step = self.distances(x, np.maximum(fresh, 0))
            step[gone] = np.inf
            ids, far = np.concatenate([ids, fresh], 1), np.concatenate([far, step], 1)
            open_ = np.concatenate([open_, ~gone], 1)
            order = np.argsort(far, axis=1, kind="stable")[:, :width]
            ids, far, open_ = (np.take_along_axis(v, order, 1) for v in (ids, far, open_))

    def lists_of(self, x: np.ndarray) -> list[np.ndarray]:
        """Lists of each row: its nearest one, then boundary replicas."""
        ids, far = self.search(x, 4 * REPLICAS)
        out = []
        for own, d in zip(ids, far):
            taken = [own[0]]
            for c, away in zip(own[1:], d[1:]):
                if len(taken) == REPLICAS or c < 0 or away > BOUNDARY * d[0]:
                    break
                taken.append(c)
            out.append(np.array(taken, np.int32))
        return out

    def within(self, x: np.ndarray, ratio: float, homes: np.ndarray, least: int) -> list[np.ndarray]:
        """Lists at most ``ratio`` times as far as the nearest, and on until they are home to ``least`` rows."""
        width, count = 32, len(self.points)
        while True:
            ids, far = self.search(x, width)
            held = np.cumsum(homes[ids], axis=1)
            before = np.concatenate([np.zeros((len(x), 1), held.dtype), held[:, :-1]], 1)
            chosen = (far <= ratio * far[:, :1]) | (before < least)
            if width >= count or not chosen[:, -1].any():
                return [own[pick] for own, pick in zip(ids, chosen)]
            width *= 2


def balanced_centroids(sample: np.ndarray, cells: int) -> np.ndarray:
    """Means of equally large cells: the sample halved at the median along the line between two means."""
    rng, out, open_ = np.random.default_rng(SEED), [], [(np.arange(len(sample)), cells)]
    while open_:
        members, share = open_.pop()
        x = sample[members]
        if share <= 1 or len(members) < 2:
            out.append(x.mean(0))
            continue
        a, b = x[rng.choice(len(x), 2, replace=False)]
        low = share // 2
        cut = len(x) * low // share
        for _ in range(6):
            order = np.argsort(x @ (b - a), kind="stable")
            a, b = x[order[:cut]].mean(0) if cut else a, x[order[cut:]].mean(0)
        order = np.argsort(x @ (b - a), kind="stable")
        # the left half is worked on first, so that neighbouring cells have neighbouring numbers
        open_ += [(members[order[cut:]], share - low), (members[order[:cut]], low)] if cut else [(members, share - low)]
    return np.unique(np.array(out), axis=0) if len(out) > 1 and not _distinct(out) else np.array(out)


def _distinct(points: list[np.ndarray]) -> bool:
    return len({p.tobytes() for p in points}) == len(points)


def lifted(x: np.ndarray, largest: float) -> np.ndarray:
    """Rows as unit vectors with one more component, in proportion to the largest norm."""
    x = x / largest
    return np.concatenate([x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(1)))[:, None]], 1).astype(np.float32)


def aimed(q: np.ndarray) -> np.ndarray:
    """Queries as unit vectors without anything in the added component."""
    return np.concatenate([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros((len(q), 1))], 1).astype(np.float32)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """``(vec_id, embedding)`` of the vectors that take part, and their length (0 without any)."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").where(
        finite & F.exists("embedding", lambda x: x != 0)
    )
    sizes = rows.groupBy(F.size("embedding").alias("width")).count()
    top = sizes.orderBy(F.col("count").desc(), F.col("width").desc()).first()
    width = top["width"] if top else 0
    return rows.where(F.size("embedding") == width), width


def _norm() -> Column:
    double = F.col("embedding").cast("array<double>")
    return F.sqrt(F.aggregate(double, F.lit(0.0), lambda s, x: s + x * x))


def _best(rows: DataFrame, k: int) -> DataFrame:
    """The k first of each query; equal (score, vec_id) count once. Ranked in the map tasks first."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    ranked = rows.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k)
    return ranked.dropDuplicates(["query_id", "rank"]).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def top_pairs(
    ids: np.ndarray, known: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """Indices (query, row) of each query's k best rows, ties to the smaller id; never rows of its own id.

    Rows must ascend by id, those without one (``known`` false) last. Equal vectors
    are multiplied once, so they tie whatever order the product sums in.
    """
    distinct, which = np.unique(x, axis=0, return_inverse=True)
    which = which.reshape(-1)
    found_q, found_x = [], []
    for at in range(0, len(q), SCORED_TOGETHER):
        scores = (q[at : at + SCORED_TOGETHER] @ distinct.T)[:, which]
        own = query_ids[at : at + SCORED_TOGETHER]
        scores[(own[:, None] == ids[None]) & known[None]] = -np.inf
        if len(ids) > k:
            edge = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
            above, tied = scores > edge, scores == edge
            chosen = above | (tied & (np.cumsum(tied, 1) <= k - above.sum(1, keepdims=True)))
        else:
            chosen = np.ones(scores.shape, bool)
        i, j = np.nonzero(chosen & (scores > -np.inf))
        found_q.append(i + at)
        found_x.append(j)
    return np.concatenate(found_q or [np.zeros(0, int)]), np.concatenate(found_x or [np.zeros(0, int)])


def _by_id(ids: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by id with missing ones last; the ids and which are known, in that order."""
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    values = ids.fill_null(0).to_numpy(zero_copy_only=False)
    order = np.lexsort((values, ~known))
    return order, values[order], known[order]


def _scored(ids, known, x, query_ids, q, i, j) -> pa.RecordBatch:
    """Pairs with their scores, every pair summed alike."""
    scores = (q[i] * x[j]).sum(1) if len(i) else np.zeros(0)
    vec = pa.array(ids[j], pa.int64(), mask=~known[j])
    return pa.RecordBatch.from_arrays(
        [pa.array(query_ids[i], pa.int64()), vec, pa.array(scores, pa.float64())], names=["query_id", "vec_id", "score"]
    )


def exact_neighbours(rows: DataFrame, width: int, query_ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """The exact k nearest rows of a bounded set of queries: all rows in blocks, ranked by query."""
    told = rows.sparkSession.sparkContext.broadcast((query_ids, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, q = told.value
        for batch in batches:
            for at in range(0, batch.num_rows, SHELF_ROWS):
                part = batch.slice(at, SHELF_ROWS)
                order, ids, known = _by_id(part.column("vec_id"))
                x = matrix(part.column("embedding"), width)[order]
                yield _scored(ids, known, x, query_ids, q, *top_pairs(ids, known, x, query_ids, q, k))

    return _best(rows.select("vec_id", "embedding").mapInArrow(run, RESULT_SCHEMA), k)


def queries_of(rows: DataFrame, every: int) -> DataFrame:
    """``(query_id, embedding)`` of the ids that ``every`` divides, once each."""
    chosen = rows.where(F.col("vec_id") % every == 0)
    return chosen.groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("embedding"))


class Index:
    """Posting lists of all rows, written once; ``search`` may be called for any set of queries."""

    def __init__(self, vectors: DataFrame):
        spark = self.spark = prepare(vectors.sparkSession)
        rows, self.width = usable(vectors)
        self.rows = rows
        facts = rows.select(F.count("*").alias("n"), F.max(_norm()).alias("largest")).first()
        self.n = facts["n"]
        if not self.n:
            return
        self.largest = facts["largest"]
        sample = rows.orderBy(F.xxhash64("vec_id", "embedding"), "vec_id", "embedding").limit(SAMPLE).toArrow()
        points = lifted(matrix(sample.column("embedding").combine_chunks(), self.width), self.largest)
        cells = int(min(MAX_LISTS, max(1, -(-self.n // LIST_ROWS)), max(1, len(points) // 4)))
        self.centroids = Centroids(balanced_centroids(points, cells))
        self._model = spark.sparkContext.broadcast(self.centroids)
        self.postings = written(self._posted(rows), "postings")
        counts = self.postings.groupBy("list").agg(F.count("*").alias("rows"), F.sum(F.col("home").cast("int")).alias("homes"))
        found = {r["list"]: (r["rows"], r["homes"]) for r in counts.collect()}  # at most MAX_LISTS rows
        lists = range(len(self.centroids.points))
        self.homes = np.array([found.get(i, (0, 0))[1] for i in lists], np.int64)
        self._shelve([found.get(i, (0, 0))[0] for i in lists])

    def _posted(self, rows: DataFrame) -> DataFrame:
        """``(list, home, spread, vec_id, embedding)``: each row in each of its lists; spread is unlike for all rows."""
        model, width, largest = self._model, self.width, self.largest
        kind = rows.schema["embedding"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 1024):
                    batch = whole.slice(at, 1024)
                    found = model.value.lists_of(lifted(matrix(batch.column("embedding"), width), largest))
                    sizes = [len(f) for f in found]
                    taken = batch.take(pa.array(np.repeat(np.arange(len(found)), sizes)))
                    home = np.concatenate([np.arange(n) == 0 for n in sizes])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(found)), pa.array(home), taken.column("vec_id"), taken.column("embedding")],
                        names=["list", "home", "vec_id", "embedding"],
                    )

        posted = rows.mapInArrow(run, f"list int, home boolean, vec_id bigint, embedding {kind}")
        return posted.withColumn("spread", F.monotonically_increasing_id())

    def _shelve(self, rows: list[int]) -> None:
        """Consecutive small lists share a shelf, a large list has several: the first shelf and the number of each."""
        self.first, self.shelves, shelf, held = [], [], 0, 0
        for n in rows:
            parts = max(1, -(-n // SHELF_ROWS))
            if held and held + n > SHELF_ROWS:
                shelf, held = shelf + 1, 0
            self.first.append(shelf)
            self.shelves.append(parts)
            if parts > 1:
                shelf, held = shelf + parts, 0
            else:
                held += n

    def calibrated(self, queries: DataFrame, k: int) -> float:
        """The least distance ratio that reaches ``TARGET`` of the exact neighbours of some queries."""
        some = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(CALIBRATION).toArrow()
        if not some.num_rows:
            return 1.0
        ids = some.column("query_id").to_numpy()
        q = matrix(some.column("embedding").combine_chunks(), self.width)
        truth = written(exact_neighbours(self.rows, self.width, ids, q, k).select("query_id", "rank", "vec_id"), "truth")
        held = self.postings.select("vec_id", "list").join(F.broadcast(truth), "vec_id")  # CALIBRATION * k rows
        lists = held.groupBy("query_id", "rank").agg(F.collect_set("list").alias("lists")).collect()
        order, far = self.centroids.search(aimed(q), len(self.centroids.points))
        reach = np.full(order.shape, np.inf)
        np.put_along_axis(reach, order, far / far[:, :1], 1)
        at = {i: n for n, i in enumerate(ids.tolist())}
        needed = sorted(min(reach[at[r["query_id"]], c] for c in r["lists"]) for r in lists)
        return float(needed[min(len(needed) - 1, int(TARGET * len(needed)))]) if needed else 1.0

    def search(self, queries: DataFrame, k: int, ratio: float | None = None) -> DataFrame:
        """``(query_id, rank, vec_id, score)``: the k nearest found of each of ``queries(query_id, embedding)``."""
        if not self.n:
            return self.spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
        queries = written(queries, "queries")
        ratio = self.calibrated(queries, k) if ratio is None else ratio
        visits = written(self._visits(queries, ratio, k), "visits")
        # whole-number arithmetic on bounded tables (one entry a list) puts rows on shelves
        first, shelves = F.array(*[F.lit(x) for x in self.first]), F.array(*[F.lit(x) for x in self.shelves])
        many = F.get(shelves, F.col("list"))
        shelf = F.get(first, F.col("list")) + F.when(many > 1, F.pmod(F.xxhash64("spread"), many)).otherwise(0).cast("int")
        blocks = visits.groupBy("shelf").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
        blocks = checked_broadcast(blocks)
        stored = self.postings.select(shelf.alias("shelf"), "list", "vec_id", "embedding").join(blocks, "shelf")
        stored = stored.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        asked = visits.join(blocks, "shelf").withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks").cast("int"))
        width = self.width

        def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
            left, right = left.combine_chunks(), right.combine_chunks()
            names = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
            if not left.num_rows or not right.num_rows:
                return names.empty_table()
            order, ids, known = _by_id(left.column("vec_id").combine_chunks())
            x = matrix(left.column("embedding").combine_chunks(), width)[order]
            of = left.column("list").to_numpy()[order]
            query_ids = right.column("query_id").to_numpy()
            q = matrix(right.column("embedding").combine_chunks(), width)
            wanted = right.column("lists").combine_chunks()
            who = np.repeat(np.arange(len(query_ids)), wanted.value_lengths().to_numpy())
            wanted = wanted.flatten().to_numpy()
            found_q, found_x = [], []
            for c in np.unique(wanted):
                mine, asking = np.flatnonzero(of == c), who[wanted == c]
                i, j = top_pairs(ids[mine], known[mine], x[mine], query_ids[asking], q[asking], k)
                found_q.append(asking[i])
                found_x.append(mine[j])
            made = _scored(ids, known, x, query_ids, q, np.concatenate(found_q), np.concatenate(found_x))
            # of all lists of the shelf, each query's k best pairs
            score, row = made.column("score").to_numpy(), np.concatenate(found_x)
            asker = np.concatenate(found_q)
            by = np.lexsort((row, -score, asker))
            asker, row, score = asker[by], row[by], score[by]
            same = np.zeros(len(by), bool)
            same[1:] = (asker[1:] == asker[:-1]) & (score[1:] == score[:-1]) & (ids[row[1:]] == ids[row[:-1]])
            same[1:] &= known[row[1:]] == known[row[:-1]]
            by, asker = by[~same], asker[~same]
            starts = np.flatnonzero(np.concatenate([[True], asker[1:] != asker[:-1]])) if len(asker) else np.zeros(0, int)
            place = np.arange(len(asker)) - np.repeat(starts, np.diff(np.append(starts, len(asker))))
            return pa.Table.from_batches([made.take(pa.array(by[place < k]))], names)

        n = 4 * partitions(self.spark)
        pairs = (
            stored.repartition(n, "shelf", "block").groupBy("shelf", "block")
            .cogroup(asked.repartition(n, "shelf", "block").groupBy("shelf", "block"))
            .applyInArrow(run, RESULT_SCHEMA)
        )
        return _best(pairs, k)

    def _visits(self, queries: DataFrame, ratio: float, k: int) -> DataFrame:
        """``(query_id, embedding, shelf, lists)``: each query on each shelf that holds lists it visits."""
        model, width, homes = self._model, self.width, self.homes
        first, shelves = np.array(self.first), np.array(self.shelves)
        kind = queries.schema["embedding"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 256):
                    batch = whole.slice(at, 256)
                    chosen = model.value.within(aimed(matrix(batch.column("embedding"), width)), ratio, homes, k + 1)
                    who, shelf, lists = [], [], []
                    for n, own in enumerate(chosen):
                        by: dict[int, list[int]] = {}
                        for c in own.tolist():
                            for s in range(first[c], first[c] + shelves[c]):
                                by.setdefault(s, []).append(c)
                        who += [n] * len(by)
                        shelf += by.keys()
                        lists += by.values()
                    taken = batch.take(pa.array(who, pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [
                            taken.column("query_id"), taken.column("embedding"), pa.array(shelf, pa.int32()),
                            pa.array(lists, pa.list_(pa.int32())),
                        ],
                        names=["query_id", "embedding", "shelf", "lists"],
                    )

        spread = queries.repartition(partitions(self.spark))
        return spread.mapInArrow(run, f"query_id bigint, embedding {kind}, shelf int, lists array<int>")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The k nearest rows found of every row whose vec_id ``every`` divides."""
    index = Index(vectors)
    return index.search(queries_of(index.rows, every), k)
