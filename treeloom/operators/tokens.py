"""Token counts as a corpus job (op 33).

Byte-pair encoding acts on each pre-token independently, so a text's token
count is the sum over its pre-tokens. Plan:

1. ``regexp_extract_all`` splits every text into pre-tokens (JVM, Unicode
   classes via ``(?U)``);
2. the texts' pre-tokens are written once, and the *distinct* ones of the corpus
   are counted (partial aggregation: a frequent pre-token costs one row per task);
3. BPE runs only on the distinct pre-tokens, in ``mapInPandas``; each Python
   worker parses the broadcast rank file once;
4. token counts meet the texts' pre-tokens where these lie: those of frequent
   pre-tokens are broadcast (``COMMON_BYTES`` of them, measured), and only
   occurrences of the others are shuffled, with a row number for their text.

With a ``TokenDictionary`` step 3 meets a written table (pre-token, tokens) first,
by an anti-join, and only pre-tokens that no corpus has had before are encoded
and appended.

The o200k_base rank file is not shipped; any rank file with its pattern may be
given. ``pretoken_counts`` reports pre-tokens under that name (never as tokens).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir, ship_package
from .joins import freeze, stored

# The o200k_base pre-tokenization pattern (public), as alternatives in order.
O200K_PATTERN = "|".join(
    [
        r"""[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+(?i:'s|'t|'re|'ve|'m|'ll|'d)?""",
        r"""[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*(?i:'s|'t|'re|'ve|'m|'ll|'d)?""",
        r"""\p{N}{1,3}""",
        r""" ?[^\s\p{L}\p{N}]+[\r\n/]*""",
        r"""\s*[\r\n]+""",
        r"""\s+(?!\S)""",
        r"""\s+""",
    ]
)
JAVA_PATTERN = "(?U)" + O200K_PATTERN
# Bytes of the frequent pre-tokens that are broadcast with their counts.
COMMON_BYTES = 16 * 1024 * 1024


def java_pattern(pattern: str) -> str:
    """A tokenizer's pre-token pattern for Java, where classes are Unicode's only when asked."""
    return "(?U)" + pattern


def pretokens(text: Column, pattern: str = JAVA_PATTERN) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), 0)


def pretoken_counts(texts: DataFrame, text_col: str = "text", keys=("root", "path")) -> DataFrame:
    """(keys..., pretokens): number of pre-tokens per text."""
    # counting matches does not build the array of pre-tokens (the pattern never matches empty)
    return texts.select(*keys, F.regexp_count(F.col(text_col), F.lit(JAVA_PATTERN)).cast("bigint").alias("pretokens"))


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one 'base64(token) rank' per line."""
    with open(path, "rb") as fh:
        return parse_ranks(fh.read())


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    pairs = (line.split() for line in raw.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def bpe_count(piece: bytes, ranks: dict[bytes, int]) -> int:
    """Number of tokens of one pre-token under byte-pair merges by rank, in O(n log n).

    Pairs wait in a heap by (rank, position); parts are a doubly linked list, and
    a pair that a merge has changed is skipped when it comes up.
    """
    n = len(piece)
    if n < 2 or piece in ranks:
        return min(n, 1)
    end = list(range(1, n + 1))  # of the part that begins here; 0 once merged away
    before = list(range(-1, n - 1))
    heap: list[tuple[int, int, int, int]] = []

    def offer(a: int) -> None:
        b = end[a]
        if b < n:
            rank = ranks.get(piece[a : end[b]])
            if rank is not None:
                heapq.heappush(heap, (rank, a, b, end[b]))

    for a in range(n - 1):
        offer(a)
    parts = n
    while heap:
        _, a, b, stop = heapq.heappop(heap)
        if end[a] != b or end[b] != stop:
            continue
        end[a], end[b] = stop, 0
        if stop < n:
            before[stop] = a
        parts -= 1
        offer(a)
        if before[a] >= 0:
            offer(before[a])
    return parts


_RANKS_CACHE: dict[str, dict[bytes, int]] = {}


def _held_ranks(spark, ranks_path: str):
    """The rank file's bytes (bounded by the vocabulary), read on the driver and broadcast."""
    with open(ranks_path, "rb") as fh:
        return spark.sparkContext.broadcast(fh.read())


def _ranks_of(held) -> dict[bytes, int]:
    """The parsed ranks, once per worker process and vocabulary."""
    key = hashlib.sha256(held.value).hexdigest()
    if key not in _RANKS_CACHE:
        _RANKS_CACHE[key] = parse_ranks(held.value)
    return _RANKS_CACHE[key]


def _encoder(held, columns: str = "pt string"):
    schema = f"{columns}, tokens bigint"

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks = _ranks_of(held)
        for pdf in batches:
            yield pdf.assign(tokens=[bpe_count(p.encode("utf-8"), ranks) for p in pdf["pt"]])

    return encode, schema


class TokenDictionary:
    """Token counts of all pre-tokens met so far, as Parquet in shared storage; one per rank file and pattern.

    Appends are committed by Spark as a whole, so a failed job leaves the table as
    it was. Two jobs that append at once may both add a pre-token, with the same
    count: readers take each pre-token once.
    """

    SCHEMA = "pt string, tokens bigint"

    def __init__(self, spark: SparkSession, ranks_path: str, pattern: str = O200K_PATTERN, folder: str | None = None):
        ship_package(spark)
        self.spark, self.pattern = spark, java_pattern(pattern)
        self._held = _held_ranks(spark, ranks_path)
        digest = hashlib.sha256(self._held.value + pattern.encode()).hexdigest()[:16]
        base = folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/treeloom-token-dictionary"
        self.path = f"{base}/{digest}"
        if not self._exists():
            spark.createDataFrame([], self.SCHEMA).write.mode("ignore").parquet(self.path)

    def _exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def table(self) -> DataFrame:
        """(pt, tokens), each pre-token once."""
        rows = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        return rows.groupBy("pt").agg(F.max("tokens").alias("tokens"))

    def learn(self, distinct: DataFrame) -> int:
        """Encode and append the pre-tokens of ``distinct(pt)`` that are not in the table; returns their number."""
        new = freeze(distinct.join(self.table(), "pt", "left_anti"))
        n = new.count()
        if n:
            encode, schema = _encoder(self._held)
            new.mapInPandas(encode, schema).write.mode("append").parquet(self.path)
        return n


def token_counts(texts: DataFrame, ranks_path: str, text_col: str = "text", keys=("root", "path"),
                 dictionary: TokenDictionary | None = None, common_bytes: int = COMMON_BYTES) -> DataFrame:
    """(keys..., tokens) with the rank file at ``ranks_path`` (read on the driver).

    A ``dictionary`` (of the same rank file) brings its own pattern and remembers what is encoded here.
    """
    ship_package(texts.sparkSession)
    keys = list(keys)
    found = pretokens(F.col(text_col), dictionary.pattern if dictionary else JAVA_PATTERN)
    rows = stored(texts.select(F.monotonically_increasing_id().alias("__row"), *keys, found.alias("pts")), "pretokens")
    seen = stored(rows.select(F.explode("pts").alias("pt")).groupBy("pt").agg(F.count("*").alias("n")), "seen")
    if dictionary is None:
        encode, schema = _encoder(_held_ranks(texts.sparkSession, ranks_path), "pt string, n bigint")
        known = stored(seen.mapInPandas(encode, schema), "known")
    else:
        dictionary.learn(seen.select("pt"))
        known = stored(seen.join(dictionary.table(), "pt"), "known")
    each = rows.select("__row", F.explode("pts").alias("pt"))
    summed = _summed(each, known, common_bytes).join(rows.select("__row", *keys), "__row")
    summed = summed.groupBy(*keys).agg(F.sum("tokens").cast("bigint").alias("tokens"))
    # texts without any pre-token have 0 tokens
    return rows.select(*keys).join(summed, keys, "left").select(*keys, F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"))


def _summed(each: DataFrame, known: DataFrame, common_bytes: int) -> DataFrame:
    """(__row, tokens): summed over each(__row, pt) by known(pt, n, tokens), of which the most frequent are broadcast."""
    # pre-tokens by the number of binary digits of their count: 64 rows at most
    digits = F.length(F.bin("n"))
    size = F.sum(F.octet_length("pt") + F.lit(16))
    sizes = {r["digits"]: r["size"] for r in known.groupBy(digits.alias("digits")).agg(size.alias("size")).collect()}
    least, total = 65, 0
    for d in sorted(sizes, reverse=True):
        total += sizes[d]
        if total > common_bytes:
            break
        least = d
    common = F.broadcast(known.where(digits >= least).select("pt", "tokens"))
    sums = lambda rows: rows.groupBy("__row").agg(F.sum("tokens").alias("tokens"))
    here = sums(each.join(common, "pt"))
    if total <= common_bytes:
        return here
    rare = known.where(digits < least).select("pt", "tokens")
    return sums(here.unionByName(each.join(common, "pt", "left_anti").join(rare, "pt").select("__row", "tokens")))


def python_pretokens(text: str) -> list[str]:
    import regex

    return regex.findall(O200K_PATTERN, text)


def count_text(text: str, ranks: dict[bytes, int]) -> int:
    return sum(bpe_count(p.encode("utf-8"), ranks) for p in python_pretokens(text))


def header_fixpoint(prefix: Column, suffix: Column, body_tokens: Column, ranks_path: str) -> Column:
    """Token count t with t = tokens(prefix + token line(t) + suffix) + body_tokens, iterated at most
    10 times from 0 (the header is small: one Arrow-batched call per root)."""

    held = _held_ranks(SparkSession.getActiveSession(), ranks_path)

    @F.pandas_udf(T.LongType())
    def fix(pre: pd.Series, suf: pd.Series, body: pd.Series) -> pd.Series:
        ranks = _ranks_of(held)
        out = []
        for p, s, b in zip(pre, suf, body):
            t = 0
            for _ in range(10):
                est = count_text(f"{p}- Tokens (o200k_base): {t:,}\n{s}", ranks) + int(b)
                if est == t:
                    break
                t = est
            out.append(t)
        return pd.Series(out, dtype="int64")

    return fix(prefix, suffix, body_tokens)
