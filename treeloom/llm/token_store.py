"""Token ids in directly addressable codes (operator 7).

An id is split into chunks of eight bits, one level per chunk. Level l holds the
chunk of every id that has one; a bitmap tells which of them continue on the
next level, and a rank directory counts the set bits before every 512th. The id
at any position is read by one rank per level, and a range of ids is a range on
every level, so nothing else is decoded.

Files are Parquet (any storage Spark writes to, committed by Spark): one row per
segment of consecutive documents in ascending doc_id order, with the documents'
ids and token counts and the coded payload. Segments close at ``SEGMENT`` ids; a
longer document is one segment of its own.

Defined cases: null text counts as empty (one id, the end id); a null doc_id
comes first; rows with the same doc_id are ordered by text; extra columns are
ignored; an empty table gives files without rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import partitions, prepare, text_or_empty

SEGMENT = 1 << 20
EVERY = 512
MAGIC = b"DAC1"
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)

SEGMENT_SCHEMA = (
    "part int, segment int, local_start bigint, n_ids bigint, doc_ids array<bigint>, counts array<bigint>, payload binary"
)


def dac_encode(ids: np.ndarray) -> bytes:
    """The codes of unsigned 32-bit ids: per level the chunks, the bitmap and its rank directory."""
    levels, rest = [], np.asarray(ids, "<u4")
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        starts = np.arange(0, len(bits), EVERY // 8)
        set_bits = np.add.reduceat(_ONES[bits], starts, dtype=np.int64) if len(bits) else np.zeros(0, np.int64)
        ranks = np.concatenate([[0], np.cumsum(set_bits, dtype=np.int64)]).astype("<u4")
        levels.append(((rest & 0xFF).astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()))
        rest = rest[more] >> 8
        if not len(rest):
            break
    head = MAGIC + struct.pack("<QB", len(ids), len(levels))
    return head + b"".join(struct.pack("<QQQ", *map(len, level)) + b"".join(level) for level in levels)


class DacReader:
    """Random access to the ids of one payload."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a payload of this format")
        self.n, count = struct.unpack_from("<QB", payload, 4)
        at = 13
        self.levels = []
        for _ in range(count):
            sizes = struct.unpack_from("<QQQ", payload, at)
            at += 24
            parts = []
            for size, kind in zip(sizes, (np.uint8, np.uint8, "<u4"), strict=True):
                parts.append(np.frombuffer(payload, kind, size // np.dtype(kind).itemsize, at))
                at += size
            self.levels.append(tuple(parts))

    def _rank(self, level: int, i: int) -> int:
        """Set bits before position i."""
        _, bits, ranks = self.levels[level]
        block = i // EVERY
        whole = int(ranks[block]) + int(_ONES[bits[block * (EVERY // 8) : i // 8]].sum(dtype=np.int64))
        return whole + (int(_ONES[bits[i // 8] & ((1 << (i % 8)) - 1)]) if i % 8 else 0)

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * level
            if not bits[i // 8] >> (i % 8) & 1:
                break
            i = self._rank(level, i)
        return value

    def slice(self, start: int, end: int) -> np.ndarray:
        """Ids of positions start..end-1; only these positions are read on any level."""
        if end <= start:
            return np.zeros(0, "<u4")
        chunks, bits, _ = self.levels[0]
        out = chunks[start:end].astype("<u4")
        where = np.arange(end - start)
        for level in range(len(self.levels) - 1):
            bits = self.levels[level][1]
            window = np.unpackbits(bits[start // 8 : -(-end // 8)], bitorder="little")
            more = window[start % 8 : start % 8 + end - start].astype(bool)
            if not more.any():
                break
            start = self._rank(level, start)
            where = where[more]
            end = start + len(where)
            out[where] |= self.levels[level + 1][0][start:end].astype("<u4") << np.uint32(8 * (level + 1))
        return out


class WordEncoder:
    """Ids of whole texts from the tokenizers library, remembering those of frequent words.

    The vocabulary's pre-tokeniser never joins characters across ASCII blanks and
    drops those, so the ids of a text are those of its blank-separated words in
    turn. A word of Latin letters (below U+0180, where composition changes
    nothing) that was not seen yet is lower-cased and cut by the definition's own
    pattern, and the library's model merges each part; every other word goes
    through the library's whole pipeline, as do all words under a definition of
    another kind.
    """

    REMEMBERED = 500_000
    LONGEST = 64
    LATIN = re.compile("[\x00-\u017f]*")

    class Known(dict):
        """Ids by word; a word not seen yet is learned, and remembered unless it is very long."""

        def __init__(self, learn):
            self.learn = learn

        def __missing__(self, word: bytes) -> bytes:
            ids = self.learn(word)
            if len(word) <= WordEncoder.LONGEST:
                self[word] = ids
            return ids

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread a task
        import regex
        from tokenizers import Tokenizer

        from .byte_bpe import byte_characters

        self.tokenizer = Tokenizer.from_str(definition)
        self.model = self.tokenizer.model
        self.chars = dict(enumerate(byte_characters()))
        pattern = self._pattern(json.loads(definition))
        self.parts = regex.compile(pattern).findall if pattern else None
        self.known = self.Known(self._learn)
        self.merged: dict[str, bytes] = {}

    @staticmethod
    def _pattern(definition: dict) -> str | None:
        """The split pattern of a definition that composes, blanks, lower-cases, splits and maps bytes; else none."""
        steps = (definition.get("normalizer") or {}).get("normalizers") or []
        if [x["type"] for x in steps] != ["NFC", "Replace", "Lowercase"]:
            return None
        if steps[1].get("pattern") != {"Regex": "\\s+"} or steps[1].get("content") != " ":
            return None
        cut = (definition.get("pre_tokenizer") or {}).get("pretokenizers") or []
        if [x["type"] for x in cut] != ["Split", "ByteLevel"] or cut[1].get("add_prefix_space") or cut[1].get("use_regex"):
            return None
        if cut[0].get("behavior") != "Removed" or not cut[0].get("invert"):
            return None
        return cut[0]["pattern"].get("Regex")

    def _merge(self, part: str) -> bytes:
        ids = self.merged.get(part)
        if ids is None:
            spelled = part.encode("utf-8").decode("latin-1").translate(self.chars)
            ids = np.array([t.id for t in self.model.tokenize(spelled)], "<u4").tobytes()
            self.merged[part] = ids
        return ids

    def _learn(self, raw: bytes) -> bytes:
        word = raw.decode("utf-8")
        if self.parts and len(raw) <= self.LONGEST and "<|" not in word and self.LATIN.fullmatch(word):
            return b"".join(map(self._merge, self.parts(word.lower())))
        # special tokens, other scripts, very long words, other definitions
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if len(self.known) > self.REMEMBERED:
            self.known.clear()
        if len(self.merged) > self.REMEMBERED:
            self.merged.clear()
        # bytes.split() parts at the ASCII blanks [ \t-\r] and nothing else
        return b"".join(map(self.known.__getitem__, text.encode("utf-8").split()))


_ENCODERS: dict[str, WordEncoder] = {}


def encoder_for(definition: str) -> WordEncoder:
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(definition)
    return _ENCODERS[key]


def write_ids(docs: DataFrame, tokenizer_path: str, path: str, end_id: int) -> None:
    """Encode every document, append ``end_id`` and write segments in ascending doc_id order.

    Texts are range-partitioned once; a partition is encoded as it streams by, so
    a task holds one segment and a slice of the texts.
    """
    spark = prepare(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_for(definition.value)
        end = np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        segment, start = 0, 0
        ids: list[bytes] = []
        names: list[int | None] = []

        def close() -> pd.DataFrame:
            payload = dac_encode(np.frombuffer(b"".join(ids), "<u4"))
            counts = [len(b) // 4 for b in ids]
            return pd.DataFrame(
                {
                    "part": [part], "segment": [segment], "local_start": [start], "n_ids": [sum(counts)],
                    "doc_ids": [names[:]], "counts": [counts], "payload": [payload],
                }
            )

        held = 0
        for batch in batches:
            for name, text in zip(batch["doc_id"], batch["text"], strict=True):
                coded = encoder.encode(text) + end
                names.append(None if name is None else int(name))
                ids.append(coded)
                held += len(coded) // 4
                if held >= SEGMENT:
                    yield close()
                    start, segment, held = start + held, segment + 1, 0
                    ids.clear()
                    names.clear()
        if ids:
            yield close()

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    ordered = narrow.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    # null ids cross pandas as strings, not as floats
    rows = ordered.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(pack, SEGMENT_SCHEMA)
    rows.write.parquet(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The files' segments with ``start``, the number of ids in all segments before."""
    rows = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    # one row per writing task: bounded by the number of partitions, not by the documents
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("local_start"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the files alone."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                reader = DacReader(row.payload)
                at, out = 0, []
                for name, count in zip(row.doc_ids, row.counts, strict=True):
                    ids = reader.slice(at, at + int(count))
                    out.append((name, row.start + at, int(count), zlib.crc32(ids.tobytes())))
                    at += int(count)
                frame = pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
                frame["doc_id"] = [None if x is None or x != x else int(x) for x in frame["doc_id"]]
                yield frame.astype({"doc_id": "Int64"})

    rows = segments(prepare(spark), path).select("start", "doc_ids", "counts", "payload")
    return rows.mapInPandas(unpack, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def ids_at(positions: DataFrame, path: str) -> DataFrame:
    """``(position, id)``: random access to global positions through the rank directories.

    Positions join the segment that holds them through its million-id blocks, so
    both sides are hash-partitioned by block.
    """
    spark = prepare(positions.sparkSession)
    rows = segments(spark, path).select("start", "n_ids", "payload")
    block = F.explode(F.sequence(F.expr(f"start div {SEGMENT}"), F.expr(f"(start + n_ids - 1) div {SEGMENT}")))
    held = rows.withColumn("block", block)
    wanted = positions.select(F.col("position").cast("bigint").alias("position"))
    wanted = wanted.withColumn("block", F.expr(f"position div {SEGMENT}"))
    inside = (F.col("position") >= F.col("start")) & (F.col("position") < F.col("start") + F.col("n_ids"))

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                reader = DacReader(row.payload)
                yield pd.DataFrame(
                    {"position": row.wanted, "id": [reader[int(p) - row.start] for p in row.wanted]}
                )

    grouped = (
        wanted.join(held.select("block", "start", "n_ids"), "block").where(inside)
        .groupBy("start", (F.col("position") % 64).alias("salt"))
        .agg(F.collect_set("position").alias("wanted"))
    )
    return grouped.join(rows.select("start", "payload"), "start").select("start", "wanted", "payload").mapInPandas(
        fetch, "position bigint, id bigint"
    )


def fresh_path(spark: SparkSession) -> str:
    """A new folder for files below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/treeloom-ids-{uuid.uuid4().hex}"
