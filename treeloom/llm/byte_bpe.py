"""Byte-level BPE through sentencepiece (operator 6).

The rank file is turned into a sentencepiece BPE model without training: every
byte sequence becomes a piece of printable characters (one per byte), scored by
its negative rank, with identity normalisation. Merging the best-scored adjacent
pair is then merging the pair of lowest rank. The model's bytes (bounded by the
vocabulary file, not by the data) are broadcast; each pre-token is encoded on
its own and ids are decoded through the inverse table.

Defined cases: null text counts as empty and has no ids; text columns of other
names and extra columns are ignored; ties and repeated rows are encoded alike.
Lone surrogates cannot occur in a Spark string.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, text_or_empty

# Distinct pre-tokens a worker remembers before it starts again: bounds its memory.
REMEMBERED = 400_000
LONGEST_REMEMBERED = 64
# Rows of an Arrow batch are bounded by Spark; texts are encoded one by one inside it.

ENCODED_SCHEMA = "doc_id bigint, ids binary, decoded binary"


def byte_characters() -> list[str]:
    """One printable character for each byte: itself where printable, else from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in set(printable) else chr(next(spare)) for b in range(256)]


def load_ranks(raw: bytes) -> list[bytes]:
    """Byte sequences by rank, from the lines ``base64 rank``; ranks must be 0, 1, 2, ..."""
    pairs = [line.split() for line in raw.splitlines() if line.strip()]
    by_rank = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(by_rank) != list(range(len(pairs))):
        raise ValueError("ranks must be contiguous from 0 and unique")
    return [by_rank[i] for i in range(len(pairs))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while True:
        n, low = n >> 7, n & 0x7F
        out.append(low | (0x80 if n else 0))
        if not n:
            return bytes(out)


def _field(number: int, wire: int, payload: bytes) -> bytes:
    head = _varint(number << 3 | wire)
    return head + (_varint(len(payload)) + payload if wire == 2 else payload)


def serialise_model(pieces: list[bytes]) -> bytes:
    """A sentencepiece ModelProto with ``pieces`` at ids 0.. and the unknown piece after them.

    Field numbers are those of the public sentencepiece_model.proto: ModelProto
    pieces=1, trainer_spec=2, normalizer_spec=3; SentencePiece piece=1, score=2,
    type=3 (NORMAL=1, UNKNOWN=2); TrainerSpec model_type=3 (BPE=2), unk/bos/eos/pad
    id=40..43; NormalizerSpec name=1, add_dummy_prefix=3,
    remove_extra_whitespaces=4, escape_whitespaces=5.
    """
    import struct

    chars = byte_characters()
    out = bytearray()
    for rank, piece in enumerate(pieces):
        text = "".join(chars[b] for b in piece).encode("utf-8")
        body = _field(1, 2, text) + _field(2, 5, struct.pack("<f", -float(rank))) + _field(3, 0, _varint(1))
        out += _field(1, 2, body)
    out += _field(1, 2, _field(1, 2, b"<unk>") + _field(2, 5, struct.pack("<f", 0.0)) + _field(3, 0, _varint(2)))
    absent = _varint((1 << 64) - 1)  # -1
    trainer = _field(3, 0, _varint(2)) + _field(40, 0, _varint(len(pieces)))
    trainer += b"".join(_field(n, 0, absent) for n in (41, 42, 43))
    out += _field(2, 2, trainer)
    normaliser = _field(1, 2, b"identity") + b"".join(_field(n, 0, _varint(0)) for n in (3, 4, 5))
    out += _field(3, 2, normaliser)
    return bytes(out)


class Codec:
    """Encoder of pre-tokens and decoder of ids for one rank file; remembers frequent pre-tokens."""

    def __init__(self, raw_ranks: bytes, pattern: str):
        import regex
        import sentencepiece

        self.pieces = load_ranks(raw_ranks)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.pieces))
        self.split = regex.compile(pattern).findall
        # bytes -> characters through latin-1, one character per byte
        self.chars = {b: c for b, c in enumerate(byte_characters())}
        self.known: dict[str, bytes] = {}

    def _packed(self, pre_tokens: list[str]) -> None:
        import numpy as np

        texts = [t.encode("utf-8").decode("latin-1").translate(self.chars) for t in pre_tokens]
        for token, ids in zip(pre_tokens, self.model.encode(texts, num_threads=1), strict=True):
            self.known[token] = np.asarray(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        tokens = self.split(text)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        missing = [t for t in set(tokens) if t not in known]
        if missing:
            self._packed(missing)
        out = b"".join([known[t] for t in tokens])
        for t in missing:
            if len(t) > LONGEST_REMEMBERED:
                del known[t]
        return out

    def decode(self, ids: bytes) -> bytes:
        import numpy as np

        pieces = self.pieces
        return b"".join([pieces[i] for i in np.frombuffer(ids, "<u4").tolist()])


_CODECS: dict[tuple[str, str], Codec] = {}


def codec_for(raw_ranks: bytes, pattern: str) -> Codec:
    """One codec per worker process and vocabulary."""
    key = (hashlib.sha256(raw_ranks).hexdigest(), pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(raw_ranks, pattern)
    return _CODECS[key]


def _apply(docs: DataFrame, ranks_path: str, pattern: str, row, schema: str) -> DataFrame:
    """``row(codec, doc_id, text)`` for every document, a few hundred documents at a time."""
    spark = prepare(docs.sparkSession)
    with open(ranks_path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = codec_for(ranks.value, pattern)
        columns = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            for at in range(0, len(batch), 256):  # ids and decoded bytes of 256 documents at once, not of a batch
                part = batch.iloc[at : at + 256]
                yield pd.DataFrame(
                    [row(codec, i, t) for i, t in zip(part["doc_id"], part["text"], strict=True)], columns=columns
                )

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    # null ids cross pandas as strings, not as floats
    return narrow.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, schema)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``(doc_id, ids, decoded)``: ids as little-endian unsigned 32-bit integers, and their bytes again."""

    def row(codec: Codec, doc_id, text):
        ids = codec.encode(text)
        return None if doc_id is None else int(doc_id), ids, codec.decode(ids)

    return _apply(docs, ranks_path, pattern, row, ENCODED_SCHEMA)


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of the same ids, hashed where they are made."""

    def row(codec: Codec, doc_id, text):
        ids = codec.encode(text)
        return (
            None if doc_id is None else int(doc_id),
            len(ids) // 4,
            hashlib.sha256(ids).hexdigest(),
            hashlib.sha256(codec.decode(ids)).hexdigest(),
        )

    return _apply(
        docs, ranks_path, pattern, row, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
