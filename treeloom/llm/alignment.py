"""Alignment of two tokenizers over the same texts (operator 13).

Both tokenizers encode a whole text behind one blank: A is a byte-level BPE of the
tokenizers library, B a sentencepiece BPE (which sets the blank itself). A shared
end is a byte offset where a token of each ends; those before tokens that begin
with a blank on both sides are anchors. Anchors split a document into windows of
token ids, and a window's alignment depends on its two id tuples alone, so it is
made once and remembered.

Every document is encoded by both tokenizers, whether or not its text or words were
met before. Where no token of B has a blank behind another character, no token of
either side reaches across a blank that follows a character which is not white
space: the ids of some documents then lie in a row, and their groups and links are
found by array operations over all of them; no window is remembered.

Texts of Latin letters are merged by A's own table through tiktoken, whose table of
ranks says the same where each merge makes the token of its number (checked), and
whose pattern is that of the byte-level pre-tokeniser. In other texts this holds
for the words of Latin letters: a text is cut before a blank that follows a
character which is not white space and that something follows, where no pre-token
reaches across. Other words, and all texts under another kind of definition, go
through the tokenizers library. The bytes of both id sequences are compared with
the text's.

The links of all documents are counted by Spark (distinct pairs of each document,
summed by map tasks first). Documents then look their pairs up in the counted
table: broadcast while it stays below ``BROADCAST_BYTES``, joined beyond it.

Defined cases: texts that are null, empty, or whose bytes either tokenizer does
not give back (B writes a literal U+2581 as a blank) have no tokens: zeros and an
empty string. Rows are independent, so a null, shared or repeated doc_id is kept
as it is; extra columns are ignored; an empty table gives no rows. Strings of
special tokens are plain text on both sides.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import byte_characters
from .common import prepare, written

# Remembered windows of a worker, and the most ids of one that is remembered: they bound its memory.
REMEMBERED = 200_000
LONGEST_REMEMBERED = 64
# Characters of the texts that are aligned at once.
TOGETHER_CHARACTERS = 100_000
# The counted pairs are broadcast while they take at most so many bytes.
BROADCAST_BYTES = 32 * 1024 * 1024
PAIR_BYTES = 17
# Documents whose rows leave a worker together.
TOGETHER = 256
MARK = "\u2581"
# White space by any of the libraries' definitions, now or earlier: no word ends with one.
BLANKS = frozenset(
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 ᠎​    ⁠　﻿"
) | frozenset(map(chr, range(0x2000, 0x200B)))

OPEN = BLANKS | {""}

# Below this character no definition of letters, digits and white space differs between the libraries.
LATIN = re.compile("[\x00-\u024f]*")
# Fixed value: the pattern of the byte-level pre-tokeniser.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

ALIGNED_SCHEMA = (
    "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups string, groups_sha256 string, "
    "pairs array<bigint>, times array<bigint>"
)
RESULT_SCHEMA = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
)


def plain_bpe(b_model: bytes) -> bool:
    """Whether a sentencepiece model merges pairs and has no table of characters to normalise."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto.FromString(b_model)
    bpe = model.trainer_spec.model_type == model.trainer_spec.BPE
    return bpe and not model.normalizer_spec.precompiled_charsmap and not model.trainer_spec.treat_whitespace_as_suffix


class Aligner:
    """Both tokenizers with their tokens' bytes, and the groups of the windows seen so far."""

    def __init__(self, a_definition: bytes, b_model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_definition.decode("utf-8"))
        self.a.encode_special_tokens = True
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        entries = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            if all([c in byte_of for c in entry]):
                self.a_bytes[i] = bytes([byte_of[c] for c in entry])
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode("utf-8") for i, p in enumerate(pieces)
        ]
        self.names = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        definition = json.loads(a_definition)
        byte_level = (definition["pre_tokenizer"] or {}).get("type") == "ByteLevel" and definition["normalizer"] is None
        self.ranked = self._ranked(definition, byte_of) if byte_level else None
        # the decimal ids, a comma behind each, in a row
        self.name_sizes = np.array([len(x) + 1 for x in self.names])
        self.name_flat = np.frombuffer("".join(x + "," for x in self.names).encode(), np.uint8)
        self.name_starts = np.cumsum(self.name_sizes) - self.name_sizes
        self.a_sizes = np.array([len(x) for x in self.a_bytes])
        self.b_sizes = np.array([len(x) for x in self.b_bytes])
        # all tokens' bytes in a row, and where each token's begin
        self.a_flat, self.b_flat = (np.frombuffer(b"".join(x), np.uint8) for x in (self.a_bytes, self.b_bytes))
        self.a_starts, self.b_starts = (np.cumsum(x) - x for x in (self.a_sizes, self.b_sizes))
        self.a_blank = np.array([x[:1] == b" " for x in self.a_bytes])
        self.b_blank = np.array([x[:1] == b" " for x in self.b_bytes])
        self.windows: dict[tuple[bytes, bytes], str] = {}
        # B: a blank behind another character is in no token, and the normaliser changes nothing but blanks
        apart = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.by_words = self.ranked is not None and apart and plain_bpe(b_model)

    @staticmethod
    def _ranked(definition: dict, byte_of: dict[str, int]):
        """A's table as tiktoken ranks; None unless single bytes come first and each merge makes the token of its number."""
        import tiktoken

        model = definition["model"]
        added = {t["id"] for t in definition["added_tokens"]}
        ranks = {bytes([byte_of[c] for c in e]): i for e, i in model["vocab"].items() if i not in added}
        joined = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ordered = all(model["vocab"].get(x + y) == 256 + n for n, (x, y) in enumerate(joined))
        plain = not model["ignore_merges"] and not definition["pre_tokenizer"]["add_prefix_space"] and definition["pre_tokenizer"]["use_regex"]
        if not (ordered and plain and len(ranks) == 256 + len(joined)):
            return None
        return tiktoken.Encoding("ranked", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def parts(text: str) -> list[str]:
        """The words of a text without the blank that each follows; joined by blanks they are the text."""
        parts = text.split(" ")
        if OPEN.isdisjoint([p[-1:] for p in parts]):
            return parts
        out = [parts[0]]
        for i, part in enumerate(parts[1:], 2):
            open_end = not out[-1] or out[-1][-1] in BLANKS
            if open_end or (not part and i == len(parts)):
                out[-1] += " " + part
            else:
                out.append(part)
        return out

    def encoded(self, text: str) -> np.ndarray:
        """A's ids of a text behind one blank."""
        whole = lambda t: np.array(self.a.encode(" " + t, add_special_tokens=False).ids, np.int32)
        if self.ranked is None:
            return whole(text)
        if LATIN.fullmatch(text):
            return self.ranked.encode_to_numpy(" " + text).astype(np.int32)
        out = []
        for latin, run in groupby(self.parts(text), key=lambda p: LATIN.fullmatch(p) is not None):
            words = " ".join(run)
            out.append(self.ranked.encode_to_numpy(" " + words).astype(np.int32) if latin else whole(words))
        return np.concatenate(out)

    @staticmethod
    def joined(ids: np.ndarray, ends: np.ndarray, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> bytes:
        """The bytes of the tokens ``ids``, which end at ``ends``, in a row."""
        own = sizes[ids]
        return flat[np.repeat(starts[ids] - ends + own, own) + np.arange(ends[-1])].tobytes() if len(ids) else b""

    def shared_ends(
        self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The last tokens of each group in both id sequences, given all tokens' ends, and which groups end windows.

        A window ends where the next tokens are blank-marked on both sides (an anchor), and at the end.
        """
        size = int(ends_a[-1])
        in_a, in_b = np.zeros(size + 1, bool), np.zeros(size + 1, bool)
        in_a[ends_a] = in_b[ends_b] = True
        last_a, last_b = np.flatnonzero(in_b[ends_a]), np.flatnonzero(in_a[ends_b])
        anchor = np.ones(len(last_a), bool)
        anchor[:-1] = self.a_blank[a[last_a[:-1] + 1]] & self.b_blank[b[last_b[:-1] + 1]]
        return last_a, last_b, np.flatnonzero(anchor)

    def align(self, text: str | None) -> tuple[int, int, int, str, np.ndarray]:
        """``(n_a, n_b, n_groups, groups, linked pairs)`` of a document."""
        return self.align_all([text])[0]

    def align_all(self, texts: list[str | None]) -> list[tuple[int, int, int, str, np.ndarray]]:
        """``align`` of each text; every one is encoded by both tokenizers."""
        nothing = (0, 0, 0, "", np.zeros(0, np.int64))
        if not self.by_words:
            return [self.whole(t) or nothing if t else nothing for t in texts]
        out = [nothing] * len(texts)
        at, size = [], 0
        for i, text in enumerate(texts, 1):
            if text:
                at.append(i - 1)
                size += len(text)
            if at and (size >= TOGETHER_CHARACTERS or i == len(texts)):
                own = [texts[j] for j in at]
                a = [self.encoded(t) for t in own]
                b = [np.array(self.b.encode(t, num_threads=1), np.int32) for t in own]
                for j, found in zip(at, self.together([(" " + t).encode("utf-8") for t in own], a, b)):
                    out[j] = found or nothing
                at, size = [], 0
        return out

    def together(self, raw: list[bytes], a: list[np.ndarray], b: list[np.ndarray]) -> list[tuple | None]:
        """What ``whole`` gives for texts whose bytes and ids are known, all aligned at once; in halves when some are not given back."""
        ids_a, ids_b = np.concatenate(a), np.concatenate(b)
        ends_a, ends_b = np.cumsum(self.a_sizes[ids_a]), np.cumsum(self.b_sizes[ids_b])
        stops = np.cumsum([len(x) for x in raw])
        same = all(
            np.array_equal(np.concatenate([[0], ends])[np.cumsum([len(x) for x in ids])], stops) for ids, ends in ((a, ends_a), (b, ends_b))
        )
        whole = b"".join(raw)
        if (
            not same
            or self.joined(ids_a, ends_a, self.a_flat, self.a_starts, self.a_sizes) != whole
            or self.joined(ids_b, ends_b, self.b_flat, self.b_starts, self.b_sizes) != whole
        ):
            half = len(raw) // 2
            return [*self.together(raw[:half], a[:half], b[:half]), *self.together(raw[half:], a[half:], b[half:])] if half else [None]
        last_a, last_b, _ = self.shared_ends(ids_a, ids_b, ends_a, ends_b)
        # the groups that end with texts
        last = np.searchsorted(ends_a[last_a], stops)
        text, ends = self.groups(ids_a, ids_b, last_a, last_b)
        pairs = ids_a[last_a].astype(np.int64) << 32 | ids_b[last_b]
        out, begin, start = [], 0, 0
        for x, y, end, stop in zip(a, b, ends[last].tolist(), (last + 1).tolist()):
            out.append((len(x), len(y), stop - start, text[begin : end - 1], pairs[start:stop]))
            begin, start = end, stop
        return out

    def groups(self, ids_a: np.ndarray, ids_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> tuple[str, np.ndarray]:
        """All groups as text with a ``;`` behind each, and where each ends, by array operations."""
        number = np.arange(len(last_a))
        before = np.concatenate([[0], last_b[:-1] + 1])[np.repeat(number, np.diff(last_a, prepend=-1))]
        at_a = np.arange(len(ids_a)) + before
        at_b = np.arange(len(ids_b)) + (last_a + 1)[np.repeat(number, np.diff(last_b, prepend=-1))]
        ids = np.empty(len(ids_a) + len(ids_b), np.int64)
        ids[at_a], ids[at_b] = ids_a, ids_b
        ends = np.cumsum(self.name_sizes[ids])
        text = np.frombuffer(self.joined(ids, ends, self.name_flat, self.name_starts, self.name_sizes), np.uint8).copy()
        text[ends[at_a[last_a]] - 1] = ord("|")
        text[ends[at_b[last_b]] - 1] = ord(";")
        return text.tobytes().decode("ascii"), ends[at_b[last_b]]

    def shared(self, text: str) -> tuple | None:
        """Both id sequences, A's ends, the groups' last tokens and the windows' last groups; None if bytes are not given back."""
        ids_a, ids_b = self.encoded(text), np.array(self.b.encode(text, num_threads=1), np.int32)
        ends_a, ends_b = np.cumsum(self.a_sizes[ids_a]), np.cumsum(self.b_sizes[ids_b])
        raw = (" " + text).encode("utf-8")
        if (
            self.joined(ids_a, ends_a, self.a_flat, self.a_starts, self.a_sizes) != raw
            or self.joined(ids_b, ends_b, self.b_flat, self.b_starts, self.b_sizes) != raw
        ):
            return None
        return ids_a, ids_b, ends_a, *self.shared_ends(ids_a, ids_b, ends_a, ends_b)

    def whole(self, text: str) -> tuple[int, int, int, str, np.ndarray] | None:
        """``align`` of a text as a whole; None if its bytes are not given back."""
        found = self.shared(text)
        if found is None:
            return None
        ids_a, ids_b, _, last_a, last_b, cuts = found
        pairs = ids_a[last_a].astype(np.int64) << 32 | ids_b[last_b]
        return len(ids_a), len(ids_b), len(last_a), ";".join(self.texts(ids_a, ids_b, last_a, last_b, cuts)), pairs

    def texts(self, ids_a: np.ndarray, ids_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, cuts: np.ndarray) -> list[str]:
        """The groups of each window as text."""
        # a window's id tuples, packed, are its key
        packed_a, packed_b = ids_a.tobytes(), ids_b.tobytes()
        stop_a, stop_b = (4 * (last_a[cuts] + 1)).tolist(), (4 * (last_b[cuts] + 1)).tolist()
        keys = [
            (packed_a[p:r], packed_b[q:s]) for p, r, q, s in zip([0, *stop_a[:-1]], stop_a, [0, *stop_b[:-1]], stop_b)
        ]
        found = [*map(self.windows.get, keys)]
        if None in found:
            self.fill(found, keys, ids_a.tolist(), ids_b.tolist(), last_a.tolist(), last_b.tolist(), cuts.tolist())
        return found

    def fill(self, found: list, keys: list, a: list, b: list, last_a: list, last_b: list, cuts: list) -> None:
        """Texts of the windows that are not remembered yet, from their groups' last tokens."""
        names, known = self.names.__getitem__, self.windows
        group = p = q = 0
        for n, cut in enumerate(cuts):
            if found[n] is None:
                parts, x, y = [], p, q
                for g in range(group, cut + 1):
                    end_a, end_b = last_a[g] + 1, last_b[g] + 1
                    parts.append(",".join(map(names, a[x:end_a])) + "|" + ",".join(map(names, b[y:end_b])))
                    x, y = end_a, end_b
                found[n] = ";".join(parts)
                if len(keys[n][0]) + len(keys[n][1]) <= 4 * LONGEST_REMEMBERED:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[keys[n]] = found[n]
            group, p, q = cut + 1, last_a[cut] + 1, last_b[cut] + 1


_ALIGNERS: dict[str, Aligner] = {}


def aligner_for(a_definition: bytes, b_model: bytes) -> Aligner:
    """One aligner per worker process and pair of tokenizers, on the worker's own core."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = hashlib.sha256(a_definition + b_model).hexdigest()
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(a_definition, b_model)
    return _ALIGNERS[key]


def _list_array(lists: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
    values = np.concatenate(lists) if lists else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int64)))


def align_documents(docs: DataFrame, a_path: str, b_path: str, with_groups: bool = True) -> DataFrame:
    """``ALIGNED_SCHEMA`` of every document: its groups, and its distinct links with how often each stands in it.

    ``row`` numbers the rows of one evaluation: write the result before relying on it.
    ``groups`` is null without ``with_groups``; its digest is there either way.
    """
    spark = prepare(docs.sparkSession)
    with open(a_path, "rb") as a, open(b_path, "rb") as b:
        files = spark.sparkContext.broadcast((a.read(), b.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_for(*files.value)
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(at, TOGETHER)
                found = aligner.align_all(batch.column("text").to_pylist())
                counted = [np.unique(f[4], return_counts=True) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row"),
                        batch.column("doc_id"),
                        *[pa.array([f[k] for f in found], pa.int64()) for k in range(3)],
                        pa.array([f[3] if with_groups else None for f in found], pa.string()),
                        pa.array([hashlib.sha256(f[3].encode()).hexdigest() if f[0] else "" for f in found], pa.string()),
                        _list_array([c[0] for c in counted]),
                        _list_array([c[1] for c in counted]),
                    ],
                    names=[c.split()[0] for c in ALIGNED_SCHEMA.split(", ")],
                )

    narrow = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    )
    return narrow.mapInArrow(run, ALIGNED_SCHEMA)


def link_counts(aligned: DataFrame) -> DataFrame:
    """``(pair, links, best)``: how many links hold each pair, and whether no other pair of its B id has more."""
    each = aligned.select(F.inline(F.arrays_zip("pairs", "times")))
    counts = written(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("links")), "links")
    b_id = F.col("pair").bitwiseAND(0xFFFFFFFF)
    most = counts.groupBy(b_id.alias("b_id")).agg(F.max("links").alias("most"))
    return counts.withColumn("b_id", b_id).join(most, "b_id").select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


def _looked_up(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """Results by a broadcast of the counted pairs, sorted by pair."""
    table = counts.toArrow()
    keys = table.column("pair").to_numpy()
    order = np.argsort(keys)
    model = aligned.sparkSession.sparkContext.broadcast(
        (keys[order], table.column("links").to_numpy()[order], table.column("best").to_numpy()[order])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, links, best = model.value
        for batch in batches:
            pairs, times = (batch.column(c).flatten().to_numpy() for c in ("pairs", "times"))
            ends = np.cumsum(batch.column("pairs").value_lengths().to_numpy())
            at = np.searchsorted(keys, pairs)

            def per_row(values: np.ndarray, ends=ends) -> pa.Array:
                sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[ends]
                return pa.array(np.diff(sums, prepend=0))

            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")],
                    per_row(times),
                    per_row(times * best[at]),
                    per_row(times * links[at]),
                    batch.column("groups_sha256"),
                ],
                names=[c.split()[0] for c in RESULT_SCHEMA.split(", ")],
            )

    return aligned.drop("row", "groups").mapInArrow(run, RESULT_SCHEMA)


def _joined(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """Results by a join on the pair; sums of each row are formed in the map tasks first."""
    each = aligned.select("row", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    sums = (
        each.join(counts, "pair")
        .groupBy("row")
        .agg(
            F.sum("times").alias("n_links"),
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
            F.sum(F.col("times") * F.col("links")).alias("count_sum"),
        )
    )
    filled = aligned.join(sums, "row", "left").fillna(0, ["n_links", "n_best", "count_sum"])
    return filled.select(*[c.split()[0] for c in RESULT_SCHEMA.split(", ")])


def alignment_counts(docs: DataFrame, a_path: str, b_path: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``RESULT_SCHEMA``: each document's tokens, groups and links, the links held against the whole corpus."""
    aligned = written(align_documents(docs, a_path, b_path, with_groups=False).drop("groups"), "aligned")
    counts = written(link_counts(aligned), "counts")
    small = counts.count() * PAIR_BYTES <= broadcast_bytes
    return _looked_up(aligned, counts) if small else _joined(aligned, counts)
