"""Per-file content inspection (ops 17-21, 26).

Order is semantic: size gate -> content signature / control bytes on the first
8 KiB -> UTF-16 with a byte-order mark -> strict UTF-8. All of it is JVM expressions;
strict UTF-16 is validated before ``decode`` (which raises on bad input).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .quantities import format_bytes

_CONTROL_CLASS = "[\\x01-\\x08\\x0B\\x0E-\\x1F\\x7F]"
_BOM_LE = bytearray(b"\xff\xfe")
_BOM_BE = bytearray(b"\xfe\xff")


def detection_prefix(content: Column) -> Column:
    """The first 8 KiB of the content (bytes)."""
    return F.substring(content, 1, K.DETECTION_BYTES)


def has_utf16_bom(content: Column) -> Column:
    head = F.substring(content, 1, 2)
    return (head == F.lit(_BOM_LE)) | (head == F.lit(_BOM_BE))


def latin1(prefix: Column) -> Column:
    """Bytes as a string with one char per byte."""
    return F.decode(prefix, "ISO-8859-1")


def control_byte_count(prefix: Column, chars: Column | None = None) -> Column:
    """Count of control bytes 01-08, 0B, 0E-1F, 7F (form feed, tab, CR, LF excluded)."""
    chars = latin1(prefix) if chars is None else chars
    return F.length(chars) - F.length(F.regexp_replace(chars, F.lit(_CONTROL_CLASS), F.lit("")))


def looks_binary(prefix: Column, chars: Column | None = None) -> Column:
    """Empty or BOM -> no; any NUL -> yes; else >= 3 control bytes and more than 1 %.

    ``chars``: the prefix already decoded by ``latin1`` (pass a column to decode once)."""
    chars = latin1(prefix) if chars is None else chars
    n = F.octet_length(prefix)
    ctrl = control_byte_count(prefix, chars)
    return (
        F.when((n == 0) | has_utf16_bom(prefix), F.lit(False))
        .when(F.instr(chars, "\u0000") > 0, F.lit(True))
        .otherwise((ctrl >= K.MIN_CONTROL_BYTES) & (ctrl * 100 > n * K.MAX_CONTROL_PERCENT))
    )


_HEAD_BYTES = 16  # signatures at offsets below this are checked on the hex of the first 16 bytes


def _sql_lit(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(v)


_CACHE: dict[str, Column] = {}


def _signature_maps() -> tuple[dict[int, dict[str, int]], list[tuple[int, list]]]:
    """Offset-0 single-part signatures by byte length -> {hex: first table index}; the rest listed."""
    by_len: dict[int, dict[str, int]] = {}
    others: list[tuple[int, list]] = []
    for i, (_name, parts, _mime, _ext) in enumerate(K.SIGNATURES):
        if len(parts) == 1 and parts[0][0] == 0:
            hexbytes = parts[0][1].upper()
            by_len.setdefault(len(hexbytes) // 2, {}).setdefault(hexbytes, i)
        else:
            others.append((i, parts))
    return by_len, others


def _signature_entries() -> Column:
    """Constant array<struct<mime, ext>> in table order (one SQL literal, cached)."""
    if "sig_entries" not in _CACHE:
        items = ", ".join(f"named_struct('mime', {_sql_lit(m)}, 'ext', {_sql_lit(e)})" for _n, _p, m, e in K.SIGNATURES)
        _CACHE["sig_entries"] = F.expr(f"array({items})")
    return _CACHE["sig_entries"]


def _signature_map(length: int, entries: dict[str, int]) -> Column:
    key = f"sig_map_{length}"
    if key not in _CACHE:
        pairs = ", ".join(f"{_sql_lit(h)}, {i}" for h, i in entries.items())
        _CACHE[key] = F.expr(f"map({pairs})")
    return _CACHE[key]


def signature(prefix: Column) -> Column:
    """struct(mime, ext) of the first matching content signature (table order), else null.

    Compiled expressions only: one literal-map lookup per magic length on the hex
    of the first bytes, plain comparisons for the few multi-part / offset
    signatures, and the earliest table index wins (``array_min`` skips nulls).
    """
    head = F.hex(F.substring(prefix, 1, _HEAD_BYTES))
    by_len, others = _signature_maps()
    cands = [F.element_at(_signature_map(n, m), F.substr(head, F.lit(1), F.lit(2 * n))) for n, m in sorted(by_len.items())]
    for i, parts in others:
        cond = None
        for offset, hexbytes in parts:
            magic = bytes.fromhex(hexbytes)
            c = F.substring(prefix, offset + 1, len(magic)) == F.lit(bytearray(magic))
            cond = c if cond is None else cond & c
        cands.append(F.when(cond, F.lit(i)))
    idx = F.array_min(F.array(*cands))
    entry = F.element_at(_signature_entries(), idx + 1)
    return F.when(idx.isNotNull(), F.struct(entry["mime"].alias("mime"), entry["ext"].alias("ext")))


def is_textual_mime(mime: Column) -> Column:
    return (
        mime.startswith("text/")
        | mime.isin(K.TEXTUAL_MIMES)
        | mime.endswith("+json")
        | mime.endswith("+xml")
    )


def has_binary_signature(prefix: Column, sig: Column | None = None) -> Column:
    sig = signature(prefix) if sig is None else sig
    return F.coalesce(sig.isNotNull() & ~is_textual_mime(sig["mime"]), F.lit(False))


def file_extension(name: Column) -> Column:
    """Text after the last '.', when the name has a '.' after its first character; else null."""
    ext = F.regexp_extract(name, r"^.+\.([^.]*)$", 1)
    return F.when(ext != "", ext)


def _extension_map() -> Column:
    if "ext" not in _CACHE:
        pairs = ", ".join(f"{_sql_lit(e)}, {_sql_lit(m)}" for e, m in K.EXTENSION_MIMES)
        _CACHE["ext"] = F.expr(f"map({pairs})")
    return _CACHE["ext"]


def detect_metadata(name: Column, prefix: Column, size: Column, sig: Column | None = None) -> Column:
    """struct(size, mime_type, extension, detected_by): signature, else extension, else fallback."""
    sig = signature(prefix) if sig is None else sig
    ext = F.lower(file_extension(name))
    by_ext = F.element_at(_extension_map(), ext)
    return (
        F.when(
            sig.isNotNull(),
            F.struct(
                size.cast("bigint").alias("size"),
                sig["mime"].alias("mime_type"),
                sig["ext"].alias("extension"),
                F.lit(K.DETECTED_BY_CONTENT).alias("detected_by"),
            ),
        )
        .when(
            by_ext.isNotNull(),
            F.struct(
                size.cast("bigint").alias("size"),
                by_ext.alias("mime_type"),
                ext.alias("extension"),
                F.lit(K.DETECTED_BY_EXTENSION).alias("detected_by"),
            ),
        )
        .otherwise(
            F.struct(
                size.cast("bigint").alias("size"),
                F.lit(K.FALLBACK_MIME).alias("mime_type"),
                F.lit(None).cast("string").alias("extension"),
                F.lit(K.DETECTED_BY_FALLBACK).alias("detected_by"),
            )
        )
    )


def format_metadata(meta: Column) -> Column:
    """'MIME: …; detected by: …; size: …[; detected extension: …]'."""
    return F.concat_ws(
        "; ",
        F.concat(F.lit("MIME: "), meta["mime_type"]),
        F.concat(F.lit("detected by: "), meta["detected_by"]),
        F.concat(F.lit("size: "), format_bytes(meta["size"])),
        F.concat(F.lit("detected extension: "), meta["extension"]),
    )


def utf16_text(content: Column) -> Column:
    """Strict UTF-16 text behind a byte-order mark, else null (odd body or unpaired surrogate).

    JVM-only: each code unit's high byte marks it H (D8-DB), L (DC-DF) or '.';
    after removing adjacent 'HL' pairs no H or L may remain. Only then is the
    body decoded, so ``decode`` never meets malformed input. Evaluated inside the
    BOM branch of a CASE, so rows without a BOM pay nothing.
    """
    le = F.substring(content, 1, 2) == F.lit(_BOM_LE)
    body = F.substr(content, F.lit(3), F.octet_length(content))
    hx = F.hex(body)
    units = (F.octet_length(content) - 2) / 2
    hi_pos = F.when(le, F.lit(3)).otherwise(F.lit(1))

    def cls(i):
        hb = F.substr(hx, i * 4 + hi_pos, F.lit(2))
        return F.when((hb >= "D8") & (hb <= "DB"), "H").when((hb >= "DC") & (hb <= "DF"), "L").otherwise(".")

    marks = F.array_join(F.transform(F.sequence(F.lit(0), units.cast("int") - 1), cls), "")
    left = F.replace(marks, F.lit("HL"), F.lit(""))
    ok = (F.octet_length(content) % 2 == 0) & ~left.contains("H") & ~left.contains("L")
    text = F.when(le, F.decode(body, "UTF-16LE")).otherwise(F.decode(body, "UTF-16BE"))
    return F.when(has_utf16_bom(content) & ok, text)


def marker_text(kind: Column, text: Column, meta: Column, limit: Column, error: Column) -> Column:
    """Text of a text file, else the binary / too large / error marker (op 26)."""
    return (
        F.when(kind == "text", text)
        .when(kind == "binary", F.concat(F.lit("[Binary file not shown; "), format_metadata(meta), F.lit("]")))
        .when(
            kind == "too_large",
            F.concat(
                F.lit("[File too large; "), format_metadata(meta), F.lit("; limit: "), format_bytes(limit), F.lit("]")
            ),
        )
        .otherwise(F.concat(F.lit("[Error reading file: "), F.coalesce(error, F.lit("unknown error")), F.lit("]")))
    )
