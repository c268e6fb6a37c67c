"""Per-file classification (op 16) and content windows (ops 22-26): row-wise, no shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import content as C
from ..functions import text as TX
from ..session import memo_columns


@dataclass(frozen=True)
class ContentOptions:
    max_chars: int | None = None
    head: int | None = None
    tail: int | None = None
    from_end: bool = False

    def __post_init__(self):
        # a field may also name a column holding per-root values (see render.render_by_options)
        if isinstance(self.head, int) and isinstance(self.tail, int):
            raise ValueError("choose only one of head and tail")
        if self.from_end is True and self.max_chars is None:
            raise ValueError("from_end requires max_chars")


def inspect_files(files: DataFrame, max_size: int = K.DEFAULT_MAX_SIZE, utf16: bool = True) -> DataFrame:
    """files -> inspected: adds kind in {text, binary, too_large, error}, text, meta, limit.

    The size gate comes first and only the first 8 KiB are looked at for
    signatures and control bytes; ``content`` is dropped from the output so later
    stages never carry the raw bytes.
    """
    df = files.filter(~F.col("is_dir"))
    text_mode = "text" in files.columns
    prefix, kind, text, meta, limit = memo_columns(("inspect", max_size, utf16, text_mode),
                                                   lambda: _inspect_columns(max_size, utf16, text_mode))
    # the 8 KiB detection prefix and its one-char-per-byte view are computed once per row
    df = (
        df.withColumn("__prefix", prefix)
        .withColumn("__latin", C.latin1(F.col("__prefix")))
        .withColumn("__sig", C.signature(F.col("__prefix")))
    )
    df = _once(df, kind, "__kind")
    keep = [c for c in df.columns if c not in ("content", "text", "kind", "__kind", "__prefix", "__latin", "__sig")]
    return df.select(*keep, F.col("__kind").alias("kind"), text.alias("text"), meta.alias("meta"), limit.alias("limit"))


def _once(df: DataFrame, expr, name: str) -> DataFrame:
    """Add ``expr`` as column ``name`` through a one-row generator.

    A later filter on ``name`` (e.g. kind = 'text') cannot be pushed below a
    generator that produces it, so the expression is evaluated once per row —
    pushed through a plain projection, the optimizer would substitute and
    evaluate the whole classification twice (in the filter and the projection).
    """
    return df.select("*", F.inline(F.array(F.struct(expr.alias(name)))))


def with_kind(files: DataFrame, max_size: int = K.DEFAULT_MAX_SIZE, utf16: bool = True) -> DataFrame:
    """files + ``kind`` only (all columns kept): row-wise, for selecting files by their class."""
    text_mode = "text" in files.columns
    prefix, kind = memo_columns(("inspect", max_size, utf16, text_mode), lambda: _inspect_columns(max_size, utf16, text_mode))[:2]
    df = (
        files.withColumn("__prefix", prefix)
        .withColumn("__latin", C.latin1(F.col("__prefix")))
        .withColumn("__sig", C.signature(F.col("__prefix")))
    )
    return _once(df, kind, "kind").drop("__prefix", "__latin", "__sig")


def _inspect_columns(max_size: int, utf16: bool, text_mode: bool):
    size = F.col("size")
    limit_c = F.col(max_size) if isinstance(max_size, str) else F.lit(max_size)  # per-root column or constant
    oversize = size > limit_c
    if text_mode:
        # table text: no UTF-16 BOM is possible in a string; encode only the detection prefix
        src = F.col("text")
        prefix_expr = F.substring(F.encode(F.substring(src, 1, K.DETECTION_BYTES), "UTF-8"), 1, K.DETECTION_BYTES)
        prefix = F.col("__prefix")
        binary_head = C.has_binary_signature(prefix, F.col("__sig")) | C.looks_binary(prefix, F.col("__latin"))
        kind = (
            F.when(F.col("error").isNotNull(), F.lit("error"))
            .when(oversize, F.lit("too_large"))
            .when(binary_head, F.lit("binary"))
            .when(F.is_valid_utf8(src), F.lit("text"))  # a linear check, no copy
            .otherwise(F.lit("binary"))
        )
        text = F.when(F.col("__kind") == "text", src)
    else:
        content = F.col("content")
        # a source that kept only the first bytes of a file: never take them for the whole text
        oversize = oversize | (F.octet_length(content) < size)
        prefix_expr = C.detection_prefix(content)
        prefix = F.col("__prefix")
        binary_head = C.has_binary_signature(prefix, F.col("__sig")) | C.looks_binary(prefix, F.col("__latin"))
        bom = C.has_utf16_bom(content)
        as_string = content.cast("string")
        u16 = C.utf16_text(content) if utf16 else F.lit(None).cast("string")
        kind = (
            F.when(F.col("error").isNotNull(), F.lit("error"))
            .when(oversize, F.lit("too_large"))
            .when(binary_head, F.lit("binary"))
            .when(bom & u16.isNotNull(), F.lit("text"))
            .when(F.is_valid_utf8(as_string), F.lit("text"))
            .otherwise(F.lit("binary"))
        )
        text = F.when(F.col("__kind") == "text", F.when(bom & u16.isNotNull(), u16).otherwise(as_string))
    meta = F.when(
        F.col("__kind").isin("binary", "too_large"),
        C.detect_metadata(F.element_at("path", -1), prefix, size, F.col("__sig")),
    )
    limit = F.when(F.col("__kind") == "too_large", limit_c.cast("bigint"))
    return prefix_expr, kind, text, meta, limit


def _opt(v):
    return F.col(v) if isinstance(v, str) else v


def windowed(text, opts: ContentOptions | None):
    opts = opts or ContentOptions()
    return TX.apply_window(text, _opt(opts.head), _opt(opts.tail), _opt(opts.max_chars), _opt(opts.from_end))


def with_shown(inspected: DataFrame, opts: ContentOptions | None = None) -> DataFrame:
    """Adds ``shown``: the windowed text for text files, else the marker (op 26)."""
    shown = memo_columns(
        ("shown", opts or ContentOptions()),
        lambda: C.marker_text(F.col("kind"), windowed(F.col("text"), opts), F.col("meta"), F.col("limit"), F.col("error")),
    )
    return inspected.withColumn("shown", shown)
