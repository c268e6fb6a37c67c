"""Human-readable counts and sizes (op 27).

``format_number`` rounds half-even, like the one-decimal float formatting the
snapshot format uses (1280 bytes -> ``1.2 KB``); ``format_string('%.1f')`` would
round half-up and is not used.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Size units above bytes, in order.
SIZE_UNITS = ["KB", "MB", "GB", "TB"]


def format_count(n: Column) -> Column:
    """1234567 -> '1,234,567'."""
    return F.format_number(n.cast("bigint"), 0)


def format_bytes(n: Column) -> Column:
    """'1 byte', '1,234 bytes'."""
    return F.concat(format_count(n), F.when(n == 1, F.lit(" byte")).otherwise(F.lit(" bytes")))


def format_size(n: Column) -> Column:
    """Below 1 KiB as bytes; else one decimal in KB..TB plus the exact byte count."""
    n = n.cast("bigint")
    scaled = None
    for i, unit in enumerate(SIZE_UNITS):
        power = 1024 ** (i + 1)
        value = F.regexp_replace(F.format_number(n.cast("double") / F.lit(float(power)), 1), ",", "")
        label = F.concat(value, F.lit(f" {unit}"))
        bound = n < F.lit(power * 1024)
        if scaled is None:
            scaled = F.when(bound, label)
        elif i < len(SIZE_UNITS) - 1:
            scaled = scaled.when(bound, label)
        else:
            scaled = scaled.otherwise(label)
    return (
        F.when(n < 1024, format_bytes(n))
        .otherwise(F.concat(scaled, F.lit(" ("), format_count(n), F.lit(" bytes)")))
    )
