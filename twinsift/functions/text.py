"""Human-readable byte counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit names, each 1024 times the one before.
UNITS = ["B", "KB", "MB", "GB", "TB", "PB"]


def format_bytes(size: Column) -> Column:
    """``0 B``, ``1023 B``, ``1.50 KB`` ... up to PB, two decimals, ties to even.

    Rounded in integers: ``format_string`` would round ties up and 1152 bytes would
    become 1.13 KB instead of 1.12 KB.
    """
    size = size.cast("double").cast("bigint")
    text = F.concat(size.cast("string"), F.lit(" " + UNITS[0]))
    for power in range(1, len(UNITS)):
        unit = F.lit(1024**power).cast("bigint")
        text = F.when(size >= unit, _two_decimals(size, unit, UNITS[power])).otherwise(text)
    return text


def _two_decimals(size: Column, unit: Column, name: str) -> Column:
    scaled = (size % unit) * 100
    floor = _div(scaled, unit)
    rest = (scaled % unit) * 2
    up = (rest > unit) | ((rest == unit) & (floor % 2 == 1))
    cents = floor + F.when(up, F.lit(1)).otherwise(F.lit(0))
    whole = _div(size, unit) + _div(cents, F.lit(100))
    return F.concat(
        whole.cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"), F.lit(f" {name}")
    )


def _div(a: Column, b: Column) -> Column:
    """Exact integer division of non-negative numbers."""
    return F.call_function("div", a, b)
