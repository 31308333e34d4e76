"""Expressions over 64-bit image hashes held as BIGINT (only the bits matter, not the sign)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def similarity_percent(distance: Column) -> Column:
    """``100 - distance * 100 / 64`` in integers."""
    return (F.lit(100) - F.call_function("div", distance * 100, F.lit(64))).cast("int")


def hash_hex(bits: Column) -> Column:
    """The 64 bits as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(bits), 16, "0"))
