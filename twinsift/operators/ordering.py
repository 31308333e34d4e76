"""Which member of a group is kept, as an aggregate instead of a sort of the group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.functions.paths import component_key

# Names of the keep strategies.
STRATEGIES = ["oldest", "newest", "alpha-first"]


def keeper(df: DataFrame, strategy: str = "oldest", mtime: str = "mtime", path: str = "path") -> Column:
    """Aggregate expression for the member to keep: a struct whose field ``path`` names it.

    ``oldest`` and ``newest`` go by time and break ties by path; ``alpha-first`` goes by
    path only. Paths compare component by component. A minimum over a struct combines
    map-side, so a group of any size costs one row per task.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}, expected one of {STRATEGIES}")
    by_path = [component_key(F.col(path)).alias("component_key"), F.col(path).alias("path")]
    if strategy == "oldest":
        first = [F.col(mtime).alias("at"), *by_path]
    elif strategy == "newest":
        first = [_descending(df, mtime).alias("at"), *by_path]
    else:
        first = by_path
    return F.min(F.struct(*first))


def _descending(df: DataFrame, mtime: str) -> Column:
    """A value that falls as the time rises."""
    kind = df.schema[mtime].dataType.typeName()
    if kind == "timestamp_ntz":
        return F.expr("timestamp_ntz'1970-01-01 00:00:00'") - F.col(mtime)
    if kind == "timestamp":
        return -F.unix_micros(mtime)
    return -F.col(mtime)
