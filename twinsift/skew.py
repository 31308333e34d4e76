"""Joins and ranks that stay balanced when one group holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsift.staging import broadcast_rows, hot_rows, shuffle_width, small_side, stage

def join_groups(
    rows: DataFrame, groups: DataFrame, keys: Sequence[str], size: str, total: int
) -> DataFrame:
    """Inner join of ``rows`` to ``groups``, which has one row per key.

    ``size`` is the column of ``groups`` with the number of rows of that key and ``total``
    the number of rows. When no key can be hot this is a plain join. Otherwise rows of hot
    keys are matched where they lie: the hot part of ``groups`` has at most total / hotRows
    rows, as the sizes add up to ``total``, and is broadcast if these are few; only the rows of
    the other keys are shuffled. More hot keys than may be broadcast are joined by shuffle,
    where Spark splits partitions that are too large.
    """
    keys = list(keys)
    if total <= hot_rows(rows.sparkSession):
        return rows.join(groups, keys)
    limit = hot_rows(rows.sparkSession)
    groups = stage(groups, "groups")
    if total // limit > broadcast_rows(rows.sparkSession):
        return rows.join(groups, keys)
    hot = groups.where(F.col(size) > limit)
    cold = groups.where(F.col(size) <= limit)
    in_place = rows.join(F.broadcast(hot), keys)
    shuffled = rows.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(cold, keys)
    return in_place.unionByName(shuffled)


def with_aggregates(
    rows: DataFrame,
    keys: Sequence[str],
    aggregates: dict[str, Column],
    total: int,
    size: str = "_rows",
    having: str = "true",
) -> DataFrame:
    """``rows`` with aggregates of their group attached, and the group's row count as ``size``.

    Only groups that satisfy ``having``, an SQL condition on these, are kept. If all rows together may sit in one task, a window does it with a single shuffle.
    Otherwise groups are aggregated, with map-side combining, and joined back by
    ``join_groups``.
    """
    keys = list(keys)
    if total <= hot_rows(rows.sparkSession):
        group = Window.partitionBy(*keys)
        attached = {name: value.over(group) for name, value in aggregates.items()}
        return rows.withColumns({**attached, size: F.count("*").over(group)}).where(having)
    named = [value.alias(name) for name, value in aggregates.items()]
    groups = rows.groupBy(*keys).agg(*named, F.count("*").alias(size)).where(having)
    joined = join_groups(rows, groups, keys, size, total)
    return joined.select(*rows.columns, *aggregates, size)


def number_rows(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    out: str,
    total: int,
    size: str | None = None,
) -> DataFrame:
    """Exact ``row_number() over (partition by keys order by order)`` as BIGINT column ``out``.

    Groups small enough for one task use a window. Larger ones, including the whole table
    when ``keys`` is empty, are range-partitioned, so that one group spreads over many tasks:
    each slice is numbered by itself and shifted by the rows of its group in earlier slices.
    ``size`` names a column with the size of the row's group, if there is one.
    """
    keys, order = list(keys), list(order)
    windowed = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")
    if total <= hot_rows(rows.sparkSession):
        return rows.withColumn(out, windowed)
    if not keys or size is None:
        return _number_by_range(rows, keys, order, out, total)
    limit = hot_rows(rows.sparkSession)
    cold = rows.where(F.col(size) <= limit).withColumn(out, windowed)
    hot = _number_by_range(rows.where(F.col(size) > limit), keys, order, out, total)
    return cold.unionByName(hot)


def _number_by_range(
    rows: DataFrame, keys: list[str], order: list[str], out: str, total: int
) -> DataFrame:
    spark = rows.sparkSession
    slices = max(shuffle_width(spark), total // hot_rows(spark) + 1)
    # Written once, because the range bounds are sampled anew by every evaluation.
    placed = stage(
        rows.repartitionByRange(slices, *keys, *order).withColumn("_slice", F.spark_partition_id()),
        "slices",
    )
    earlier = (
        Window.partitionBy(*keys)
        .orderBy("_slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # Only the first group of a slice can have begun in an earlier one: at most one row per slice.
    shifts = (
        placed.groupBy("_slice", *keys)
        .agg(F.count("*").alias("_n"))
        .withColumn("_shift", F.sum("_n").over(earlier))
        .where("_shift > 0")
        .drop("_n")
    )
    local = Window.partitionBy("_slice", *keys).orderBy(*order)
    return (
        placed.withColumn("_local", F.row_number().over(local))
        .join(small_side(shifts, slices), ["_slice", *keys], "left")
        .withColumn(out, (F.col("_local") + F.coalesce("_shift", F.lit(0))).cast("bigint"))
        .select(*rows.columns, out)
    )
