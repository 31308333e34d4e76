"""Contiguous shards of near equal bytes, cut by global prefix sums.

Documents are laid end to end in one global order. Range partitions are totalled, the totals
are summed up over the partitions, and each row adds what lies before it in its own partition:
its first byte in the whole. The row goes to the shard in which that byte falls when the whole
is cut into equal parts, so shards are contiguous and differ by about one unit.

Equal texts stay together: a group of copies stands at the place of its smallest doc_id and is
one unit. A group that is larger than ``whole_share`` of a shard would upset the balance, so its
documents are units of their own, still side by side. Only keys, sizes and hashes move; texts
are read once and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsift.skew import number_rows
from twinsift.staging import shuffle_width, stage


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text plus 1 (its end); 1 for null."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def running_totals(units: DataFrame, order: list[str], sums: dict[str, str], slices: int | None = None) -> DataFrame:
    """``units`` with exclusive prefix sums over the global ``order``: ``{new column: summed column}``.

    Two passes: rows are range-partitioned once and written, as the limits are drawn anew by
    every evaluation; each slice is totalled, and the totals (one row per slice) are summed up.
    """
    spark = units.sparkSession
    slices = slices or shuffle_width(spark)
    placed = stage(units.repartitionByRange(slices, *order).withColumn("_slice", F.spark_partition_id()), "slices")
    totals = placed.groupBy("_slice").agg(*(F.sum(c).alias(f"_t_{new}") for new, c in sums.items()))
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_slice", *(F.coalesce(F.sum(f"_t_{new}").over(earlier), F.lit(0)).alias(f"_o_{new}") for new in sums))
    within = Window.partitionBy("_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumns({new: F.coalesce(F.sum(c).over(within), F.lit(0)) for new, c in sums.items()})
    # One row per slice: no more than the partitions asked for.
    joined = local.join(F.broadcast(offsets), "_slice")
    return joined.select(*units.columns, *((F.col(new) + F.col(f"_o_{new}")).cast("bigint").alias(new) for new in sums))


def shard(documents: DataFrame, n_shards: int = 8, text: str = "text", key: str = "doc_id", whole_share: float = 0.05) -> DataFrame:
    """``(key, size, text_crc32, shard, slot)`` for every document.

    ``slot`` counts the documents of a shard from 0 in the global order. Null texts have size 1
    and count as empty; null keys come first; rows with equal keys are separate documents. An
    empty table gives no rows; with fewer units than shards some shards stay empty.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = stage(
        documents.select(
            F.col(key).alias("key"), text_bytes(F.col(text)).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("hash")
        ),
        "sizes",
    )
    same_text = ["hash", "text_crc32", "size"]
    # Documents are told apart by (key, hash): rows equal in both are interchangeable.
    groups = rows.groupBy(*same_text).agg(F.min("key").alias("lead"), F.sum("size").alias("group_bytes"))
    total, n_rows = rows.agg(F.sum("size"), F.count("*")).first()
    if total is None:
        return rows.select("key", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"))
    whole = F.col("group_bytes") <= F.lit(total / n_shards * whole_share)
    member = rows.join(groups, same_text).withColumn("unit", F.when(whole, F.lit(None)).otherwise(F.col("key")))
    member = stage(member.select("key", *same_text, "lead", "unit"), "members")
    order = ["lead", "hash", "unit"]
    units = member.groupBy(*order).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    placed = running_totals(units, order, {"first_byte": "bytes", "first_row": "n"})
    cut = F.floor(F.col("first_byte").cast("decimal(38,0)") * n_shards / F.lit(total).cast("decimal(38,0)")).cast("int")
    placed = stage(placed.withColumn("shard", F.least(cut, F.lit(n_shards - 1))), "units")
    starts = placed.groupBy("shard").agg(F.min("first_row").alias("start"))
    placed = placed.join(F.broadcast(starts), "shard").select(
        *(F.col(c).alias(f"_{c}") for c in order), "shard", "first_row", "n", (F.col("first_row") - F.col("start")).alias("at")
    )
    of = F.col("hash").eqNullSafe(F.col("_hash")) & F.col("lead").eqNullSafe(F.col("_lead")) & F.col("unit").eqNullSafe(F.col("_unit"))
    found = member.join(placed, of).select("key", "size", "text_crc32", "shard", "first_row", "n", "at")
    # The rows of a unit, of which one may have a third of all, in order of their keys.
    counted = number_rows(found, ["first_row"], ["key"], "_in_unit", n_rows, "n")
    return counted.select("key", "size", "text_crc32", "shard", (F.col("at") + F.col("_in_unit") - 1).alias("slot"))


def sharded_documents(documents: DataFrame, n_shards: int = 8) -> DataFrame:
    """``shard`` under the law ``bytes``, with the columns of the query."""
    return shard(documents, n_shards).select(
        F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
