"""Synthetic corpora with a known share of duplicates, for tests and benchmarks."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.staging import ship_package

FOLDERS = 100


def corpus(
    spark: SparkSession,
    n: int = 100_000,
    dup_ratio: float = 0.2,
    min_size: int = 1024,
    max_size: int = 10 * 1024 * 1024,
    seed: int = 42,
) -> DataFrame:
    """``files(path, size, mtime, content)``: unique files and copies of some of them.

    Content follows from the number of its original, which it starts with, so copies need no
    join and two originals never coincide (``min_size`` must leave room for the number).
    """
    copies = int(n * dup_ratio)
    originals = n - copies
    if originals == 0:
        copies = 0
    drawn = f"pmod(xxhash64({seed}, id), {max(originals, 1)})"
    files = spark.range(originals + copies).selectExpr(
        "id",
        f"id >= {originals} as is_copy",
        f"if(id < {originals}, id, {drawn}) as original",
        f"pmod(xxhash64({seed + 1}, id), {FOLDERS}) + 1 as folder",
    )
    name = f"if(is_copy, concat('dup_', id - {originals}), concat('unique_', id))"
    return files.selectExpr(
        f"concat('/dir_', folder, '/', {name}, '.dat') as path",
        f"{min_size} + pmod(xxhash64({seed + 2}, original), {max_size - min_size + 1}) as size",
        "timestamp_seconds(1700000000 + pmod(xxhash64(id), 86400)) as mtime",
        "original",
    ).selectExpr(
        "path",
        "size",
        "mtime",
        "rpad(concat(lpad(cast(original as string), 12, '0'), ' '), cast(size as int), 'abcdefghijklmnopqrstuvwxyz') as content",
    )


def _write_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for target, content in zip(batch.column("target").to_pylist(), batch.column("content").to_pylist()):
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(target, "wb") as file:
                file.write(content)
        yield batch.select(["size"])


def write_tree(files: DataFrame, folder: str) -> int:
    """Write the files below ``folder``, which all executors mount; returns the bytes written."""
    rows = files.select(
        F.concat(F.lit(folder), "path").alias("target"), "size", F.col("content").cast("binary").alias("content")
    )
    ship_package(files.sparkSession)
    written = rows.mapInArrow(_write_batches, "size bigint")
    return written.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first().n
