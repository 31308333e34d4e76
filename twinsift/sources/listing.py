"""Inventory of a directory tree on a file system that all executors reach: mounted, or by its URI.

Spark's own file sources leave out names that begin with ``.`` or ``_`` and follow links, so
the tree is listed level by level instead: each level is a table of directories, listed in
parallel. Names are read first and sizes and times in a second pass over all files, so one
directory with very many files does not hold up a single task with its ``stat`` calls.
Paths travel as bytes, since file names need not be valid text.

Trees that no one mounts (``s3://...``, ``hdfs://...``) are listed the same way through pyarrow's
file systems, where Spark runs the tasks; their paths keep the form of URIs. Such stores have no
links, and a name that is no file or folder is skipped as not regular.
"""

from __future__ import annotations

import os
import stat as modes
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.sources import storage
from twinsift.staging import ship_package, shuffle_width, stage

# Why an item was skipped.
BAD_ROOT = "Root is not a valid directory"
ITERATION_ERROR = "Iteration error"
UNREADABLE_ITEM = "Skipped unreadable item"
LINK = "Skipped symlink or inaccessible"
NOT_REGULAR = "Skipped non-regular file"
UNREADABLE_SIZE = "Skipped unreadable size"

ENTRY_SCHEMA = "path binary, kind string"
STAT_SCHEMA = "path binary, size bigint, mtime_ns bigint, reason string"
BATCH = 4096
#: Files whose size and time one task reads.
FILES_PER_TASK = 20_000


@dataclass(frozen=True)
class Listing:
    """``files(path, size, mtime, mtime_ns)``, ``skipped(path, reason)`` and one row of ``stats``."""

    files: DataFrame
    skipped: DataFrame
    stats: DataFrame


def _kind(entry: os.DirEntry) -> str:
    """``enter`` or ``dir`` (a linked directory), ``file``, or the reason to skip the entry."""
    try:
        if entry.is_dir():
            return "dir" if entry.is_symlink() else "enter"
        if entry.is_symlink():
            return LINK if os.path.exists(entry.path) else UNREADABLE_ITEM
        return "file" if entry.is_file(follow_symlinks=False) else NOT_REGULAR
    except OSError:
        return UNREADABLE_ITEM


def _entries(folder: bytes) -> Iterator[tuple[bytes, str]]:
    try:
        with os.scandir(folder) as found:
            for entry in found:
                yield entry.path, _kind(entry)
    except PermissionError:
        return
    except OSError as error:
        yield folder, f"{ITERATION_ERROR}: {error.strerror}"


def _store_entries(folder: bytes) -> Iterator[tuple[bytes, str]]:
    """The same in a store that is reached by URI."""
    uri = folder.decode()
    try:
        store, path = storage.located(uri)
        found = store.get_file_info(fs.FileSelector(path, recursive=False))
    except PermissionError:
        return
    except OSError as error:
        yield folder, f"{ITERATION_ERROR}: {error.strerror or error}"
        return
    kinds = {fs.FileType.Directory: "enter", fs.FileType.File: "file"}
    for info in found:
        yield storage.joined(uri, info.base_name).encode(), kinds.get(info.type, NOT_REGULAR)


def _list_folders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows: list[tuple[bytes, str]] = []
    for batch in batches:
        for folder in batch["path"]:
            folder = bytes(folder)
            for row in (_store_entries if storage.is_uri(folder) else _entries)(folder):
                rows.append(row)
                if len(rows) == BATCH:
                    yield pd.DataFrame(rows, columns=["path", "kind"])
                    rows = []
    if rows:
        yield pd.DataFrame(rows, columns=["path", "kind"])


def _stat(path: bytes) -> tuple[int | None, int | None, str | None]:
    if storage.is_uri(path):
        return _store_stat(path.decode())
    try:
        found = os.lstat(path)
    except OSError:
        return None, None, UNREADABLE_SIZE
    if not modes.S_ISREG(found.st_mode):
        return None, None, NOT_REGULAR
    return found.st_size, found.st_mtime_ns, None


def _store_stat(uri: str) -> tuple[int | None, int | None, str | None]:
    try:
        store, path = storage.located(uri)
        info = store.get_file_info(path)
    except OSError:
        return None, None, UNREADABLE_SIZE
    if info.type != fs.FileType.File:
        return None, None, NOT_REGULAR if info.type == fs.FileType.Directory else UNREADABLE_SIZE
    return info.size, info.mtime_ns, None


def _stat_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        facts = [_stat(path) for path in batch.column("path").to_pylist()]
        # Integers all the way: times in nanoseconds do not fit in a double.
        columns = [pa.array([fact[i] for fact in facts], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string()))]
        yield pa.RecordBatch.from_arrays([batch.column("path"), *columns], ["path", "size", "mtime_ns", "reason"])


def is_tree(root: str) -> bool:
    """Whether ``root`` is a folder that can be listed."""
    if not storage.is_uri(root):
        return os.path.isdir(root)
    try:
        store, path = storage.located(root.rstrip("/"))
        return store.get_file_info(path).type == fs.FileType.Directory
    except (OSError, ValueError):  # ValueError: no such kind of store
        return False


def list_tree(spark: SparkSession, root: str, min_size: int = 0) -> Listing:
    """List ``root``, whose spelling is made plain; files smaller than ``min_size`` are left out of files, bytes and skipped alike.

    A root with a scheme, as in ``s3://bucket/folder``, is listed through pyarrow's file systems.
    """
    started = time.monotonic()
    root = root.rstrip("/") if storage.is_uri(root) else os.path.abspath(root)
    ship_package(spark)
    if not is_tree(root):
        return _no_tree(spark, root)
    width = shuffle_width(spark)
    frontier = spark.createDataFrame([(os.fsencode(root),)], "path binary")
    levels: list[DataFrame] = []
    while True:
        level = stage(frontier.repartition(width, "path").mapInPandas(_list_folders, ENTRY_SCHEMA), "level")
        levels.append(level)
        frontier = level.where("kind = 'enter'").select("path")
        if frontier.isEmpty():
            break
    entries = levels[0]
    for level in levels[1:]:
        entries = entries.unionByName(level)

    names = entries.where("kind = 'file'").select("path")
    tasks = max(width, names.count() // FILES_PER_TASK + 1)
    facts = stage(names.repartition(tasks, "path").mapInArrow(_stat_files, STAT_SCHEMA), "stat")
    elapsed = int((time.monotonic() - started) * 1000)

    kept = facts.where(F.col("reason").isNull() & (F.col("size") >= min_size))
    files = kept.select(
        F.col("path").cast("string").alias("path"), "size", F.expr("timestamp_micros((mtime_ns - pmod(mtime_ns, 1000)) div 1000)").alias("mtime"), "mtime_ns"
    )
    not_listed = entries.where("kind not in ('enter', 'dir', 'file')").select("path", F.col("kind").alias("reason"))
    skipped = not_listed.unionByName(facts.where("reason is not null").select("path", "reason")).select(
        F.col("path").cast("string").alias("path"), "reason"
    )
    counted = (
        entries.where("kind in ('enter', 'dir')").selectExpr("1 as folder", "0 as skip", "0 as file", "0L as bytes")
        .unionByName(skipped.selectExpr("0 as folder", "1 as skip", "0 as file", "0L as bytes"))
        .unionByName(kept.selectExpr("0 as folder", "0 as skip", "1 as file", "size as bytes"))
    )
    stats = counted.agg(
        _sum("file").alias("files_visited"),
        _sum("bytes").alias("bytes_visited"),
        (_sum("folder") + 1).alias("directories_visited"),
        _sum("skip").alias("items_skipped"),
        F.lit(elapsed).cast("bigint").alias("duration_ms"),
    )
    return Listing(files, skipped, stats)


def _sum(name: str):
    return F.coalesce(F.sum(name), F.lit(0)).cast("bigint")


def _no_tree(spark: SparkSession, root: str) -> Listing:
    files = spark.createDataFrame([], "path string, size bigint, mtime timestamp, mtime_ns bigint")
    skipped = spark.createDataFrame([(root, BAD_ROOT)], "path string, reason string")
    stats = spark.createDataFrame(
        [(0, 0, 0, 1, 0)],
        "files_visited bigint, bytes_visited bigint, directories_visited bigint, items_skipped bigint, duration_ms bigint",
    )
    return Listing(files, skipped, stats)

