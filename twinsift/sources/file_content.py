"""Content of files that all executors reach, mounted or by URI, read in chunks where Spark runs the task.

Bytes never enter a row: a task streams each of its files and emits its fingerprint and
digest, or compares two files and emits whether they are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StructField, StructType

from twinsift.operators.exact import DIGEST_KEY, dup_size_candidates, group_rows
from twinsift.operators.ordering import keeper
from twinsift.skew import with_aggregates
from twinsift.sources.storage import open_bytes
from twinsift.staging import ship_package, shuffle_width, stage, stage_counted

CHUNK = 64 * 1024
#: Files that one task reads.
FILES_PER_TASK = 5_000
SEED = 42  # as Spark's xxhash64


def _hash_file(path: bytes) -> tuple[int | None, bytes | None]:
    """Fingerprint and digest; None for a file that cannot be read to its end."""
    import xxhash

    fingerprint, digest = xxhash.xxh64(seed=SEED), hashlib.sha256()
    try:
        with open_bytes(path) as file:
            while chunk := file.read(CHUNK):
                fingerprint.update(chunk)
                digest.update(chunk)
    except OSError:
        return None, None
    value = fingerprint.intdigest()
    return value - (1 << 64) if value >> 63 else value, digest.digest()


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashed = [_hash_file(path) for path in batch.column("_raw").to_pylist()]
        yield batch.append_column("fingerprint", pa.array([h[0] for h in hashed], pa.int64())).append_column(
            "digest", pa.array([h[1] for h in hashed], pa.binary())
        )


def _readable(path: bytes) -> bool:
    try:
        with open_bytes(path) as file:
            file.read(1)
        return True
    except OSError:
        return False


def _equal_files(a: bytes, b: bytes) -> tuple[bool, bool]:
    """Byte-by-byte equality that stops at the first chunk that differs, and whether ``a`` can be read.

    A file that cannot be read equals none; that its head can't be read says nothing about ``a``.
    """
    if a == b:
        return (True, True) if _readable(a) else (False, False)
    try:
        with open_bytes(a) as first, open_bytes(b) as second:
            while True:
                x, y = first.read(CHUNK), second.read(CHUNK)
                if x != y:
                    return False, True
                if not x:
                    return True, True
    except OSError:
        return False, _readable(a)


def _compare_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column("_raw").to_pylist(), batch.column("_head").to_pylist())
        same, readable = zip(*(_equal_files(a, b) for a, b in pairs)) if batch.num_rows else ((), ())
        yield batch.append_column("same", pa.array(same, pa.bool_())).append_column("readable", pa.array(readable, pa.bool_()))


def _spread(files: DataFrame, rows: int) -> DataFrame:
    """An even share of the files for each task; reading them is the work, not their rows."""
    tasks = max(shuffle_width(files.sparkSession), rows // FILES_PER_TASK + 1)
    return files.repartition(tasks, "path").withColumn("_raw", F.col("path").cast("binary"))


def hash_files(files: DataFrame, rows: int) -> DataFrame:
    """Adds ``fingerprint`` and ``digest`` of each file; files that cannot be read are left out."""
    ship_package(files.sparkSession)
    raw = _spread(files, rows)
    added = [StructField("fingerprint", LongType()), StructField("digest", BinaryType())]
    hashed = raw.mapInArrow(_hash_batches, StructType(raw.schema.fields + added))
    return hashed.where("fingerprint is not null").drop("_raw")


def exact_file_members(
    files: DataFrame, verify: str = "sha256", strategy: str | None = None, mtime: str = "mtime"
) -> DataFrame:
    """Members of the exact groups of a listing ``files(path, size, mtime)``; see ``exact_members``.

    Only files whose size repeats are read. ``verify="bytes"`` reads candidates a second time
    against the first file of their bucket.
    """
    if verify not in ("sha256", "bytes"):
        raise ValueError(f"verify must be 'sha256' or 'bytes', not {verify!r}")
    candidates, rows = stage_counted(dup_size_candidates(files).drop("n_files"), "candidates")
    keyed, total = stage_counted(hash_files(candidates, rows), "fingerprints")
    if verify == "bytes":
        keyed, total = _confirmed(keyed.drop("digest"), total)
        keys = ["head"]
    else:
        keys = DIGEST_KEY
    facts = {"group_id": F.min("path")}
    if strategy:
        facts["keeper"] = keeper(keyed, strategy, mtime)
    return group_rows(keyed, keys, facts, total)


def _confirmed(keyed: DataFrame, total: int) -> tuple[DataFrame, int]:
    """Rows with ``head``, a file of the same bytes: the first of the bucket or of what is left of it.

    Files that have become unreadable go at once, so rounds count the contents of a bucket only.
    """
    confirmed, rest, left = None, keyed, total
    while left:
        headed = with_aggregates(rest, ["size", "fingerprint"], {"head": F.min("path")}, left, "_n", "_n > 1")
        pairs = _spread(headed.drop("_n"), left).withColumn("_head", F.col("head").cast("binary"))
        schema = StructType(pairs.schema.fields + [StructField(c, BooleanType()) for c in ("same", "readable")])
        compared = stage(pairs.mapInArrow(_compare_batches, schema).drop("_raw", "_head"), "compared")
        same = compared.where("same").drop("same", "readable")
        confirmed = same if confirmed is None else confirmed.unionByName(same)
        rest, left = stage_counted(compared.where("not same and readable").drop("same", "readable", "head"), "unequal")
    return (keyed.withColumn("head", F.col("path")), 0) if confirmed is None else (confirmed, total)

