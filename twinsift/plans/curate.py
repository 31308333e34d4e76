"""Carry a plan out on a corpus table, with a quarantine and undo.

The corpus is any table with a unique ``path``. Applying a plan splits it into the kept rows
and the quarantined ones; a manifest records which rows a batch moved, and undo puts the
newest batch back.

Only paths are joined. Where a list of them is too long to broadcast and the table is a scan of
files, the matching rows are named by their places, and the scan of the whole rows looks these
up (see ``row_vectors``); other tables are joined by path.

A batch in a folder is committed by its marker, which is written last: without one, neither its
rows nor its manifest are seen by any reader, and writing it again replaces what is there.
"""

from __future__ import annotations

import re
import time
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from twinsift.operators.row_vectors import marked, vectors_of, with_places
from twinsift.staging import broadcast_rows, small_side, stage_counted

BATCH_COLUMNS = ["batch_id", "row_key"]


@dataclass(frozen=True)
class Outcome:
    """Result of applying a plan. ``quarantined`` and ``manifest`` are None after a permanent one.

    ``n_deletes`` counts the paths that the plan deletes, those that are missing included.
    """

    kept: DataFrame
    removed: DataFrame
    missing: DataFrame
    quarantined: DataFrame | None = None
    manifest: DataFrame | None = None
    batch_id: str | None = None
    n_deletes: int = 0


@dataclass(frozen=True)
class Written:
    """Outcome of writing a batch: all of it or nothing.

    ``failed`` has the paths that should have moved and did not, ``reason`` says why; a batch
    without any deletes is a success that leaves no trace.
    """

    success: bool
    n_rows: int = 0
    failed: DataFrame | None = None
    reason: str | None = None


@dataclass(frozen=True)
class Restored:
    corpus: DataFrame
    quarantine: DataFrame
    manifest: DataFrame
    batch_id: str


def new_batch() -> tuple[str, int]:
    """Batch id and timestamp (nanoseconds) for a batch that starts now."""
    ts = time.time_ns()
    return f"batch_{ts}_{uuid.uuid4().hex[:8]}", ts


def apply_plan(
    corpus: DataFrame,
    plan: DataFrame,
    permanent: bool = False,
    batch_id: str | None = None,
    ts: int | None = None,
) -> Outcome:
    """Split ``corpus`` by the plan's deletes.

    Paths the corpus lacks are no failure; they are returned as ``missing``.
    """
    if batch_id is None:
        batch_id, now = new_batch()
        ts = now if ts is None else ts
    deletes, n_deletes = stage_counted(plan.where("action = 'delete'").select("path").distinct(), "deletes")
    kept, removed, found = _split(corpus, deletes, n_deletes)
    missing = deletes.join(found, "path", "left_anti")
    if permanent:
        return Outcome(kept, removed, missing, n_deletes=n_deletes)
    quarantined = removed.select(
        F.lit(batch_id).alias("batch_id"), row_key(batch_id).alias("row_key"), *corpus.columns
    )
    manifest = found.select(
        F.lit(batch_id).alias("batch_id"),
        F.lit(ts).cast("bigint").alias("ts"),
        row_key(batch_id).alias("row_key"),
        "path",
    )
    return Outcome(kept, removed, missing, quarantined, manifest, batch_id, n_deletes)


def _split(table: DataFrame, paths: DataFrame, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of ``table`` whose path is not listed, rows whose path is, and the paths of these."""
    if n > broadcast_rows(table.sparkSession) and (placed := with_places(table)) is not None:
        found, _ = stage_counted(placed.select("path", "_file", "_row").join(paths, "path"), "found")
        rows = marked(table, *vectors_of(found))
        return rows.where("not _named").drop("_named"), rows.where("_named").drop("_named"), found.select("path")
    listed = small_side(paths, n)
    removed = table.join(listed, "path", "left_semi")
    return table.join(listed, "path", "left_anti"), removed, removed.select("path")


def row_key(batch_id: str) -> Column:
    """Name of a row in the quarantine; the same on every run of the batch."""
    return F.sha2(F.concat_ws("|", F.lit(batch_id), F.col("path")), 256)


def last_batch(manifest: DataFrame) -> str | None:
    """The newest batch; of equal times the greatest id. Entries without id or time are ignored."""
    valid = manifest.where("batch_id is not null and ts is not null")
    return valid.agg(F.max(F.struct("ts", "batch_id"))["batch_id"].alias("b")).first().b


def undo_last(corpus: DataFrame, quarantine: DataFrame, manifest: DataFrame) -> Restored | None:
    """Put the newest batch back, replacing rows that took its paths; None if there is no batch."""
    batch = last_batch(manifest)
    if batch is None:
        return None
    mine = F.col("batch_id") == batch
    entries, n_entries = stage_counted(manifest.where(mine).select("row_key", F.col("path").alias("_path")), "entries")
    restored = _named_rows(quarantine.where(mine), entries, n_entries).select(*corpus.columns)
    paths, n_paths = stage_counted(restored.select("path").distinct(), "restored")
    untouched, _, _ = _split(corpus, paths, n_paths)
    return Restored(
        untouched.unionByName(restored), quarantine.where(~mine), manifest.where(~mine), batch
    )


def _named_rows(rows: DataFrame, entries: DataFrame, n: int) -> DataFrame:
    """The quarantined rows that the manifest's entries name, under the entries' paths."""
    if n > broadcast_rows(rows.sparkSession) and (placed := with_places(rows)) is not None:
        other = Observation()
        found = placed.select("row_key", "path", "_file", "_row").join(entries, "row_key")
        found, _ = stage_counted(found.observe(other, F.count_if(F.expr("path <> _path")).alias("n")), "found")
        if other.get["n"] == 0:  # as a row's key is made of its path
            return marked(rows, *vectors_of(found)).where("_named")
    return rows.join(small_side(entries, n), "row_key").withColumn("path", F.col("_path"))


def write_batch(outcome: Outcome, folder: str) -> Written:
    """Write a batch below ``folder``: its rows, then its manifest, then the marker that commits it."""
    if outcome.manifest is None:
        raise ValueError("a permanent removal leaves no batch to write")
    if not re.fullmatch(r"[\w.-]+", outcome.batch_id, re.ASCII):
        raise ValueError(f"not fit for the name of a folder: {outcome.batch_id!r}")
    if outcome.n_deletes == 0:
        return Written(True)
    rows, entries = Observation(), Observation()
    count = F.count(F.lit(1)).alias("n")
    try:
        for part, table, seen in (("quarantine", outcome.quarantined, rows), ("manifest", outcome.manifest, entries)):
            table.drop("batch_id").observe(seen, count).write.mode("overwrite").parquet(_place(folder, part, outcome.batch_id))
        n = rows.get["n"]
        if n != entries.get["n"]:
            raise ValueError(f"{n} rows, but {entries.get['n']} entries in the manifest")
        spark = outcome.manifest.sparkSession
        marker = spark.createDataFrame([(n,)], "n_rows bigint").coalesce(1)
        marker.write.mode("overwrite").parquet(_place(folder, "committed", outcome.batch_id))
    except (PySparkException, Py4JJavaError, ValueError) as error:
        return Written(False, 0, outcome.manifest.select("path"), str(error).splitlines()[0])
    return Written(True, n)


def _place(folder: str, part: str, batch_id: str) -> str:
    return f"{folder}/{part}/batch_id={batch_id}"


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """``(n_rows, batch_id)`` of the batches whose writing came to its end."""
    schema = "n_rows bigint, batch_id string"
    try:
        return spark.read.schema(schema).parquet(f"{folder}/committed")
    except AnalysisException:  # no batch yet
        return spark.createDataFrame([], schema)


def read_batches(spark: SparkSession, folder: str, corpus_schema) -> tuple[DataFrame, DataFrame]:
    """``(quarantine, manifest)`` of all committed batches in ``folder``."""
    batches, n = stage_counted(committed(spark, folder).select("batch_id"), "committed")
    if n == 0:
        empty = spark.createDataFrame([], corpus_schema).selectExpr("'' as batch_id", "'' as row_key", "*")
        return empty, spark.createDataFrame([], "batch_id string, ts bigint, row_key string, path string")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in corpus_schema)
    quarantine = spark.read.schema(f"row_key string, {columns}, batch_id string").parquet(f"{folder}/quarantine")
    manifest = spark.read.schema("ts bigint, row_key string, path string, batch_id string").parquet(f"{folder}/manifest")
    if n > broadcast_rows(spark):
        return quarantine.join(batches, "batch_id", "left_semi"), manifest.join(batches, "batch_id", "left_semi")
    done = F.col("batch_id").isin([row.batch_id for row in batches.collect()])  # leaves out folders, and keeps places
    return quarantine.where(done), manifest.where(done)


def forget_batch(spark: SparkSession, folder: str, batch_id: str) -> None:
    """Remove a batch from ``folder`` once its rows are back: the marker first, so that no part is seen alone."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for part in ("committed", "manifest", "quarantine"):
        path = jvm.org.apache.hadoop.fs.Path(_place(folder, part, batch_id))
        path.getFileSystem(conf).delete(path, True)
