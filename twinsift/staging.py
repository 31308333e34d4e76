"""Session settings and staged tables.

A staged table is an intermediate result written once as Parquet and read back. It
is used where a result feeds more than one later step (so that the corpus is scanned
once) or where an iterative loop must cut its lineage. Staged tables live in the shared
folder that ``spark.checkpoint.dir`` names, so they survive the loss of executors.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Default for ``spark.twinsift.hotRows``: groups up to this many rows may sit in one task.
HOT_ROWS = 1_000_000

#: Default for ``spark.twinsift.hotPairs``: pairs one Hamming bucket may compare in one task.
HOT_PAIRS = 50_000_000

#: Default for ``spark.twinsift.broadcastRows``: key lists up to this length may be broadcast.
BROADCAST_ROWS = 200_000

_local_dirs: dict[str, str] = {}
_staged: dict[str, list[str]] = {}
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_shipped: set[str] = set()


def setting(spark: SparkSession, name: str, default: int) -> int:
    """Integer setting ``spark.twinsift.<name>``."""
    return int(spark.conf.get(f"spark.twinsift.{name}", str(default)))


def hot_rows(spark: SparkSession) -> int:
    return setting(spark, "hotRows", HOT_ROWS)


def hot_pairs(spark: SparkSession) -> int:
    return setting(spark, "hotPairs", HOT_PAIRS)


def broadcast_rows(spark: SparkSession) -> int:
    return setting(spark, "broadcastRows", BROADCAST_ROWS)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors of the session, once: Python functions of queries need it there."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    own = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="twinsift-package-"), "twinsift.zip")
    with zipfile.ZipFile(target, "w") as packed:
        for folder, _, names in os.walk(own):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    packed.write(path, os.path.relpath(path, os.path.dirname(own)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def scratch_dir(spark: SparkSession) -> str:
    """Folder for staged tables: the session's ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it gets a temporary folder. On a
    cluster a folder of one machine would be invisible to the others, so that is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/") + "/twinsift"
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.conf.get("spark.app.id", "local")
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="twinsift-")
    return _local_dirs[app]


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a DataFrame that reads the written table."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _staged.setdefault(spark.conf.get("spark.app.id", "local"), []).append(path)
    staged = spark.read.schema(df.schema).parquet(path)
    _paths[staged] = path
    return staged


def staged_elsewhere(spark: SparkSession, path: str) -> None:
    """Have ``release`` delete a folder that was not written by ``stage``."""
    _staged.setdefault(spark.conf.get("spark.app.id", "local"), []).append(path)


def stage_counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """Stage ``df`` and count its rows on the way."""
    seen = Observation()
    staged = stage(df.observe(seen, F.count(F.lit(1)).alias("n")), label)
    return staged, seen.get["n"]


def release(spark: SparkSession) -> int:
    """Delete the tables this session staged; returns how many. Call when results are written."""
    return discard_paths(spark, staged_paths(spark))


def staged_paths(spark: SparkSession) -> list[str]:
    """Where this session's staged tables are, in the order in which they were written."""
    return list(_staged.get(spark.conf.get("spark.app.id", "local"), []))


def discard_paths(spark: SparkSession, paths: list[str]) -> int:
    """Delete some of the staged tables; returns how many."""
    known = _staged.get(spark.conf.get("spark.app.id", "local"), [])
    mine = [path for path in paths if path in known]
    for path in mine:
        known.remove(path)
    _delete(spark, mine)
    return len(mine)


def discard(staged: DataFrame) -> None:
    """Delete a table that ``stage`` returned, once nothing reads it any more."""
    discard_paths(staged.sparkSession, [_paths.pop(staged)])


def _delete(spark: SparkSession, names: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def small_side(side: DataFrame, rows: int) -> DataFrame:
    """Mark a join side for broadcast if its counted ``rows`` are few; else leave it to Spark."""
    return F.broadcast(side) if rows <= broadcast_rows(side.sparkSession) else side
