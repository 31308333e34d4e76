"""Images on a file system that all executors mount, decoded by Spark's image source.

The image source lists folders by itself: it passes over names that begin with ``.`` or ``_``,
and reads ``[1]`` in a path as a pattern. So it is given links instead. Every image of a listing
gets one below the shared folder, named by the SHA-256 of its path; what was decoded is joined
back by that name. Only the hash leaves a task.

Spark's driver lists what an image source reads. So links are dealt to folders of about
``IMAGES_PER_READ``, and each folder is a read of its own, one after the other: however many
images there are, the driver holds the names of one folder. The links go with the session's
other staged tables.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.functions.images import dhash_bgr
from twinsift.functions.paths import is_image_path
from twinsift.staging import scratch_dir, ship_package, stage, stage_counted, staged_elsewhere


#: Images whose names the driver lists at once.
IMAGES_PER_READ = 100_000


def _link_images(folder: str, parts: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for raw, name in zip(batch["raw"], batch["name"]):
                place = os.path.join(folder, str(int(name[:12], 16) % parts))
                os.makedirs(place, exist_ok=True)
                try:
                    os.symlink(bytes(raw), os.fsencode(os.path.join(place, name + ".png")))
                except FileExistsError:  # a task that ran again
                    pass
            yield batch[["name"]]

    return run


def _mounted(folder: str) -> str:
    """A folder of the mounted file system by its plain path."""
    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    if "://" in folder:
        raise RuntimeError("images are linked below spark.checkpoint.dir, which must be a mounted folder")
    return os.path.abspath(folder)


def decode_linked(spark: SparkSession, folder: str) -> DataFrame:
    """``(name, dhash)`` of the links below ``folder``; null where an image cannot be decoded.

    Images are decoded by content, whatever their extension says.
    """
    image = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(folder).select("image.*")
    data = F.when(F.col("height") > 0, F.col("data"))
    return image.select(
        F.regexp_extract("origin", r"([0-9a-f]{64})\.png$", 1).alias("name"),
        dhash_bgr("width", "height", "nChannels", data).alias("dhash"),
    )


def hash_listed(files: DataFrame) -> DataFrame:
    """The image files of a listing ``files(path, ...)`` with their ``dhash``."""
    spark = files.sparkSession
    ship_package(spark)
    listed = files.where(is_image_path(F.col("path"))).withColumn("_name", F.sha2(F.col("path").cast("binary"), 256))
    folder = f"{_mounted(scratch_dir(spark))}/image-links-{uuid.uuid4().hex}"
    links = listed.select(F.col("path").cast("binary").alias("raw"), F.col("_name").alias("name"))
    links, n = stage_counted(links, "image-names")
    if n == 0:
        return listed.drop("_name").withColumn("dhash", F.lit(None).cast("bigint"))
    parts = -(-n // IMAGES_PER_READ)
    staged_elsewhere(spark, f"file://{folder}")
    links.mapInPandas(_link_images(folder, parts), "name string").write.format("noop").mode("overwrite").save()
    decoded = None
    for part in range(parts):
        if parts > 1 and not os.path.isdir(f"{folder}/{part}"):  # no name fell into it
            continue
        found = stage(decode_linked(spark, f"file://{folder}/{part}"), "image-hashes")
        decoded = found if decoded is None else decoded.unionByName(found)
    return listed.join(decoded, F.col("_name") == F.col("name"), "left").drop("_name", "name")
