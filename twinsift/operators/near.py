"""Near-duplicate images: hash, Hamming join of the distinct hashes, connected components.

Input is ``images(path, dhash, ...)``, one row per image file; ``dhash`` is null where the
image could not be decoded. All images with one hash are one node of the graph, so identical
or flat images cost one row, however many there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.functions.bits import hamming, similarity_percent
from twinsift.functions.images import dhash
from twinsift.functions.paths import is_image_path
from twinsift.operators.components import connected_components
from twinsift.operators.hamming import hamming_pairs, pairs_of, spread_bits
from twinsift.operators.ordering import keeper
from twinsift.skew import join_groups, with_aggregates
from twinsift.staging import hot_rows, stage, stage_counted

#: Default distances of the library call and of the report.
DEFAULT_THRESHOLD = 5
REPORT_THRESHOLD = 10


def hash_rasters(rasters: DataFrame) -> DataFrame:
    """Adds ``dhash`` to rows with pixel arrays, keeping only image paths, and drops the pixels."""
    kept = [c for c in rasters.columns if c not in ("width", "height", "channels", "pixels")]
    return rasters.where(is_image_path(F.col("path"))).select(
        *kept, dhash("width", "height", "channels", "pixels").alias("dhash")
    )


def skipped_images(images: DataFrame) -> DataFrame:
    """``(path)`` of the images that could not be decoded."""
    return images.where(F.col("dhash").isNull()).select("path")


def distinct_hashes(images: DataFrame) -> DataFrame:
    """``(dhash, n_images, first_path)`` per distinct hash."""
    return (
        images.where(F.col("dhash").isNotNull())
        .groupBy("dhash")
        .agg(F.count("*").alias("n_images"), F.min("path").alias("first_path"))
    )


def near_pairs(images: DataFrame, threshold: int = DEFAULT_THRESHOLD) -> DataFrame:
    """``(hash_a, hash_b, distance, similarity)`` for each pair of distinct hashes within the threshold."""
    hashes = images.where(F.col("dhash").isNotNull()).select(F.col("dhash").alias("hash")).distinct()
    distance = hamming(F.col("a"), F.col("b"))
    return hamming_pairs(hashes, threshold).select(
        F.col("a").alias("hash_a"),
        F.col("b").alias("hash_b"),
        distance.alias("distance"),
        similarity_percent(distance).alias("similarity"),
    )


def near_members(
    images: DataFrame,
    threshold: int = DEFAULT_THRESHOLD,
    strategy: str | None = None,
    mtime: str = "mtime",
) -> DataFrame:
    """Members of all near groups: ``(group_id, n_members, ref_dhash[, keeper], path, dhash, ...)``.

    Groups are transitive, so a member may lie further from the reference (the first member
    by path bytes) than the threshold.
    """
    images, total = stage_counted(images, "images")
    images = images.where(F.col("dhash").isNotNull())
    hashes, n_hashes = stage_counted(
        distinct_hashes(images).selectExpr("*", f"{spread_bits('dhash')} as _bits"), "hashes"
    )
    edges = pairs_of(hashes.selectExpr("dhash as hash", "_bits"), n_hashes, threshold, linked=True)
    hashes = hashes.drop("_bits")
    components = connected_components(edges).withColumnRenamed("node", "dhash")
    labelled = hashes.join(components, "dhash", "left").withColumn(
        "component", F.coalesce("component", "dhash")
    )
    if n_hashes > hot_rows(images.sparkSession):
        labelled = stage(labelled, "labelled")
    facts = {"n_members": F.sum("n_images"), "first": F.min(F.struct("first_path", "dhash"))}
    grouped = with_aggregates(labelled, ["component"], facts, n_hashes, having="n_members > 1")
    by_hash = grouped.select(
        "dhash",
        "n_images",
        "n_members",
        F.col("first.first_path").alias("group_id"),
        F.col("first.dhash").alias("ref_dhash"),
    )
    members = join_groups(images, by_hash, ["dhash"], "n_images", total)
    members = members.select("group_id", "n_members", "ref_dhash", *images.columns)
    if strategy is None:
        return members
    if total > hot_rows(images.sparkSession):
        members = stage(members, "near-members")
    found = with_aggregates(members, ["group_id"], {"keeper": keeper(members, strategy, mtime)}, total)
    return found.drop("_rows").withColumn("keeper", F.col("keeper.path"))


def similarity_listing(members: DataFrame) -> DataFrame:
    """``(group_id, path, is_reference, similarity, distance)`` of every near-group member."""
    distance = hamming(F.col("dhash"), F.col("ref_dhash"))
    return members.select(
        "group_id",
        "path",
        (F.col("path") == F.col("group_id")).alias("is_reference"),
        similarity_percent(distance).alias("similarity"),
        distance.alias("distance"),
    )
