"""The two jobs over a directory tree, mounted or by its URI: scan it, and plan its cleanup."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.operators.near import REPORT_THRESHOLD, near_members, skipped_images
from twinsift.plans.cleanup import make_plan
from twinsift.plans.report import write_report
from twinsift.sources.file_content import exact_file_members
from twinsift.sources.images import hash_listed
from twinsift.sources.listing import Listing, is_tree, list_tree
from twinsift.staging import stage


@dataclass(frozen=True)
class Scan:
    listing: Listing
    exact: DataFrame
    near: DataFrame | None = None
    skipped_images: DataFrame | None = None


def scan_tree(
    spark: SparkSession,
    root: str,
    min_size: int = 0,
    near: bool = False,
    threshold: int = REPORT_THRESHOLD,
    strategy: str = "oldest",
    verify: str = "sha256",
) -> Scan:
    """List ``root`` and find its exact and, if asked, near groups; members carry their keeper."""
    if not is_tree(root):
        raise ValueError(f"Provided path is not a valid directory: {root}")
    listing = list_tree(spark, root, min_size)
    exact = stage(exact_file_members(listing.files, verify, strategy, "mtime_ns"), "exact-members")
    if not near:
        return Scan(listing, exact)
    images = stage(hash_listed(listing.files), "image-hashes")
    return Scan(
        listing,
        exact,
        stage(near_members(images, threshold, strategy, "mtime_ns"), "near-members"),
        skipped_images(images),
    )


def plan_cleanup(scan: Scan, resolve: bool = False) -> DataFrame:
    """Plan over the scan's groups with the strategy it was run with."""
    return make_plan(scan.exact, scan.near, resolve=resolve)


def report_scan(scan: Scan, folder: str, verbose: bool = False) -> None:
    """Write the report of a scan below ``folder``; skipped items only if ``verbose``."""
    totals = scan.exact.groupBy("group_id").agg(F.max("size").alias("size"), F.count("*").alias("n")).agg(
        F.coalesce(F.sum(F.expr("size * (n - 1)")), F.lit(0)).cast("bigint").alias("total_wasted_bytes")
    )
    write_report(
        folder,
        scan.listing.stats,
        scan.exact,
        totals,
        scan.near,
        scan.listing.skipped if verbose else None,
        scan.skipped_images if verbose else None,
    )
