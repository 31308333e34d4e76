"""Report rows over groups. Lists of members come in parts of bounded length.

A group's members may be a large share of all files, so a report row holds at most
``PART`` of them: ``part`` 0, 1, ... of a group together list every member in order. Groups
that fit, which is nearly all, have the single row ``part`` = 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.functions.bits import hamming
from twinsift.functions.paths import has_preview
from twinsift.operators.exact import rank_members, wasted_bytes
from twinsift.skew import number_rows

PART = 10_000


def number_groups(groups: DataFrame) -> DataFrame:
    """Adds ``group_number`` (1-based, by first path) and ``n_groups``, as in "Group i of N"."""
    n = groups.count()
    numbered = number_rows(groups, [], ["group_id"], "group_number", n)
    return numbered.withColumn("n_groups", F.lit(n).cast("bigint"))


def group_previews(groups: DataFrame) -> DataFrame:
    """``(group_id, is_image)``: whether the group's first member is an image with a preview."""
    return groups.select("group_id", has_preview(F.col("group_id")).alias("is_image"))


def representatives(members: DataFrame, near: bool) -> DataFrame:
    """``(group_id, path)`` to preview: the first member of an exact group, all of a near one."""
    rows = members.select("group_id", "path")
    return rows if near else rows.where(F.col("path") == F.col("group_id"))


def _in_parts(members: DataFrame, *entry: Column, total: int | None, part: int) -> DataFrame:
    """One row per group and part with the array ``files`` of entries in member order."""
    ranked = rank_members(members, total)
    number = F.call_function("div", F.col("member_rank") - 1, F.lit(part))
    value = entry[0] if len(entry) == 1 else F.struct(*entry)
    listed = F.array_sort(F.collect_list(F.struct("member_rank", value.alias("file"))))
    return (
        ranked.groupBy("group_id", number.alias("part"))
        .agg(F.first("n_members").alias("n_members"), F.max("size").alias("size"), listed.alias("listed"))
        .withColumn("files", F.transform("listed", lambda m: m["file"]))
        .drop("listed")
    )


def exact_report(members: DataFrame, total: int | None = None, part: int = PART) -> DataFrame:
    """``(group_id, part, size_bytes, wasted_bytes, files)``; ``files`` are paths.

    The group's wasted bytes stand on part 0 and are 0 on others, so they can be summed.
    """
    return _in_parts(members, F.col("path"), total=total, part=part).select(
        "group_id", "part", F.col("size").alias("size_bytes"), F.when(F.col("part") == 0, wasted_bytes()).otherwise(F.lit(0)).alias("wasted_bytes"), "files"
    )


def near_report(members: DataFrame, total: int | None = None, part: int = PART) -> DataFrame:
    """``(group_id, part, files)``; ``files`` are structs of path and distance_from_reference."""
    distance = hamming(F.col("dhash"), F.col("ref_dhash")).alias("distance_from_reference")
    if "size" not in members.columns:
        members = members.withColumn("size", F.lit(None).cast("bigint"))
    return _in_parts(members, F.col("path"), distance, total=total, part=part).select("group_id", "part", "files")


def write_report(
    folder: str,
    stats: DataFrame,
    exact_members: DataFrame,
    exact_totals: DataFrame,
    near_members: DataFrame | None = None,
    skipped: DataFrame | None = None,
    skipped_images: DataFrame | None = None,
) -> None:
    """Write the report as JSON lines, one folder per section, in the order a reader expects.

    Sections: ``scan_stats``, ``groups``, ``totals``, and if given ``near_duplicate_groups``,
    ``skipped_paths`` and ``near_duplicate_skipped_paths``.
    """
    sections = {
        "scan_stats": stats,
        "groups": exact_report(exact_members).orderBy("group_id", "part"),
        "totals": exact_totals,
    }
    if near_members is not None:
        sections["near_duplicate_groups"] = near_report(near_members).orderBy("group_id", "part")
    if skipped is not None:
        sections["skipped_paths"] = skipped
    if skipped_images is not None:
        sections["near_duplicate_skipped_paths"] = skipped_images
    for name, rows in sections.items():
        rows.write.mode("errorifexists").json(f"{folder}/{name}")
