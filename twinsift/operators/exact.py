"""Exact duplicates: size, then 64-bit fingerprint, then verified content.

Input is an inventory ``files(path, size, mtime, content, ...)``; rows whose content is null
(unreadable) take part in nothing. Groups come as one row per group, members in long form,
and ``group_id`` is the smallest member path by bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.functions.content import digest, digests_of_pieces, files_identical, fingerprint
from twinsift.operators.ordering import keeper
from twinsift.operators.row_vectors import marked, vectors_of, with_places
from twinsift.skew import join_groups, number_rows, with_aggregates
from twinsift.staging import hot_rows, small_side, stage_counted

DIGEST_KEY = ["size", "fingerprint", "digest"]
PIECES_KEY = ["size", "pieces"]


def min_size_filter(files: DataFrame, min_size: int = 0) -> DataFrame:
    """Drop files smaller than ``min_size`` (which itself passes)."""
    return files.where(F.col("size") >= min_size)


def scan_stats(files: DataFrame) -> DataFrame:
    """One row: files and bytes of an inventory table."""
    return files.agg(
        F.count("*").alias("files_visited"),
        F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("bytes_visited"),
    )


def size_buckets(files: DataFrame) -> DataFrame:
    """``(size, n_files)`` for every size, singletons included."""
    return files.groupBy("size").agg(F.count("*").alias("n_files"))


def dup_size_candidates(files: DataFrame) -> DataFrame:
    """Files whose size occurs more than once, with the size of their bucket as ``n_files``."""
    return with_aggregates(files, ["size"], {}, files.count(), "n_files", "n_files > 1")


def fingerprint_table(
    files: DataFrame, with_digest: bool = True, make_fingerprint: Callable[[Column], Column] = fingerprint
) -> DataFrame:
    """The inventory with content replaced by its fingerprint (and digest): narrow rows, no shuffle."""
    content = F.col("content")
    kept = [c for c in files.columns if c != "content"]
    added = [make_fingerprint(content).alias("fingerprint")]
    if with_digest:
        added.append(digest(content).alias("digest"))
    return files.where(content.isNotNull()).select(*kept, *added)


def exact_groups(
    files: DataFrame, verify: str = "sha256", strategy: str | None = None, mtime: str = "mtime"
) -> DataFrame:
    """``(group_id, size, n_members, wasted_bytes[, keeper])``, one row per set of identical files.

    One scan of the contents. Keys alone are counted first, with copies combined before the
    shuffle; paths move only where a key occurs more than once.
    """
    if verify == "sha256":
        keyed, total = stage_counted(fingerprint_table(files), "fingerprints")
        keys = DIGEST_KEY
        counts = keyed.groupBy(*keys).agg(F.count("*").alias("n_members")).where("n_members > 1")
        keyed = join_groups(keyed, counts, keys, "n_members", total)
    else:
        keyed, keys = exact_members(files, verify), ["group_id", "size"]
    facts = [F.count("*").alias("n_members"), F.min("path").alias("first_path")]
    if strategy:
        facts.append(keeper(keyed, strategy, mtime)["path"].alias("keeper"))
    groups = keyed.groupBy(*keys).agg(*facts)
    return groups.select(
        F.col("first_path").alias("group_id"), "size", "n_members", wasted_bytes().alias("wasted_bytes"),
        *(["keeper"] if strategy else []),
    )


def exact_members(
    files: DataFrame,
    verify: str = "sha256",
    strategy: str | None = None,
    mtime: str = "mtime",
    make_fingerprint: Callable[[Column], Column] = fingerprint,
) -> DataFrame:
    """Members of all exact groups: ``(group_id, n_members[, keeper], path, size, mtime, ...)``.

    ``verify="sha256"`` compares size, fingerprint and SHA-256, so content is read once and
    never shuffled. ``verify="bytes"`` reads content a second time where size and fingerprint
    repeat, and compares it piece by piece; see ``_verify_pieces``. With a ``strategy`` every row
    also carries its group's ``keeper`` path, found in the same aggregation.
    """
    if verify not in ("sha256", "bytes"):
        raise ValueError(f"verify must be 'sha256' or 'bytes', not {verify!r}")
    placed = with_places(files) if verify == "bytes" else None
    keyed, total = stage_counted(
        fingerprint_table(files if placed is None else placed, verify == "sha256", make_fingerprint), "fingerprints"
    )
    facts = {"group_id": F.min("path")}
    if strategy:
        facts["keeper"] = keeper(keyed, strategy, mtime)
    if verify == "sha256":
        return group_rows(keyed, DIGEST_KEY, facts, total)
    pieces, total = _verify_pieces(files, keyed, total)
    return group_rows(pieces, PIECES_KEY, facts, total)


def group_rows(keyed: DataFrame, keys: Sequence[str], facts: dict[str, Column], total: int) -> DataFrame:
    """Rows whose keys occur more than once, with the facts of their group."""
    own = [c for c in keyed.columns if c not in ("fingerprint", "digest", "pieces")]
    attached = with_aggregates(keyed, keys, facts, total, "n_members", "n_members > 1")
    if "keeper" in facts:
        attached = attached.withColumn("keeper", F.col("keeper.path"))
    return attached.select("group_id", "n_members", *[c for c in facts if c != "group_id"], *own)


def _verify_pieces(files: DataFrame, keyed: DataFrame, total: int) -> tuple[DataFrame, int]:
    """The files whose size and fingerprint repeat, with their contents as digests of pieces.

    Sizes and fingerprints are counted first. The contents of the repeated ones are read where
    they lie, found by their places, and leave the scan as the digests of pieces that double in
    size, so no content is shuffled however many there are, and contents that share size and
    fingerprint part by their first piece. Tables that don't come from files have no places;
    there every content is cut into pieces, and those that repeat are joined by their paths.
    """
    bucket = ["size", "fingerprint"]
    counts = keyed.groupBy(*bucket).agg(F.count("*").alias("n_files")).where("n_files > 1")
    repeated = join_groups(keyed, counts, bucket, "n_files", total)
    kept = [c for c in files.columns if c != "content"]
    cut = [*kept, digests_of_pieces(F.col("content")).alias("pieces")]
    if "_file" in keyed.columns:
        again = marked(files, *vectors_of(repeated.select("_file", "_row"))).where("_named").select(*cut)
    else:
        listed, n = stage_counted(repeated.select("path").distinct(), "repeated")
        again = files.where("content is not null").select(*cut).join(small_side(listed, n), "path", "left_semi").select(*kept, "pieces")
    return stage_counted(again, "pieces")


def identical_to_first(files: DataFrame) -> DataFrame:
    """``(path, first_path, identical)``: each file against the first file of its size bucket."""
    # Unreadable files stay: they are identical to no other.
    listed = files.select(*(c for c in files.columns if c != "content"), digest(F.col("content")).alias("digest"))
    keyed, total = stage_counted(listed, "fingerprints")
    head = {"first": F.min(F.struct("path", "digest"))}
    pairs = with_aggregates(keyed, ["size"], head, total, "n_files", "n_files > 1")
    same = files_identical(
        F.col("path"), F.col("size"), F.col("digest"),
        F.col("first.path"), F.col("size"), F.col("first.digest"),
    )
    return pairs.select("path", F.col("first.path").alias("first_path"), same.alias("identical"))


def rank_members(members: DataFrame, total: int | None = None) -> DataFrame:
    """Adds ``member_rank``, the 1-based place of a member in its group by path bytes.

    ``total`` is an upper bound on the number of members, if the caller knows one (the
    number of files will do); otherwise the members are staged and counted.
    """
    if total is None or total > hot_rows(members.sparkSession):
        members, total = stage_counted(members, "members")
    return number_rows(members, ["group_id"], ["path"], "member_rank", total, "n_members")


def wasted_bytes() -> Column:
    """Bytes freed by keeping one copy; 0 for a single file."""
    return F.when(F.col("n_members") <= 1, F.lit(0).cast("bigint")).otherwise(
        F.col("size") * (F.col("n_members") - 1)
    )


def total_wasted(groups: DataFrame) -> DataFrame:
    """One row: number of groups and bytes wasted in all."""
    return groups.agg(
        F.count("*").alias("n_groups"),
        F.coalesce(F.sum("wasted_bytes"), F.lit(0)).cast("bigint").alias("total_wasted_bytes"),
    )


def by_waste(groups: DataFrame, top: int | None = None) -> DataFrame:
    """Groups by wasted bytes, largest first, ties by group; optionally the ``top`` only."""
    ordered = groups.orderBy(F.desc("wasted_bytes"), "group_id")
    return ordered if top is None else ordered.limit(top)
