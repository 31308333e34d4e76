"""Registered queries: each operator over the given tables, as ``(spark, folder) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.functions.bits import hash_hex
from twinsift.functions.content import content_size
from twinsift.functions.images import GRID_WIDTH, dhash, dhash_of_pixels, luma_grid
from twinsift.functions.paths import component_key, extension, is_image_path
from twinsift.functions.text import format_bytes
from twinsift.operators import exact, near
from twinsift.plans import cleanup, curate, report, review
from twinsift.sources.tables import (
    document_files,
    document_images,
    embedding_rasters,
    read_table,
)
from twinsift.staging import stage

#: Threshold of the near-duplicate queries: at 10 the test vectors hardly have a pair.
NEAR_THRESHOLD = 14
BATCH, BATCH_TS = "batch_1", 1

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def files(spark: SparkSession, folder: str) -> DataFrame:
    return document_files(read_table(spark, folder, "documents"))


def rasters(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_rasters(read_table(spark, folder, "embeddings"))


def images(spark: SparkSession, folder: str) -> DataFrame:
    """The rasters as images, and their hashes."""
    return near.hash_rasters(rasters(spark, folder))


def file_images(spark: SparkSession, folder: str) -> DataFrame:
    """The documents with image names and their hashes, null without a raster: exact and near groups share these files."""
    pictured = document_images(
        read_table(spark, folder, "documents"), read_table(spark, folder, "embeddings")
    )
    return near.hash_rasters(pictured)


def exact_members_of(spark: SparkSession, folder: str, strategy: str | None = None, mtime: str = "mtime") -> DataFrame:
    return exact.exact_members(files(spark, folder), strategy=strategy, mtime=mtime)


def n_documents(spark: SparkSession, folder: str) -> int:
    """Row count from the file footers: an upper bound on the members of all groups."""
    return read_table(spark, folder, "documents").count()


def both_kinds(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    exact_part = exact_members_of(spark, folder, "oldest", "mtime_day")
    near_part = near.near_members(file_images(spark, folder), NEAR_THRESHOLD, "oldest", "mtime_day")
    return exact_part, near_part


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_groups(files(spark, folder), strategy="oldest")


# --- inventory -------------------------------------------------------------------------


@query
def scan_stats(spark, folder):
    return exact.scan_stats(files(spark, folder))


@query
def min_size_filter(spark, folder):
    return exact.min_size_filter(files(spark, folder), 1000).select("path", "size", "mtime")


@query
def size_buckets(spark, folder):
    return exact.size_buckets(files(spark, folder))


@query
def dup_size_candidates(spark, folder):
    inventory = files(spark, folder).select("path", "size")
    return exact.dup_size_candidates(inventory)


@query
def image_ext_filter(spark, folder):
    inventory = files(spark, folder)
    return inventory.where(is_image_path(F.col("path"))).select("path", extension(F.col("path")).alias("extension"))


@query
def path_orders(spark, folder):
    """Per directory level above the files: the first path by bytes and by components."""
    inventory = files(spark, folder)
    return inventory.groupBy(F.regexp_extract("path", "/([^/]+)/doc_", 1).alias("folder")).agg(
        F.min("path").alias("first_by_bytes"),
        F.min(F.struct(component_key(F.col("path")).alias("k"), "path"))["path"].alias("first_by_component"),
    )


@query
def format_bytes_of_files(spark, folder):
    return files(spark, folder).select("path", format_bytes(F.col("size")).alias("size_text"))


# --- exact duplicates ------------------------------------------------------------------


@query
def exact_groups(spark, folder):
    return exact.exact_groups(files(spark, folder)).select("group_id", "size", "n_members")


@query
def exact_members(spark, folder):
    members = exact.rank_members(exact_members_of(spark, folder), n_documents(spark, folder))
    return members.select("group_id", "member_rank", "path", "size", "mtime")


@query
def group_keepers(spark, folder):
    return exact.exact_groups(files(spark, folder), strategy="oldest", mtime="mtime_day").select("group_id", "keeper")


@query
def suggested_index(spark, folder):
    """The place in its group of the member each review suggests to keep."""
    members = exact_members_of(spark, folder, "newest", "mtime_day")
    ranked = exact.rank_members(members, n_documents(spark, folder))
    return ranked.where("path = keeper").select("group_id", "path", F.col("member_rank").alias("suggested"))


@query
def exact_sha256(spark, folder):
    return exact.exact_members(files(spark, folder), "sha256").select("group_id", "path")


@query
def exact_bytes(spark, folder):
    return exact.exact_members(files(spark, folder), "bytes").select("group_id", "path")


@query
def exact_pages(spark, folder):
    """Web pages, with their bytes: groups of identical pages and the pages that have no copy."""
    pages = read_table(spark, folder, "pages").select(
        F.col("url").alias("path"), content_size(F.col("html")).alias("size"), F.col("html").alias("content")
    )
    n_pages = pages.count()
    return exact.exact_groups(pages).agg(
        F.count("*").alias("n_groups"),
        F.coalesce(F.sum("n_members"), F.lit(0)).cast("bigint").alias("n_copied"),
        F.lit(n_pages).cast("bigint").alias("n_pages"),
    )


@query
def identical_pairs(spark, folder):
    return exact.identical_to_first(files(spark, folder).select("path", "size", "content"))


@query
def wasted_by_group(spark, folder):
    groups = exact.exact_groups(files(spark, folder))
    return groups.select("group_id", "wasted_bytes", format_bytes(F.col("wasted_bytes")).alias("wasted_text"))


@query
def total_wasted(spark, folder):
    return exact.total_wasted(exact.exact_groups(files(spark, folder)))


@query
def top_wasted(spark, folder):
    return exact.by_waste(exact.exact_groups(files(spark, folder)), 10).select("group_id", "wasted_bytes")


@query
def group_numbers(spark, folder):
    groups = exact.exact_groups(files(spark, folder))
    return report.number_groups(stage(groups.select("group_id"), "groups"))


@query
def is_image_group(spark, folder):
    return report.group_previews(exact.exact_groups(files(spark, folder)))


@query
def representatives(spark, folder):
    return report.representatives(exact_members_of(spark, folder), near=False)


@query
def representatives_near(spark, folder):
    return report.representatives(near.near_members(images(spark, folder), NEAR_THRESHOLD), near=True)


# --- image hashes and near duplicates --------------------------------------------------


@query
def luma_cells(spark, folder):
    grid = luma_grid("width", "height", "channels", "pixels")
    cells = rasters(spark, folder).selectExpr("img_id", f"posexplode({grid}) as (cell, luma)")
    return cells.selectExpr(
        "img_id", f"cell div {GRID_WIDTH} as gy", f"cast(cell % {GRID_WIDTH} as bigint) as gx", "luma"
    )


@query
def dhash_rasters(spark, folder):
    hashed = dhash("width", "height", "channels", "pixels")
    return rasters(spark, folder).select("img_id", hash_hex(hashed).alias("dhash"))


@query
def dhash_expression(spark, folder):
    hashed = F.expr(dhash_of_pixels("width", "height", "channels", "pixels"))
    return rasters(spark, folder).select("img_id", hash_hex(hashed).alias("dhash"))


def _pairs(spark, folder, threshold):
    a, b = hash_hex(F.col("hash_a")), hash_hex(F.col("hash_b"))
    return near.near_pairs(images(spark, folder), threshold).select(
        F.least(a, b).alias("hash_a"), F.greatest(a, b).alias("hash_b"), "distance", "similarity"
    )


@query
def hamming_pairs(spark, folder):
    return _pairs(spark, folder, NEAR_THRESHOLD)


@query
def hamming_pairs_10(spark, folder):
    return _pairs(spark, folder, 10)


@query
def hamming_pairs_20(spark, folder):
    return _pairs(spark, folder, 20)


def _group_sizes(spark, folder, threshold):
    members = near.near_members(images(spark, folder), threshold)
    return members.groupBy("group_id").agg(F.count("*").alias("n_members"))


@query
def near_groups(spark, folder):
    return _group_sizes(spark, folder, NEAR_THRESHOLD)


@query
def near_groups_16(spark, folder):
    return _group_sizes(spark, folder, 16)


@query
def skipped_images(spark, folder):
    return near.skipped_images(file_images(spark, folder))


@query
def near_distances(spark, folder):
    return near.similarity_listing(near.near_members(images(spark, folder), NEAR_THRESHOLD))


# --- plans and selections --------------------------------------------------------------


def _plan(spark, folder, strategy):
    members = exact_members_of(spark, folder, strategy, "mtime_day")
    return cleanup.make_plan(members).select("group_id", "path", "action")


@query
def plan_oldest(spark, folder):
    return _plan(spark, folder, "oldest")


@query
def plan_newest(spark, folder):
    return _plan(spark, folder, "newest")


@query
def plan_alpha(spark, folder):
    return _plan(spark, folder, "alpha-first")


@query
def plan_both_kinds(spark, folder):
    return cleanup.make_plan(*both_kinds(spark, folder))


@query
def plan_resolved(spark, folder):
    return cleanup.make_plan(*both_kinds(spark, folder), resolve=True).select("path", "action")


@query
def plan_totals(spark, folder):
    return cleanup.dry_run(*both_kinds(spark, folder))


@query
def selection(spark, folder):
    return cleanup.initial_selection(cleanup.make_plan(*both_kinds(spark, folder)))


@query
def selected_bytes(spark, folder):
    exact_part, near_part = (stage(m, "members") for m in both_kinds(spark, folder))
    chosen = cleanup.initial_selection(cleanup.make_plan(exact_part, near_part))
    return cleanup.selected_totals(chosen, exact_part, near_part)


# --- carrying plans out ----------------------------------------------------------------


def _outcome(spark, folder):
    plan = cleanup.make_plan(exact_members_of(spark, folder, "oldest"))
    return curate.apply_plan(files(spark, folder), plan, batch_id=BATCH, ts=BATCH_TS)


@query
def apply_plan_kept(spark, folder):
    return _outcome(spark, folder).kept.select("path", "size", "mtime")


@query
def apply_plan_quarantined(spark, folder):
    return _outcome(spark, folder).quarantined.select("batch_id", "row_key", "path", "size", "content")


@query
def apply_plan_manifest(spark, folder):
    return _outcome(spark, folder).manifest


@query
def undo_roundtrip(spark, folder):
    done = _outcome(spark, folder)
    quarantined = stage(done.quarantined, "quarantine")
    manifest = stage(done.manifest, "manifest")
    return curate.undo_last(done.kept, quarantined, manifest).corpus


# --- review ----------------------------------------------------------------------------


def answers(groups: DataFrame) -> DataFrame:
    """A decision for every group, derived from its size and number of members."""
    return groups.select(
        "group_id",
        F.expr("""case cast(size % 7 as int)
            when 0 then 'a' when 1 then ' s ' when 2 then 'k2' when 3 then 'k 1x'
            when 4 then concat('k', cast(n_members + 1 as string)) when 5 then 'keep' else '' end""").alias("action"),
    )


def _review(spark, folder):
    members = stage(exact_members_of(spark, folder, "newest", "mtime_day"), "members")
    groups = members.groupBy("group_id").agg(F.max("size").alias("size"), F.count("*").alias("n_members"))
    return review.apply_decisions(members, answers(groups))


@query
def review_decisions(spark, folder):
    return _review(spark, folder)[0].select("group_id", "path", "action")


@query
def review_invalid(spark, folder):
    return _review(spark, folder)[1]


# --- reports ---------------------------------------------------------------------------


@query
def report_exact(spark, folder):
    rows = report.exact_report(exact_members_of(spark, folder), n_documents(spark, folder))
    return rows.select("group_id", "part", "size_bytes", "wasted_bytes", F.concat_ws("|", "files").alias("files"))


@query
def report_near(spark, folder):
    members = near.near_members(images(spark, folder), NEAR_THRESHOLD)
    rows = report.near_report(members, read_table(spark, folder, "embeddings").count())
    texts = F.transform("files", lambda f: F.concat(f["path"], F.lit(":"), f["distance_from_reference"].cast("string")))
    return rows.select("group_id", "part", F.concat_ws("|", texts).alias("files"))
