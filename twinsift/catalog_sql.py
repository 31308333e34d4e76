"""The registered queries in plain SQL over the same tables, for comparison by another engine."""

from __future__ import annotations

FILES = """files as (
  select concat('/corpus/', case when doc_id % 2 = 0 then 'set.old' else 'set' end, '/', source, '/', lang,
                '/doc_', lpad(cast(doc_id as varchar), 7, '0'),
                case doc_id % 4 when 0 then '.txt' when 1 then '.JPG' when 2 then '.md' else '.png' end) as path,
         doc_id,
         cast(strlen(text) as bigint) as size,
         timestamp '2024-01-01 00:00:00' + to_seconds((doc_id * 7919) % 86400) as mtime,
         timestamp '2024-01-01 00:00:00' + to_days(cast(doc_id % 3 as integer)) as mtime_day,
         text as content
  from documents)"""

EXACT = """groups as (
  select size, content, min(path) as group_id, count(*) as n_members,
         size * (count(*) - 1) as wasted_bytes
  from files where content is not null
  group by size, content having count(*) > 1),
members as (
  select g.group_id, g.n_members, g.wasted_bytes, f.path, f.size, f.mtime, f.mtime_day, f.content,
         row_number() over (partition by g.group_id order by f.path) as member_rank,
         row_number() over (partition by g.group_id order by f.mtime, string_split(f.path, '/')) as by_oldest,
         row_number() over (partition by g.group_id order by f.mtime_day, string_split(f.path, '/')) as by_oldest_day,
         row_number() over (partition by g.group_id order by f.mtime_day desc, string_split(f.path, '/')) as by_newest_day,
         row_number() over (partition by g.group_id order by string_split(f.path, '/')) as by_alpha
  from files f join groups g on f.size = g.size and f.content = g.content)"""

RASTERS = """rasters as (
  select vec_id as img_id, concat('/img/', lpad(cast(vec_id as varchar), 7, '0'), '.png') as path,
         list_transform(embedding, lambda v: least(255, greatest(0,
           cast(floor((cast(v as double) + 1.0) * 127.5) as integer)))) as pixels
  from embeddings),
cells as (
  select img_id, gy, gx, cast(pixels[gy * 8 + (gx * 8) // 9 + 1] as bigint) as v
  from rasters, (select unnest(range(8)) as gy) ys, (select unnest(range(9)) as gx) xs),
grid as (select img_id, gy, gx, (299 * v + 587 * v + 114 * v) // 1000 as luma from cells),
bits as (
  select l.img_id, l.gy * 8 + l.gx as k, case when l.luma < r.luma then 1 else 0 end as bit
  from grid l join grid r on l.img_id = r.img_id and l.gy = r.gy and l.gx + 1 = r.gx),
hashes as (
  select img_id,
         cast(sum(case when k < 32 then bit * (cast(1 as bigint) << k) else 0 end) as bigint) as lo,
         cast(sum(case when k >= 32 then bit * (cast(1 as bigint) << (k - 32)) else 0 end) as bigint) as hi
  from bits group by img_id)"""

HEX = "printf('%08x%08x', {0}hi, {0}lo)"
DISTANCE = "cast(bit_count(xor({0}.hi, {1}.hi)) + bit_count(xor({0}.lo, {1}.lo)) as integer)"


def _near(images: str, threshold: int = 14) -> str:
    """Components by a recursive union over ``images(path, hi, lo, ...)``."""
    return f"""edges as (
  select a.path as a, b.path as b from {images} a join {images} b
    on a.path <> b.path and {DISTANCE.format('a', 'b')} <= {threshold}),
reach(a, b) as (
  select path, path from {images}
  union
  select r.a, e.b from reach r join edges e on r.b = e.a),
labels as (select a as path, min(b) as group_id from reach group by a having count(*) > 1),
near as (
  select l.group_id, i.*, r.hi as ref_hi, r.lo as ref_lo,
         row_number() over (partition by l.group_id order by i.path) as member_rank
  from labels l join {images} i using (path) join {images} r on r.path = l.group_id),
near_far as (select *, cast(bit_count(xor(hi, ref_hi)) + bit_count(xor(lo, ref_lo)) as integer) as distance from near)"""


def _pairs_sql(threshold: int) -> str:
    return _with(RASTERS, "d as (select distinct hi, lo from hashes)") + f"""
        select {HEX.format('a.')} as hash_a, {HEX.format('b.')} as hash_b, {DISTANCE.format('a', 'b')} as distance,
               cast(100 - ({DISTANCE.format('a', 'b')} * 100) // 64 as integer) as similarity
        from d a join d b on (a.hi < b.hi or (a.hi = b.hi and a.lo < b.lo)) and {DISTANCE.format('a', 'b')} <= {threshold}"""


IMAGES = "images as (select r.path, h.hi, h.lo from rasters r join hashes h using (img_id))"

FILE_IMAGES = """file_images as (
  select f.path, f.size, f.mtime_day, h.hi, h.lo
  from files f join hashes h on f.doc_id = h.img_id
  where regexp_matches(lower(f.path), '[^/][.](jpg|jpeg|png|bmp)$'))"""

NEAR_PLAN = """near_plan as (
  select path, size, group_id,
         case when row_number() over (partition by group_id order by mtime_day, string_split(path, '/')) = 1
              then 'keep' else 'delete' end as action
  from near),
plan as (
  select path, case when by_oldest_day = 1 then 'keep' else 'delete' end as action, 'exact' as source, group_id, size from members
  union all
  select path, action, 'near' as source, group_id, size from near_plan)"""

SIZE_TEXT = """case when {0} = 0 then '0 B' when {0} < 1024 then concat(cast({0} as varchar), ' B')
  when {0} < 1048576 then concat(format('{{:.2f}}', {0} / 1024.0::double), ' KB')
  when {0} < 1073741824 then concat(format('{{:.2f}}', {0} / 1048576.0::double), ' MB')
  else concat(format('{{:.2f}}', {0} / 1073741824.0::double), ' GB') end"""

DELETES = "deletes as (select distinct path from members where by_oldest <> 1)"

ANSWERS = """answers as (
  select group_id, n_members,
         case size % 7 when 0 then 'a' when 1 then ' s ' when 2 then 'k2' when 3 then 'k 1x'
              when 4 then concat('k', cast(n_members + 1 as varchar)) when 5 then 'keep' else '' end as action
  from groups)"""


def _with(*parts: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}" + ",\n".join(parts) + "\n"


def _plan_sql(rank: str) -> str:
    return _with(FILES, EXACT) + (
        f"select group_id, path, case when {rank} = 1 then 'keep' else 'delete' end as action from members"
    )


def oracle_sql() -> dict[str, str]:
    files = _with(FILES)
    exact = _with(FILES, EXACT)
    hashes = _with(RASTERS)
    near = _with(RASTERS, IMAGES, _near("images"), recursive=True)
    both = _with(FILES, EXACT, RASTERS, FILE_IMAGES, _near("file_images"), NEAR_PLAN, recursive=True)
    return {
        "scan_stats": files + "select count(*) as files_visited, cast(coalesce(sum(size), 0) as bigint) as bytes_visited from files",
        "min_size_filter": files + "select path, size, mtime from files where size >= 1000",
        "size_buckets": files + "select size, count(*) as n_files from files group by size",
        "dup_size_candidates": files + """select path, size, n_files from (
            select path, size, count(*) over (partition by size) as n_files from files) where n_files > 1""",
        "image_ext_filter": files + """select path, lower(regexp_extract(path, '[^/]([.][^./]*)$', 1)) as extension
            from files where lower(regexp_extract(path, '[^/]([.][^./]*)$', 1)) in ('.jpg', '.jpeg', '.png', '.bmp')""",
        "path_orders": files + """select regexp_extract(path, '/([^/]+)/doc_', 1) as folder, min(path) as first_by_bytes,
            array_to_string(min(string_split(path, '/')), '/') as first_by_component from files group by 1""",
        "format_bytes_of_files": files + f"select path, {SIZE_TEXT.format('size')} as size_text from files",
        "exact_groups": exact + "select group_id, size, n_members from groups",
        "exact_members": exact + "select group_id, member_rank, path, size, mtime from members",
        "group_keepers": exact + "select group_id, path as keeper from members where by_oldest_day = 1",
        "suggested_index": exact + "select group_id, path, member_rank as suggested from members where by_newest_day = 1",
        "exact_sha256": exact + "select group_id, path from members",
        "exact_bytes": exact + "select group_id, path from members",
        "exact_pages": """with copies as (select html, count(*) as n from pages group by html having count(*) > 1)
            select count(*) as n_groups, cast(coalesce(sum(n), 0) as bigint) as n_copied,
                   (select count(*) from pages) as n_pages from copies""",
        "identical_pairs": files + """, heads as (
            select size, min(path) as first_path from files where content is not null group by size having count(*) > 1)
            select f.path, h.first_path, f.content = g.content as identical
            from files f join heads h on f.size = h.size join files g on g.path = h.first_path""",
        "wasted_by_group": exact + f"select group_id, wasted_bytes, {SIZE_TEXT.format('wasted_bytes')} as wasted_text from groups",
        "total_wasted": exact + "select count(*) as n_groups, cast(coalesce(sum(wasted_bytes), 0) as bigint) as total_wasted_bytes from groups",
        "top_wasted": exact + "select group_id, wasted_bytes from groups order by wasted_bytes desc, group_id limit 10",
        "group_numbers": exact + "select group_id, row_number() over (order by group_id) as group_number, count(*) over () as n_groups from groups",
        "is_image_group": exact + """select group_id, lower(regexp_extract(group_id, '[^/]([.][^./]*)$', 1))
            in ('.jpg', '.jpeg', '.png', '.bmp', '.gif') as is_image from groups""",
        "representatives": exact + "select group_id, path from members where member_rank = 1",
        "representatives_near": near + "select group_id, path from near",
        "luma_cells": hashes + "select img_id, gy, gx, luma from grid",
        "dhash_rasters": hashes + f"select img_id, {HEX.format('')} as dhash from hashes",
        "dhash_expression": hashes + f"select img_id, {HEX.format('')} as dhash from hashes",
        "hamming_pairs": _pairs_sql(14),
        "hamming_pairs_10": _pairs_sql(10),
        "hamming_pairs_20": _pairs_sql(20),
        "near_groups_16": _with(RASTERS, IMAGES, _near("images", 16), recursive=True) + "select group_id, count(*) as n_members from near group by group_id",
        "near_groups": near + "select group_id, count(*) as n_members from near group by group_id",
        "skipped_images": _with(FILES, RASTERS) + """select f.path from files f
            where regexp_matches(lower(f.path), '[^/][.](jpg|jpeg|png|bmp)$') and f.doc_id not in (select img_id from rasters)""",
        "near_distances": near + """select group_id, path, path = group_id as is_reference,
            cast(100 - (distance * 100) // 64 as integer) as similarity, distance from near_far""",
        "plan_oldest": _plan_sql("by_oldest_day"),
        "plan_newest": _plan_sql("by_newest_day"),
        "plan_alpha": _plan_sql("by_alpha"),
        "plan_both_kinds": both + "select path, action, source, group_id, size from plan",
        "plan_resolved": both + "select path, min(action) as action from plan group by path",
        "plan_totals": both + """select count(*) filter (where action = 'delete') as n_delete,
            count(*) filter (where action = 'keep') as n_keep,
            cast(coalesce(sum(size) filter (where action = 'delete'), 0) as bigint) as reclaim_bytes from plan""",
        "selection": both + "select distinct path from plan where action = 'delete'",
        "selected_bytes": both + """, chosen as (select distinct path from plan where action = 'delete'),
            memberships as (select path, size from members union all select path, size from near)
            select count(distinct c.path) as n_selected, cast(coalesce(sum(m.size), 0) as bigint) as selected_bytes
            from chosen c left join memberships m on c.path = m.path""",
        "apply_plan_kept": _with(FILES, EXACT, DELETES) + """select path, size, mtime from files
            where path not in (select path from deletes)""",
        "apply_plan_quarantined": _with(FILES, EXACT, DELETES) + """select 'batch_1' as batch_id,
            sha256(concat('batch_1|', path)) as row_key, path, size, content from files
            where path in (select path from deletes)""",
        "apply_plan_manifest": _with(FILES, EXACT, DELETES) + """select 'batch_1' as batch_id, cast(1 as bigint) as ts,
            sha256(concat('batch_1|', path)) as row_key, path from deletes""",
        "undo_roundtrip": files + "select path, size, mtime, mtime_day, content from files",
        "review_decisions": _with(FILES, EXACT, ANSWERS) + """, chosen as (
              select m.*, a.action as answer, case when a.action = 'a' then m.by_newest_day = 1
                when a.action = 'k2' then m.member_rank = 2 else m.member_rank = 1 end as keep
              from members m join answers a using (group_id) where a.action in ('a', 'k2', 'k 1x'))
            select group_id, path, case when keep then 'keep' else 'delete' end as action from chosen""",
        "review_invalid": _with(FILES, EXACT, ANSWERS) + """select group_id, action,
            case when action = 'keep' then 'Invalid input format.'
                 else concat('Invalid file index: ', cast(n_members + 1 as varchar)) end as reason
            from answers where action = 'keep' or action = concat('k', cast(n_members + 1 as varchar))""",
        "report_exact": exact + """select group_id, (member_rank - 1) // 10000 as part, max(size) as size_bytes,
            max(wasted_bytes) as wasted_bytes, string_agg(path, '|' order by path) as files from members group by 1, 2""",
        "report_near": near + """select group_id, (member_rank - 1) // 10000 as part,
            string_agg(concat(path, ':', cast(distance as varchar)), '|' order by path) as files from near_far group by 1, 2""",
    }
