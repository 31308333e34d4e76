import os
from urllib.parse import quote, unquote

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.helpers import checkerboard, gradient, grouped, write_png
from twinsift.operators.exact import exact_members
from twinsift.operators.near import near_members, similarity_listing, skipped_images
from twinsift.plans import scan as jobs
from twinsift.sources import file_content, synthetic
from twinsift.sources import images as images_source
from twinsift.sources.images import hash_listed
from twinsift.sources.listing import _stat, _stat_files, _store_entries, list_tree
from twinsift.staging import release


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "root"
    (root / "sub" / "sub2").mkdir(parents=True)
    (root / "a.txt").write_bytes(b"hello")
    (root / "sub" / "b.txt").write_bytes(b"worlds")
    (root / "sub" / "sub2" / "zero").write_bytes(b"")
    (root / ".hidden").write_bytes(b"h")
    (root / "_under").write_bytes(b"uu")
    (root / "sub" / "näme with späces.txt").write_bytes(b"x" * 10)
    (root / "link_to_file").symlink_to(root / "a.txt")
    (root / "link_to_dir").symlink_to(root / "sub")
    (root / "dangling").symlink_to(root / "nowhere")
    os.mkfifo(root / "pipe")
    with open(os.fsencode(root) + b"/bad\xff.bin", "wb") as file:
        file.write(b"bytes")
    return root


def test_listing_rules(spark, tree):
    found = list_tree(spark, str(tree))
    files = {r.path: r["size"] for r in found.files.select(F.hex("path").alias("path"), "size").collect()}
    names = ["a.txt", "sub/b.txt", "sub/sub2/zero", ".hidden", "_under", "sub/näme with späces.txt"]
    want = {os.fsencode(tree / n).hex().upper(): (tree / n).stat().st_size for n in names}
    want[(os.fsencode(tree) + b"/bad\xff.bin").hex().upper()] = 5
    assert files == want
    skipped = {os.path.basename(r.path): r.reason for r in found.skipped.collect()}
    assert skipped == {
        "link_to_file": "Skipped symlink or inaccessible",
        "dangling": "Skipped unreadable item",
        "pipe": "Skipped non-regular file",
    }
    stats = found.stats.first()
    # the root, sub, sub2, and the linked directory, which is counted but not entered
    assert (stats.files_visited, stats.bytes_visited, stats.directories_visited, stats.items_skipped) == (7, 29, 4, 3)
    when = {os.path.basename(r.path): r.t for r in found.files.select("path", F.unix_micros("mtime").alias("t")).collect() if r.path.isascii()}
    assert when["a.txt"] == (tree / "a.txt").stat().st_mtime_ns // 1000


@pytest.fixture
def plain_tree(tmp_path):
    """A tree of files and folders alone, as a store has them."""
    root = tmp_path / "ro ot%20#1"
    (root / "sub" / "sub2").mkdir(parents=True)
    for name, content in {"a.txt": b"same", "sub/b.txt": b"same", "sub/sub2/zero": b"", ".hidden": b"h", "_under": b"uu", "sub/näme ?&#%41 x": b"x" * 10}.items():
        (root / name).write_bytes(content)
    return root


@pytest.mark.parametrize("tail", ["", "/"])
def test_a_tree_by_its_uri_is_the_same(spark, plain_tree, tail):
    """Through pyarrow's file systems, as trees that are not mounted are listed."""
    by_path = list_tree(spark, str(plain_tree))
    uri = f"file://{quote(str(plain_tree))}{tail}"
    by_uri = list_tree(spark, uri)
    facts = ("size", "mtime_ns", "mtime")
    found = {unquote(r.path.removeprefix("file://")): tuple(r[c] for c in facts) for r in by_uri.files.collect()}
    assert found == {r.path: tuple(r[c] for c in facts) for r in by_path.files.collect()} and len(found) == 6
    assert by_uri.stats.drop("duration_ms").first() == by_path.stats.drop("duration_ms").first()
    assert by_uri.skipped.count() == 0
    members = {verify: file_content.exact_file_members(by_uri.files, verify).collect() for verify in ("sha256", "bytes")}
    for rows in members.values():
        assert sorted(os.path.basename(r.path) for r in rows) == ["a.txt", "b.txt"]
    scan = jobs.scan_tree(spark, uri, min_size=1)
    assert sorted(r.action for r in jobs.plan_cleanup(scan).collect()) == ["delete", "keep"]


def test_what_a_store_cannot_give(spark, plain_tree):
    for root in (f"file://{plain_tree}/none", "file:///dev/null", "nostore://x/y"):
        assert [r.reason for r in list_tree(spark, root).skipped.collect()] == ["Root is not a valid directory"]
    gone = f"file://{quote(str(plain_tree))}/gone"
    assert _stat(gone.encode()) == (None, None, "Skipped unreadable size")
    assert _stat(f"file://{quote(str(plain_tree))}/sub".encode())[2] == "Skipped non-regular file"
    ((path, kind),) = _entries_of(gone)
    assert path == gone.encode() and kind.startswith("Iteration error")


def _entries_of(uri):
    return list(_store_entries(uri.encode()))


def test_times_are_exact_to_the_nanosecond(spark, tmp_path):
    at = 1_796_171_612_518_170_840
    times = {"a": at, "b": at + 100, "c": -1_500, "d": 999}
    for name, ns in times.items():
        (tmp_path / name).write_bytes(b"x")
        os.utime(tmp_path / name, ns=(ns, ns))
    times = {name: os.lstat(tmp_path / name).st_mtime_ns for name in times}  # as the file system keeps them
    raw = [os.fsencode(tmp_path / name) for name in (*times, "gone")]  # one that can't be read must not touch the others
    batch = pa.RecordBatch.from_arrays([pa.array(raw, pa.binary())], ["path"])
    (read,) = _stat_files(iter([batch]))
    assert read.column("mtime_ns").to_pylist() == [*times.values(), None]
    files = list_tree(spark, str(tmp_path)).files
    found = {os.path.basename(r.path): (r.mtime_ns, r.us) for r in files.select("path", "mtime_ns", F.unix_micros("mtime").alias("us")).collect()}
    assert found == {name: (ns, ns // 1000) for name, ns in times.items()}
    oldest = exact_file_members_of(files)
    assert os.path.basename(oldest) == "c"


def exact_file_members_of(files):
    (keeper,) = {r.keeper for r in file_content.exact_file_members(files, strategy="oldest", mtime="mtime_ns").collect()}
    return keeper


def test_min_size_drops_silently(spark, tree):
    found = list_tree(spark, str(tree), min_size=6)
    assert sorted(os.path.basename(r.path) for r in found.files.collect()) == ["b.txt", "näme with späces.txt"]
    stats = found.stats.first()
    assert (stats.files_visited, stats.bytes_visited, stats.items_skipped) == (2, 16, 3)


def test_empty_and_missing_roots(spark, tmp_path):
    empty = list_tree(spark, str(tmp_path)).stats.first()
    assert (empty.files_visited, empty.directories_visited, empty.items_skipped) == (0, 1, 0)
    none = list_tree(spark, str(tmp_path / "none"))
    stats = none.stats.first()
    assert (stats.files_visited, stats.directories_visited, stats.items_skipped) == (0, 0, 1)
    assert none.files.count() == 0 and none.skipped.first().reason == "Root is not a valid directory"
    with pytest.raises(ValueError, match="not a valid directory"):
        jobs.scan_tree(spark, str(tmp_path / "none"))


def test_long_path(spark, tmp_path):
    deep = tmp_path.joinpath(*["d" * 60] * 6)
    deep.mkdir(parents=True)
    (deep / "f").write_bytes(b"1")
    assert list_tree(spark, str(tmp_path)).stats.first().directories_visited == 7


@pytest.mark.parametrize("verify", ["sha256", "bytes"])
def test_exact_groups_of_files(spark, tmp_path, verify):
    big = os.urandom(153_600)
    contents = {
        "c1": b"DATA", "c2": b"DATA", "c3": b"DATA", "n": b"NOPE", "five": b"12345", "e1": b"", "e2": b"",
        "big1": big, "big2": b"!" + big[1:], "big3": big[:-1] + b"!", "big4": big, "gone": b"DATA",
    }
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    listing = list_tree(spark, str(tmp_path))
    (tmp_path / "gone").unlink()  # vanishes before it is read
    members = file_content.exact_file_members(listing.files, verify, strategy="alpha-first")
    names = {os.path.basename(g): [os.path.basename(p) for p in m] for g, m in grouped(members).items()}
    assert names == {"c1": ["c1", "c2", "c3"], "e1": ["e1", "e2"], "big1": ["big1", "big4"]}
    assert all(r.keeper == r.group_id for r in members.collect())


def test_unequal_files_with_one_fingerprint(spark, tmp_path):
    """What a collision leaves over is compared with its own first file."""
    for name, content in {"a1": b"AA", "b1": b"BB", "a2": b"AA", "b2": b"BB", "c": b"CC"}.items():
        (tmp_path / name).write_bytes(content)
    files = list_tree(spark, str(tmp_path)).files.withColumn("fingerprint", F.lit(1).cast("bigint"))
    confirmed, _ = file_content._confirmed(files, 5)
    heads = {os.path.basename(r.path): os.path.basename(r.head) for r in confirmed.collect()}
    assert heads == {"a1": "a1", "a2": "a1", "b1": "b1", "b2": "b1"}


@pytest.fixture
def pictures(tmp_path):
    root = tmp_path / "pictures"
    (root / "more").mkdir(parents=True)
    write_png(root / "ramp +1%.png", 100, 100, gradient(100))
    write_png(root / "more" / "ramp2.JPG", 200, 150, gradient(200))
    write_png(root / "inverted.png", 100, 100, gradient(100, inverted=True))
    write_png(root / "check.bmp", 100, 100, checkerboard)
    (root / "bad.jpeg").write_bytes(b"this is no image")
    (root / "cut.png").write_bytes((root / "ramp +1%.png").read_bytes()[:60])
    (root / "note.txt").write_bytes(b"text")
    return root


def test_image_source(spark, pictures):
    images = hash_listed(list_tree(spark, str(pictures)).files)
    hashes = {
        os.path.basename(r.path): None if r.h is None else r.h.lower().rjust(16, "0")
        for r in images.select("path", F.hex("dhash").alias("h")).collect()
    }
    assert hashes == {
        "ramp +1%.png": "f" * 16, "ramp2.JPG": "f" * 16, "inverted.png": "0" * 16, "check.bmp": "a54a4aa54aa5a54a",
        "bad.jpeg": None, "cut.png": None,
    }


def test_images_are_read_folder_by_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(images_source, "IMAGES_PER_READ", 2)
    for i in range(9):
        write_png(tmp_path / f"{i}.png", 20, 20, gradient(20) if i % 2 else checkerboard)
    reads = []
    real = images_source.decode_linked
    monkeypatch.setattr(images_source, "decode_linked", lambda spark, folder: reads.append(folder) or real(spark, folder))
    found = hash_listed(list_tree(spark, str(tmp_path)).files)
    hashes = {os.path.basename(r.path): r.dhash for r in found.collect()}
    assert len(hashes) == 9 and None not in hashes.values() and len(set(hashes.values())) == 2
    assert 2 < len(reads) <= 5 and len(set(reads)) == len(reads)
    links = os.path.dirname(reads[0].removeprefix("file://"))
    assert sum(len(names) for _, _, names in os.walk(links)) == 9
    release(spark)
    assert not os.path.exists(links) and len(os.listdir(tmp_path)) == 9


@pytest.mark.parametrize("spelling", ["{}", "{}/", "{}/../x [1]", "//{}", "./x [1]"])
def test_no_image_is_lost(spark, tmp_path, monkeypatch, spelling):
    """Hidden names and folders, and any spelling of a root that looks like a pattern."""
    root = tmp_path / "x [1]"
    (root / "_sub").mkdir(parents=True)
    for name in ("a.png", "_b.png", ".c.png", "_sub/d.png"):
        write_png(root / name, 30, 30, gradient(30))
    monkeypatch.chdir(tmp_path)
    scan = jobs.scan_tree(spark, spelling.format(root), near=True)
    assert grouped(scan.near) == grouped(scan.exact) and [len(g) for g in grouped(scan.near).values()] == [4]
    assert scan.skipped_images.count() == 0


def test_no_images_at_all(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"x")
    assert hash_listed(list_tree(spark, str(tmp_path)).files).collect() == []


def test_times_below_a_microsecond_decide(spark, tmp_path):
    for name, ns in (("a", 1_700_000_000_000_000_900), ("b", 1_700_000_000_000_000_100)):
        (tmp_path / name).write_bytes(b"same")
        os.utime(tmp_path / name, ns=(ns, ns))
    scan = jobs.scan_tree(spark, str(tmp_path))
    assert {os.path.basename(r.keeper) for r in scan.exact.collect()} == {"b"}


def test_files_that_vanish_take_one_round(spark, tmp_path):
    for i in range(6):
        (tmp_path / f"f{i}").write_bytes(b"same bytes")
    files = list_tree(spark, str(tmp_path)).files
    rows = files.withColumn("fingerprint", F.lit(1).cast("bigint"))
    for i in (0, 3):
        (tmp_path / f"f{i}").unlink()
    confirmed, _ = file_content._confirmed(rows, 6)
    assert sorted(os.path.basename(r.path) for r in confirmed.collect()) == ["f1", "f2", "f4", "f5"]


def test_near_groups_of_files(spark, pictures):
    images = hash_listed(list_tree(spark, str(pictures)).files)
    assert sorted(os.path.basename(r.path) for r in skipped_images(images).collect()) == ["bad.jpeg", "cut.png"]
    members = near_members(images, 5)
    listing = {os.path.basename(r.path): (r.is_reference, r.distance) for r in similarity_listing(members).collect()}
    assert listing == {"ramp2.JPG": (True, 0), "ramp +1%.png": (False, 0)}


def test_scan_report_and_plan(spark, pictures, tmp_path):
    (pictures / "dup1.txt").write_bytes(b"identical content")
    (pictures / "dup2.txt").write_bytes(b"identical content")
    (pictures / "unique.txt").write_bytes(b"unique content!")
    scan = jobs.scan_tree(spark, str(pictures), near=True, threshold=5)
    jobs.report_scan(scan, str(tmp_path / "report"), verbose=True)

    def section(name):
        return spark.read.json(str(tmp_path / "report" / name)).collect()

    assert section("totals")[0].total_wasted_bytes == 17
    groups = section("groups")
    assert len(groups) == 1 and [os.path.basename(f) for f in groups[0].files] == ["dup1.txt", "dup2.txt"]
    near = section("near_duplicate_groups")
    assert len(near) == 1 and [f.distance_from_reference for f in near[0].files] == [0, 0]
    assert len(section("near_duplicate_skipped_paths")) == 2
    assert section("scan_stats")[0].files_visited == 10
    plan = jobs.plan_cleanup(scan)
    assert {(r.source, r.action): r["count"] for r in plan.groupBy("source", "action").count().collect()} == {
        ("exact", "keep"): 1, ("exact", "delete"): 1, ("near", "keep"): 1, ("near", "delete"): 1,
    }


def test_synthetic_corpus(spark, tmp_path):
    files = synthetic.corpus(spark, 300, 0.2, 100, 3000)
    assert files.count() == 300 and files.select("path").distinct().count() == 300
    assert files.where("size <> octet_length(content) or size not between 100 and 3000").count() == 0
    assert files.select("content").distinct().count() == 240
    assert sorted(map(tuple, synthetic.corpus(spark, 300, 0.2, 100, 3000).collect())) == sorted(map(tuple, files.collect()))
    written = synthetic.write_tree(files, str(tmp_path))
    listing = list_tree(spark, str(tmp_path))
    assert listing.stats.first().bytes_visited == written
    from_table = exact_members(files)
    from_files = file_content.exact_file_members(listing.files)
    strip = len(str(tmp_path))
    assert {g[strip:]: [p[strip:] for p in m] for g, m in grouped(from_files).items()} == grouped(from_table)
    assert synthetic.corpus(spark, 5, 1.0).count() == 0
