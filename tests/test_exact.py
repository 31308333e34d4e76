import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import grouped, inventory
from twinsift.functions import content as content_module
from twinsift.functions.content import files_identical
from twinsift.operators import exact

VERIFY = ["sha256", "bytes"]


def test_buckets_of_unique_sizes(spark):
    files = spark.createDataFrame([(f"/f{i}", i * 100) for i in range(1, 6)], "path string, size bigint")
    assert exact.size_buckets(files).count() == 5
    assert exact.dup_size_candidates(files).count() == 0


def test_buckets_of_matching_sizes(spark):
    sizes = [100, 100, 200, 300, 300, 300]
    files = spark.createDataFrame([(f"/f{i}", s) for i, s in enumerate(sizes)], "path string, size bigint")
    found = exact.dup_size_candidates(files).groupBy("size").count().collect()
    assert {r["size"]: r["count"] for r in found} == {100: 2, 300: 3}


def test_min_size_is_inclusive(spark):
    files = spark.createDataFrame([("/a", 9), ("/b", 10), ("/c", 11)], "path string, size bigint")
    assert sorted(r.path for r in exact.min_size_filter(files, 10).collect()) == ["/b", "/c"]


@pytest.mark.parametrize("verify", VERIFY)
def test_copies_sets_and_unrelated_files(spark, verify):
    big = b"A" * 153_600
    files = inventory(
        spark,
        {
            "/d/c1": b"DATA", "/d/c2": b"DATA", "/d/c3": b"DATA", "/d/other": b"NOPE", "/d/five": b"12345",
            "/foo1": b"FOO", "/foo2": b"FOO", "/bar1": b"BARBAZ", "/bar2": b"BARBAZ",
            "/s/a": b"SAME_SIZE_DIFF_A", "/s/b": b"SAME_SIZE_DIFF_B",
            "/e1": b"", "/e2": b"", "/e3": b"",
            "/big1": big, "/big2": b"B" + big[1:], "/big3": big[:-1] + b"B", "/big4": big,
        },
    )
    groups = grouped(exact.exact_members(files, verify))
    assert groups == {
        "/d/c1": ["/d/c1", "/d/c2", "/d/c3"],
        "/foo1": ["/foo1", "/foo2"],
        "/bar1": ["/bar1", "/bar2"],
        "/e1": ["/e1", "/e2", "/e3"],
        "/big1": ["/big1", "/big4"],
    }
    wasted = {r.group_id: r.wasted_bytes for r in exact.exact_groups(files, verify).collect()}
    assert wasted == {"/d/c1": 8, "/foo1": 3, "/bar1": 6, "/e1": 0, "/big1": 153_600}


@pytest.mark.parametrize("verify", VERIFY)
def test_unreadable_files_are_no_duplicates(spark, verify):
    files = inventory(spark, {"/a": b"DATA", "/b": b"DATA", "/c": None, "/d": None})
    assert grouped(exact.exact_members(files, verify)) == {"/a": ["/a", "/b"]}


@pytest.mark.parametrize("limit", [1_000_000, 5])
@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_bytes_tell_colliding_fingerprints_apart(spark, settings, limit, broadcast):
    contents = {"/a1": b"AAAA", "/a2": b"AAAA", "/b1": b"BBBB", "/b2": b"BBBB", "/c": b"CCCC", "/d1": b"D", "/d2": b"D"}
    files = inventory(spark, contents)
    with settings(hotRows=limit, broadcastRows=broadcast):
        members = exact.exact_members(files, "bytes", make_fingerprint=lambda c: F.lit(7).cast("bigint"))
        assert grouped(members) == {"/a1": ["/a1", "/a2"], "/b1": ["/b1", "/b2"], "/d1": ["/d1", "/d2"]}
        assert {r.n_members for r in members.collect()} == {2}


def test_result_is_the_same_every_time(spark):
    contents = {f"/r/{i:03d}": f"content number {i % 10:04d}".encode() for i in range(100)}
    files = inventory(spark, contents)
    first = grouped(exact.exact_members(files))
    assert len(first) == 10 and all(len(m) == 10 for m in first.values())
    assert grouped(exact.exact_members(files.repartition(7))) == first


@pytest.mark.parametrize("verify", VERIFY)
def test_one_content_in_a_third_of_all_rows(spark, settings, verify):
    """Forced through the paths for hot groups, the result equals the plain one."""
    rng = random.Random(5)
    contents = {}
    for i in range(600):
        content = b"hot" if i % 3 == 0 else b"cold %d" % rng.randrange(250)
        contents[f"/x/{i:04d}"] = content
    files = inventory(spark, contents)
    plain = exact.rank_members(exact.exact_members(files, verify, strategy="newest"))
    want = sorted(map(tuple, plain.collect()))
    assert max(r[1] for r in want) == 200
    with settings(hotRows=20):
        hot = exact.rank_members(exact.exact_members(files, verify, strategy="newest"))
        assert hot.columns == plain.columns
        assert sorted(map(tuple, hot.collect())) == want


def test_total_and_order_of_waste(spark):
    files = inventory(
        spark,
        {"/a1": b"x" * 17, "/a2": b"x" * 17, "/u": b"unique content!", "/b1": b"y" * 30, "/b2": b"y" * 30,
         "/c1": b"z" * 17, "/c2": b"z" * 17},
    )
    groups = exact.exact_groups(files)
    assert exact.total_wasted(groups).first().asDict() == {"n_groups": 3, "total_wasted_bytes": 64}
    assert [r.group_id for r in exact.by_waste(groups).collect()] == ["/b1", "/a1", "/c1"]
    assert [r.group_id for r in exact.by_waste(groups, 2).collect()] == ["/b1", "/a1"]
    assert exact.total_wasted(exact.exact_groups(files.where("false"))).first().total_wasted_bytes == 0


def test_pair_predicate(spark):
    rows = [
        ("/a", 1, b"x", "/a", 1, b"x", True),
        ("/a", 1, None, "/a", 1, None, True),
        ("/a", 1, b"x", "/b", 1, b"x", True),
        ("/a", 1, b"x", "/b", 1, b"y", False),
        ("/a", 1, b"x", "/b", 2, b"xx", False),
        ("/a", 0, b"", "/b", 0, b"", True),
        ("/a", 1, None, "/b", 1, b"x", False),
    ]
    df = spark.createDataFrame(rows, "pa string, sa long, ca binary, pb string, sb long, cb binary, want boolean")
    same = files_identical(*(F.col(c) for c in ("pa", "sa", "ca", "pb", "sb", "cb")))
    assert df.where(same != F.col("want")).count() == 0


def test_identical_to_first_of_its_size(spark):
    files = inventory(spark, {"/a": b"one", "/b": b"two", "/c": b"one", "/d": b"alone"})
    found = {r.path: (r.first_path, r.identical) for r in exact.identical_to_first(files).collect()}
    assert found == {"/a": ("/a", True), "/b": ("/a", False), "/c": ("/a", True)}


def test_pieces_of_contents(spark, monkeypatch):
    monkeypatch.setattr(content_module, "FIRST_PIECE", 4)
    data = [b"", b"abc", b"abcd", b"abcde", bytes(range(12)), bytes(range(13)), bytes(range(250)) * 2, None]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(data)], "i int, content binary")
    got = {r.i: r.p for r in df.select("i", content_module.digests_of_pieces(F.col("content")).alias("p")).collect()}
    for i, whole in enumerate(data):
        want, at, size = [], 0, 4
        while whole is not None and (at < len(whole) or not want):
            want.append(bytearray(hashlib.sha256(whole[at : at + size]).digest()))
            at, size = at + size, 2 * size
        assert got[i] == (None if whole is None else want)


@pytest.mark.parametrize("broadcast", [0, 200_000])
def test_contents_are_not_shuffled(spark, settings, tmp_path, broadcast):
    """Neither by digests nor piece by piece, where fingerprints collide and where they do not."""
    rows = [(f"/{i:03d}", f"{i % 40:040d}" * (i % 3 + 1)) for i in range(200)]
    spark.createDataFrame(rows, "path string, content string").repartition(3).write.parquet(str(tmp_path / "t"))
    files = spark.read.parquet(str(tmp_path / "t")).selectExpr("path", "cast(octet_length(content) as bigint) as size", "timestamp'2024-01-01' as mtime", "content")
    want = {}
    for path, content in rows:
        want.setdefault(content, []).append(path)
    want = sorted(sorted(paths) for paths in want.values() if len(paths) > 1)
    plans = []
    real = exact.stage_counted

    def watched(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, label)

    with settings(broadcastRows=broadcast), pytest.MonkeyPatch.context() as patch:
        patch.setattr(exact, "stage_counted", watched)
        for same in (False, True):
            extra = {"make_fingerprint": lambda c: F.lit(7).cast("bigint")} if same else {}
            members = exact.exact_members(files, "bytes", **extra)
            plans.append(members._jdf.queryExecution().executedPlan().toString())
            assert sorted(sorted(paths) for paths in grouped(members).values()) == want
        groups = exact.exact_groups(files)
        plans.append(groups._jdf.queryExecution().executedPlan().toString())
        assert groups.count() == len(want)
    shuffled = [line for plan in plans for line in plan.split("Exchange hashpartitioning")[1:] if "content#" in line.splitlines()[0]]
    assert not shuffled and all("Join [content" not in plan for plan in plans)
    assert not any("Exchange" in plan.replace("BroadcastExchange", "").replace("ReusedExchange", "") and "content#" in plan for plan in plans)
