import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tests.helpers import inventory

from twinsift.functions.paths import component_key, extension, has_preview, is_image_path
from twinsift.functions.text import format_bytes
from twinsift.operators import exact
from twinsift.plans import cleanup, curate, report, review


def members_of(spark, groups):
    """Members from {group: [(path, size, at)]}, with the suggested keeper of no strategy."""
    rows = [
        (min(p for p, *_ in files), len(files), path, size, at)
        for files in groups
        for path, size, at in files
    ]
    return spark.createDataFrame(rows, "group_id string, n_members bigint, path string, size bigint, at bigint").selectExpr(
        "group_id", "n_members", "path", "size", "timestamp_seconds(at) as mtime"
    )


def actions(plan):
    return {(r.path, r.action) for r in plan.collect()}


def kept(plan):
    return sorted(r.path for r in plan.collect() if r.action == "keep")


@pytest.mark.parametrize("limit", [2, 1_000_000])
def test_strategies(spark, settings, limit):
    members = members_of(spark, [[("/f1", 5, 20), ("/f2", 5, 0), ("/f3", 5, 10)]])
    with settings(hotRows=limit):
        assert kept(cleanup.make_plan(members, strategy="oldest")) == ["/f2"]
        assert kept(cleanup.make_plan(members, strategy="newest")) == ["/f1"]
        assert kept(cleanup.make_plan(members, strategy="alpha-first")) == ["/f1"]
    with pytest.raises(ValueError):
        cleanup.make_plan(members, strategy="largest")


def test_ties_go_by_path_components(spark):
    """As strings ``/set.old/x`` is smaller, as paths ``/set/x`` is."""
    members = members_of(spark, [[("/set.old/x", 5, 1), ("/set/x", 5, 1)]])
    for strategy in ("oldest", "newest", "alpha-first"):
        assert kept(cleanup.make_plan(members, strategy=strategy)) == ["/set/x"]


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp", "bigint"])
def test_newest_with_every_time_type(spark, kind):
    members = members_of(spark, [[("/a", 5, 10), ("/b", 5, 30), ("/c", 5, 30)]])
    members = members.withColumn("mtime", F.unix_seconds("mtime") if kind == "bigint" else F.col("mtime").cast(kind))
    assert kept(cleanup.make_plan(members, strategy="newest")) == ["/b"]


def test_a_strategy_that_is_asked_for_overrides_a_keeper(spark):
    files = inventory(spark, {"/a": b"x", "/b": b"x"}, {"/a": 1, "/b": 2})
    members = exact.exact_members(files, strategy="oldest")

    def kept(**asked):
        return [r.path for r in cleanup.make_plan(members, **asked).where("action = 'keep'").collect()]

    assert kept() == ["/a"] == kept(strategy="oldest") and kept(strategy="newest") == ["/b"]


def test_single_member_is_kept(spark):
    assert actions(cleanup.make_plan(members_of(spark, [[("/only", 5, 0)]]))) == {("/only", "keep")}
    assert cleanup.make_plan(members_of(spark, [[("/only", 5, 0)]]).where("false")).count() == 0


def test_plan_over_both_kinds_is_a_bag(spark):
    exact_part = members_of(spark, [[("/a", 100, 0), ("/b", 100, 1)]])
    near_part = members_of(spark, [[("/b", 100, 0), ("/c", 250, 1)], [("/d", 7, 0), ("/a", 100, 5)]])
    plan = cleanup.make_plan(exact_part, near_part)
    assert plan.columns == ["path", "action", "source", "group_id", "size"]
    assert cleanup.plan_totals(plan).first().asDict() == {"n_delete": 3, "n_keep": 3, "reclaim_bytes": 450}
    assert cleanup.dry_run(exact_part, near_part).first().n_delete == 3
    resolved = cleanup.make_plan(exact_part, near_part, resolve=True)
    assert actions(resolved) == {("/a", "delete"), ("/b", "delete"), ("/c", "delete"), ("/d", "keep")}
    chosen = cleanup.initial_selection(plan)
    assert sorted(r.path for r in chosen.collect()) == ["/a", "/b", "/c"]
    # /a and /b are in two groups each, so their bytes count twice
    assert cleanup.selected_totals(chosen, exact_part, near_part).first().asDict() == {"n_selected": 3, "selected_bytes": 650}


def test_selected_bytes(spark):
    exact_part = members_of(spark, [[("fileA", 100, 0), ("fileB", 100, 1)]])
    near_part = members_of(spark, [[("imgA", 200, 0), ("imgB", 250, 1)]])
    chosen = spark.createDataFrame([("fileB",), ("imgB",), ("fileB",)], "path string")
    assert cleanup.selected_totals(chosen, exact_part, near_part).first().asDict() == {"n_selected": 2, "selected_bytes": 350}


# --- apply and undo --------------------------------------------------------------------


def corpus_and_plan(spark):
    corpus = inventory(spark, {"/a": b"x", "/b": b"x", "/c": b"y", "/d": b"y", "/u": b"z"})
    plan = cleanup.make_plan(exact.exact_members(corpus, strategy="alpha-first"))
    return corpus, plan


@pytest.mark.parametrize("broadcast", [0, 200_000])
def test_apply_and_undo_round_trip(spark, settings, broadcast, tmp_path):
    corpus, plan = corpus_and_plan(spark)
    extra = spark.createDataFrame([("/gone", "delete", "exact", "/gone", 3)], plan.schema)
    with settings(broadcastRows=broadcast):
        done = curate.apply_plan(corpus, plan.unionByName(extra), batch_id="batch_7", ts=7)
        assert sorted(r.path for r in done.kept.collect()) == ["/a", "/c", "/u"]
        assert sorted(r.path for r in done.removed.collect()) == ["/b", "/d"]
        assert [r.path for r in done.missing.collect()] == ["/gone"]
        curate.write_batch(done, str(tmp_path))
        quarantine, manifest = curate.read_batches(spark, str(tmp_path), corpus.schema)
        back = curate.undo_last(done.kept, quarantine, manifest)
        assert sorted(map(tuple, back.corpus.collect())) == sorted(map(tuple, corpus.collect()))
        assert back.quarantine.count() == back.manifest.count() == 0
    curate.forget_batch(spark, str(tmp_path), back.batch_id)
    assert curate.undo_last(done.kept, *curate.read_batches(spark, str(tmp_path), corpus.schema)) is None


def test_undo_takes_the_newest_batch_and_replaces_rows(spark):
    corpus, _ = corpus_and_plan(spark)

    def delete(path, batch, ts):
        plan = spark.createDataFrame([(path, "delete")], "path string, action string")
        return curate.apply_plan(corpus, plan, batch_id=batch, ts=ts)

    old, new, tie = delete("/a", "batch_9", 1), delete("/b", "batch_1", 2), delete("/u", "batch_2", 2)
    junk = old.manifest.selectExpr("'batch_x' as batch_id", "cast(null as bigint) as ts", "row_key", "path")
    manifest = old.manifest.unionByName(new.manifest).unionByName(tie.manifest).unionByName(junk)
    quarantine = old.quarantined.unionByName(new.quarantined).unionByName(tie.quarantined)
    assert curate.last_batch(manifest) == "batch_2"
    now = inventory(spark, {"/u": b"another file took the name", "/c": b"y"})
    back = curate.undo_last(now, quarantine, manifest)
    assert {r.path: bytes(r.content) for r in back.corpus.collect()} == {"/u": b"z", "/c": b"y"}
    assert {r.batch_id for r in back.manifest.collect()} == {"batch_9", "batch_1", "batch_x"}
    assert {r.batch_id for r in back.quarantine.collect()} == {"batch_9", "batch_1"}


def test_permanent_removal_leaves_no_batch(spark, tmp_path):
    corpus, plan = corpus_and_plan(spark)
    done = curate.apply_plan(corpus, plan, permanent=True)
    assert done.kept.count() == 3 and done.quarantined is None and done.manifest is None
    with pytest.raises(ValueError):
        curate.write_batch(done, str(tmp_path))
    first, second = curate.new_batch()[0], curate.new_batch()[0]
    assert first.startswith("batch_") and first != second


def wide_table(spark, folder, n=9000):
    """A table of files, whose rows lie in several files of several thousand."""
    made = spark.range(n).selectExpr("concat('/f/', lpad(id, 6, '0')) as path", "encode(id, 'utf-8') as content", "id as size")
    made.repartitionByRange(3, "path").write.parquet(str(folder))
    return spark.read.parquet(str(folder)).selectExpr("path", "size * 2 as size", "content")


def deletes_of(spark, paths):
    return spark.createDataFrame([(p, "delete") for p in paths], "path string, action string")


@pytest.mark.parametrize("limit", [0, 4, 200_000])
def test_places_name_the_rows_to_go(spark, settings, tmp_path, limit):
    table = wide_table(spark, tmp_path / "t")
    gone = [f"/f/{i:06d}" for i in range(9000) if i % 7 == 0 or 4000 <= i < 4200] + ["/f/none"]
    with settings(broadcastRows=limit):
        done = curate.apply_plan(table, deletes_of(spark, gone), batch_id="b1", ts=1)
        kept, removed = ({r.path for r in df.collect()} for df in (done.kept, done.removed))
        assert removed == set(gone) - {"/f/none"} and len(kept) == 9000 - len(removed) and not kept & removed
        assert [r.path for r in done.missing.collect()] == ["/f/none"]
        assert {r.path for r in done.manifest.collect()} == removed
        written = curate.write_batch(done, str(tmp_path / "trash"))
        assert written.success and written.n_rows == len(removed) and written.failed is None
        back = curate.undo_last(done.kept, *curate.read_batches(spark, str(tmp_path / "trash"), table.schema))
        assert sorted(map(tuple, back.corpus.collect())) == sorted(map(tuple, table.collect()))


def test_content_is_not_shuffled(spark, settings, tmp_path):
    table = wide_table(spark, tmp_path / "t")
    deletes = deletes_of(spark, [f"/f/{i:06d}" for i in range(0, 9000, 3)])
    with settings(broadcastRows=8):
        done = curate.apply_plan(table, deletes, batch_id="b1", ts=1)
        for df in (done.kept, done.quarantined):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan.replace("BroadcastExchange", "") and "BroadcastHashJoin" in plan
            assert df.count() in (3000, 6000)
        curate.write_batch(done, str(tmp_path / "trash"))
        quarantine, manifest = curate.read_batches(spark, str(tmp_path / "trash"), table.schema)
        restored = curate.undo_last(table, quarantine, manifest).corpus
        plan = restored._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan.replace("BroadcastExchange", "") and plan.count("BroadcastHashJoin") >= 2
        assert restored.count() == 9000


def test_a_changed_name_in_the_manifest_is_used(spark, settings, tmp_path):
    table = wide_table(spark, tmp_path / "t", 100)
    done = curate.apply_plan(table, deletes_of(spark, ["/f/000001", "/f/000002"]), batch_id="b1", ts=1)
    manifest = done.manifest.selectExpr("batch_id", "ts", "row_key", "concat('/moved', path) as path")
    done.quarantined.write.parquet(str(tmp_path / "q"))
    with settings(broadcastRows=0):
        back = curate.undo_last(done.kept, spark.read.parquet(str(tmp_path / "q")), manifest)
        names = {r.path for r in back.corpus.collect()}
    assert len(names) == 100 and {"/moved/f/000001", "/moved/f/000002"} < names


@pytest.mark.parametrize("broken", ["quarantine", "manifest", "committed"])
def test_a_batch_is_written_whole_or_not_at_all(spark, tmp_path, broken):
    corpus, plan = corpus_and_plan(spark)
    folder = tmp_path / "trash"
    first = curate.apply_plan(corpus, plan, batch_id="batch_1", ts=1)
    second = curate.apply_plan(corpus, plan, batch_id="batch_2", ts=2)
    assert curate.write_batch(first, str(folder)).success
    writer = type(corpus.write)
    real = writer.parquet

    def refuse(self, path, *args, **options):
        if path == f"{folder}/{broken}/batch_id=batch_2":
            raise AnalysisException(f"no room for {path}")
        return real(self, path, *args, **options)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(writer, "parquet", refuse)
        result = curate.write_batch(second, str(folder))
    assert not result.success and result.n_rows == 0 and "batch_2" in result.reason
    assert sorted(r.path for r in result.failed.collect()) == ["/b", "/d"]
    quarantine, manifest = curate.read_batches(spark, str(folder), corpus.schema)
    assert {r.batch_id for r in quarantine.collect()} == {r.batch_id for r in manifest.collect()} == {"batch_1"}
    assert curate.write_batch(second, str(folder)).success  # what the first try left is replaced
    quarantine, manifest = curate.read_batches(spark, str(folder), corpus.schema)
    assert quarantine.count() == manifest.count() == 4
    assert curate.last_batch(manifest) == "batch_2"


def test_nothing_to_move_leaves_no_batch(spark, tmp_path):
    corpus, plan = corpus_and_plan(spark)
    done = curate.apply_plan(corpus, plan.where("false"), batch_id="b", ts=1)
    assert curate.write_batch(done, str(tmp_path)) == curate.Written(True)
    quarantine, manifest = curate.read_batches(spark, str(tmp_path), corpus.schema)
    assert quarantine.columns == ["batch_id", "row_key", *corpus.columns]
    assert quarantine.count() == manifest.count() == 0 and curate.undo_last(corpus, quarantine, manifest) is None
    with pytest.raises(ValueError):
        curate.write_batch(curate.apply_plan(corpus, plan, batch_id="a/b", ts=1), str(tmp_path))


# --- review ----------------------------------------------------------------------------


BAD = "Invalid input format."
WRAPPED = "Invalid file index: 18446744073709551615"

# answers in order, the member that is kept (1-based, 2 is the suggestion), the messages
REVIEWS = [
    (["a"], 2, []),
    ([" a\t"], 2, []),
    (["k3"], 3, []),
    (["k1"], 1, []),
    (["k 2"], 2, []),
    (["k2x"], 2, []),
    (["k+1"], 1, []),
    (["k003"], 3, []),
    (["k-18446744073709551615"], 1, []),
    (["s"], None, []),
    ([""], None, []),
    (["x"], None, [BAD]),
    (["k"], None, [BAD]),
    (["kx"], None, [BAD]),
    (["A"], None, [BAD]),
    (["k99999999999999999999"], None, [BAD]),
    (["k99"], None, ["Invalid file index: 99"]),
    (["k007"], None, ["Invalid file index: 7"]),
    (["k0"], None, ["Invalid file index: 0"]),
    (["k-1"], None, [WRAPPED]),
    (["junk", "", "k9", "k2", "k8", "a"], 2, ["Invalid file index: 9", BAD]),
    ([], None, []),
]


@pytest.mark.parametrize("limit", [2, 1_000_000])
def test_review_answers(spark, settings, limit):
    groups = [[(f"/g{i:02d}/{n}", 5, at) for n, at in ((1, 9), (2, 1), (3, 5))] for i in range(len(REVIEWS))]
    answers = [
        (f"/g{i:02d}/1", text, attempt) for i, (texts, *_) in enumerate(REVIEWS) for attempt, text in enumerate(texts)
    ]
    answers.append(("/no/such/group", "a", 0))
    with settings(hotRows=limit):
        members = cleanup.with_keeper(members_of(spark, groups), "oldest")
        decisions = spark.createDataFrame(answers, "group_id string, action string, attempt int")
        plan, invalid = review.apply_decisions(members, decisions)
        plan, invalid = plan.collect(), invalid.collect()
    for i, (texts, keep, reasons) in enumerate(REVIEWS):
        group = f"/g{i:02d}/1"
        got = {(r.path, r.action) for r in plan if r.group_id == group}
        numbers = (1, 2, 3) if keep else ()
        assert got == {(f"/g{i:02d}/{n}", "keep" if n == keep else "delete") for n in numbers}, texts
        assert sorted(r.reason for r in invalid if r.group_id == group) == sorted(reasons), texts


# --- scalars and reports ---------------------------------------------------------------


def test_byte_texts(spark):
    known = {
        0: "0 B", 1023: "1023 B", 1024: "1.00 KB", 1536: "1.50 KB", 1152: "1.12 KB", 1216: "1.19 KB", 1029: "1.00 KB",
        2**20: "1.00 MB", 3 * 2**19: "1.50 MB", 2**20 - 1: "1024.00 KB", 2**30: "1.00 GB", 2**40: "1.00 TB", 2**50: "1.00 PB",
        2**61: "2048.00 PB",
    }
    df = spark.createDataFrame([(k,) for k in known], "n bigint")
    assert {r.n: r.t for r in df.select("n", format_bytes(F.col("n")).alias("t")).collect()} == known


def test_byte_texts_round_like_exact_decimals(spark):
    df = spark.range(1, 3_000_000, 611).withColumn("t", format_bytes(F.col("id")))
    for row in df.collect():
        power = 0 if row.id < 1024 else 1 if row.id < 2**20 else 2
        want = f"{row.id} B" if power == 0 else f"{row.id / 1024**power:.2f} {['', 'KB', 'MB'][power]}"
        assert row.t == want


def test_extensions(spark):
    known = {
        "a/.png": "", "a/..png": ".png", "x.tar.gz": ".gz", "x.": ".", "a.b/x": "", "/d/A.JPG": ".jpg", "/d/b.Jpeg": ".jpeg",
        "/d/c.gif": ".gif", "/d/noext": "",
    }
    df = spark.createDataFrame([(k,) for k in known], "p string")
    p = F.col("p")
    rows = df.select("p", extension(p).alias("e"), is_image_path(p).alias("i"), has_preview(p).alias("v")).collect()
    assert {r.p: r.e for r in rows} == known
    assert {r.p for r in rows if r.i} == {"a/..png", "/d/A.JPG", "/d/b.Jpeg"}
    assert {r.p for r in rows if r.v} == {"a/..png", "/d/A.JPG", "/d/b.Jpeg", "/d/c.gif"}


def test_component_order(spark):
    paths = ["/a/b", "/a.b/a", "/a", "/a/b/c", "/a-b", "/A", "/a/é", "/a/z"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [r.p for r in df.orderBy(component_key(F.col("p"))).collect()]
    assert got == sorted(paths, key=lambda p: [part.encode() for part in p.split("/")])


def test_group_numbers_previews_and_representatives(spark, settings):
    groups = [[("/b.gif", 3, 0), ("/z", 3, 0)], [("/a", 2, 0), ("/y.png", 2, 0)], [("/c", 1, 0), ("/d", 1, 0)]]
    members = members_of(spark, groups)
    one_each = members.groupBy("group_id").agg(F.count("*").alias("n"))
    for limit in (1, 1_000_000):
        with settings(hotRows=limit):
            numbered = report.number_groups(one_each).collect()
        assert {r.group_id: (r.group_number, r.n_groups) for r in numbered} == {"/a": (1, 3), "/b.gif": (2, 3), "/c": (3, 3)}
    assert {r.group_id: r.is_image for r in report.group_previews(one_each).collect()} == {"/a": False, "/b.gif": True, "/c": False}
    assert sorted(r.path for r in report.representatives(members, near=False).collect()) == ["/a", "/b.gif", "/c"]
    assert report.representatives(members, near=True).count() == 6


def test_report_lists_every_member_in_bounded_parts(spark):
    members = members_of(spark, [[(f"/m{i:02d}", 4, 0) for i in range(25)], [("/x", 1, 0), ("/y", 1, 0)]])
    rows = {(r.group_id, r.part): r for r in report.exact_report(members, part=10).collect()}
    assert [len(rows["/m00", part].files) for part in range(3)] == [10, 10, 5]
    assert [p for part in range(3) for p in rows["/m00", part].files] == [f"/m{i:02d}" for i in range(25)]
    assert [rows["/m00", p].wasted_bytes for p in range(3)] == [96, 0, 0] and rows["/x", 0].size_bytes == 1
