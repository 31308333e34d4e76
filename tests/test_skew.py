import random

import pytest
from pyspark.sql import functions as F

from twinsift.skew import join_groups, number_rows, with_aggregates
from twinsift.staging import release, scratch_dir, stage, stage_counted


def rows_with_hot_key(spark, n=900):
    rng = random.Random(1)
    rows = [("hot" if i % 3 == 0 else f"k{rng.randrange(80)}", f"p{i:05d}") for i in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, p string").repartition(5)


@pytest.mark.parametrize("limit", [10, 1_000_000])
def test_join_groups_matches_plain_join(spark, settings, limit):
    rows = rows_with_hot_key(spark)
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("p").alias("low")).where("k <> 'k3'")
    want = sorted(map(tuple, rows.join(groups, "k").select("k", "p", "n", "low").collect()))
    with settings(hotRows=limit):
        got = join_groups(rows, groups, ["k"], "n", 900).select("k", "p", "n", "low")
        assert sorted(map(tuple, got.collect())) == want


def test_hot_rows_are_not_shuffled(spark, settings):
    rows = stage(rows_with_hot_key(spark), "rows")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"))
    with settings(hotRows=100):
        joined = join_groups(rows, groups, ["k"], "n", 900)
        plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 2


@pytest.mark.parametrize("limit", [10, 1_000_000])
def test_with_aggregates(spark, settings, limit):
    rows = rows_with_hot_key(spark)
    with settings(hotRows=limit):
        got = with_aggregates(rows, ["k"], {"low": F.min("p"), "high": F.max("p")}, 900, "n")
        assert got.columns == ["k", "p", "low", "high", "n"]
        hot = got.where("k = 'hot'").select("low", "high", "n").distinct().collect()
    assert [tuple(r) for r in hot] == [("p00000", "p00897", 300)]


@pytest.mark.parametrize("limit", [10, 50, 1_000_000])
@pytest.mark.parametrize("keys", [["k"], []])
def test_numbers_are_exact_row_numbers(spark, settings, limit, keys):
    rows = rows_with_hot_key(spark)
    counted = {}
    for r in sorted(rows.collect(), key=lambda r: r.p):
        key = tuple(r[c] for c in keys)
        counted[key] = counted.get(key, 0) + 1
        counted[(r.k, r.p, "n")] = counted[key]
    with settings(hotRows=limit):
        sized = with_aggregates(rows, ["k"], {}, 900, "n")
        got = number_rows(sized, keys, ["p"], "rank", 900, "n" if keys else None).collect()
    assert len(got) == 900
    assert all(counted[(r.k, r.p, "n")] == r["rank"] for r in got)


def test_stage_counts_and_releases(spark):
    staged, n = stage_counted(spark.range(37), "numbers")
    empty, none = stage_counted(spark.range(37).where("id < 0"), "nothing")
    assert (n, staged.count(), none, empty.count()) == (37, 37, 0, 0)
    assert scratch_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    assert release(spark) >= 2
    assert release(spark) == 0
