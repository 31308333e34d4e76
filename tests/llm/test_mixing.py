from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from twinsift.llm.mixing import mix, mixed_documents, repeat_documents, source_targets

SCHEMA = "doc_id bigint, text string, source string, target string"


def targets_by_hand(sizes):
    """Share by weight; whoever is above its limit stays there and the rest is shared again."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, open_, target = float(sum(sizes.values())), set(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if unit * weight[s] > 3 * sizes[s]}
        for s in over or open_:
            target[s] = 3.0 * sizes[s] if over else unit * weight[s]
        left -= sum(target[s] for s in over)
        open_ -= over or open_
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 3, None: 50}, {"a": 5}, {"a": 0, "b": 7, "é": 7, "z": 7}, {f"s{i}": 3**i % 1009 for i in range(25)}])
def test_targets(spark, sizes):
    got = source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()
    want = targets_by_hand(sizes)
    assert {r.source: pytest.approx(r.target) for r in got} == want


def test_mix_takes_targets(spark):
    docs = [(i, "w " * (i * 17 % 300), ("hot", "hot", "b", "c", None)[i % 5], "x") for i in range(800)] + [(900, None, "hot", "x"), (901, "few words here", "tiny", "x")]
    df = spark.createDataFrame(docs, SCHEMA)
    rows = mixed_documents(df).collect()
    assert sorted(r.doc_id for r in rows) == sorted(d[0] for d in docs)
    source = {d[0]: d[2] for d in docs}
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert r.size == len((docs[r.doc_id] if r.doc_id < 800 else docs[r.doc_id - 100])[1].split() if r.doc_id != 900 else [])
        assert 0 <= r.taken <= 3 * r.size
        size[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert target == {s: pytest.approx(t) for s, t in targets_by_hand(size).items()}
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target)
    again = {(r.doc_id, r.taken) for r in mixed_documents(df.repartition(5)).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}
    repeated = defaultdict(int)
    for r in repeat_documents(df).collect():
        repeated[r.doc_id] += 1
    assert all(abs(repeated[r.doc_id] - r.target / r.source_size) < 1 for r in rows if r.size)


def test_schedule_is_even(spark):
    sized = spark.createDataFrame([(f"s{i % 6}", 40 + i % 7) for i in range(3000)], "source string, size bigint")
    pieces, rows = mix(sized, block=100)
    target = {r.source_size: r.target for r in rows.select("source_size", "target").distinct().collect()}
    assert len(target) >= 1
    slots = pieces.groupBy("slot", "source_no").agg(F.sum("length").alias("n")).collect()
    assert len({r.slot for r in slots}) == len(slots) and sum(r.n for r in slots) == pytest.approx(sum(40 + i % 7 for i in range(3000)), abs=6)
    share = {r.source_no: r.t / sum(40 + i % 7 for i in range(3000)) for r in source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))).select("source_no", F.col("target").alias("t")).collect()}
    for upto in (200, 500, 900):
        for no, part in share.items():
            assert abs(sum(r.source_no == no and r.slot < upto for r in slots) - part * upto) <= 4


@pytest.mark.parametrize("docs", [[], [(1, None, None, None)], [(1, "a b", "s", "x")] * 4, [(None, "a b c", None, "x"), (None, "", "s", "x")]])
def test_empty_null_repeated(spark, docs):
    df = spark.createDataFrame(docs, SCHEMA)
    rows = mixed_documents(df).collect()
    assert len(rows) == len(docs)
    assert sum(r.taken for r in rows) == sum(r.size for r in rows)
    assert repeat_documents(df).columns == df.columns
