import zlib
from collections import defaultdict

import pytest

from twinsift.llm.sharding import running_totals, sharded_documents

SCHEMA = "doc_id bigint, text string, size string, shard string"


def check(rows, docs, n=8):
    texts = sorted((d[0] is not None, d[0] or 0, (d[1] or "")) for d in docs)
    assert len(rows) == len(docs) and [r[:2] for r in texts] == sorted((r.doc_id is not None, r.doc_id or 0) for r in rows)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < n
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_balance_groups_and_slots(spark):
    docs = [(i, "word " * (i * 37 % 91), None, "x") for i in range(3000)] + [(5000 + i, "copy", None, "x") for i in range(200)] + [(7000, None, None, "x"), (7001, "", None, "x")]
    rows = sharded_documents(spark.createDataFrame(docs, SCHEMA)).collect()
    check(rows, docs)
    text = {d[0]: d[1] or "" for d in docs}
    load, where = defaultdict(int), defaultdict(set)
    for r in rows:
        assert r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
        load[r.shard] += r.size
        where[text[r.doc_id]].add(r.shard)
    assert max(load.values()) <= 1.12 * sum(load.values()) / 8
    assert len(where["copy"]) == 1


@pytest.mark.parametrize("limit", [1_000_000, 30])
def test_a_third_of_rows_are_empty(spark, settings, limit):
    """They are few bytes, hence one unit in one shard, whose rows are numbered over many tasks."""
    docs = [(i, "word " * (20 + i % 30), None, "x") for i in range(600)] + [(1000 + i, "", None, "x") for i in range(300)] + [(None, "", None, "x")] * 3
    with settings(hotRows=limit):
        rows = sharded_documents(spark.createDataFrame(docs, SCHEMA).repartition(4)).collect()
    check(rows, docs)
    empty = sorted((r.doc_id or -1, r.slot) for r in rows if r.size == 1)
    assert len({r.shard for r in rows if r.size == 1}) == 1 and len(empty) == 303
    slots = [slot for _, slot in empty]
    assert slots[3:] == sorted(slots[3:]) and sorted(slots) == list(range(min(slots), min(slots) + 303))


def test_hot_group_is_split_in_order(spark):
    docs = [(i, "same text", None, "x") for i in range(1000)]
    rows = sharded_documents(spark.createDataFrame(docs, SCHEMA)).collect()
    check(rows, docs)
    counts = defaultdict(int)
    for r in rows:
        counts[r.shard] += 1
    assert sorted(counts.values()) == [125] * 8
    ordered = [r.shard for r in sorted(rows, key=lambda r: r.doc_id)]
    assert ordered == sorted(ordered)


@pytest.mark.parametrize("docs", [[], [(1, "a", None, "x")], [(None, None, None, None), (None, "b", None, "x"), (1, "c", None, "x"), (1, "c", None, "x")]])
def test_few_null_and_repeated(spark, docs):
    rows = sharded_documents(spark.createDataFrame(docs, SCHEMA)).collect()
    check(rows, docs)


def test_running_totals_against_brute_force(spark):
    rows = [(i * 31 % 500, i % 13) for i in range(500)]
    got = {r.k: r.before for r in running_totals(spark.createDataFrame(rows, "k int, n int"), ["k"], {"before": "n"}, slices=7).collect()}
    total = 0
    for k, n in sorted(rows):
        assert got[k] == total
        total += n
