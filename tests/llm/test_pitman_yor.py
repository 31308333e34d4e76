import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from twinsift.llm import pitman_yor as py

SCHEMA = "doc_id bigint, text string, held string, n string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + [""]


def corpus(n=400):
    rng = random.Random(9)
    nouns = [f"n{i}" for i in range(60)]
    after = {w: rng.sample(nouns, 4) for w in nouns}
    docs = [(500, None, "x", "y"), (501, "", "x", "y"), (502, "Ünknown ÜNKNOWN zzz", "x", "y"), (503, "n1 " * 2000, "x", "y")]
    for i in range(n):
        w = [rng.choice(nouns)]
        for _ in range(rng.randint(0, 60)):
            w.append(rng.choice(after[w[-1]]) if rng.random() < 0.8 else rng.choice(nouns))
        docs.append((i, " ".join(w).upper() if i % 3 else " ".join(w), "x", "y"))
    return docs


def test_base_scores_and_model(spark):
    docs = corpus()
    rows = {r.doc_id: r for r in py.scored_documents(spark.createDataFrame(docs, SCHEMA).repartition(3)).collect()}
    held = {d[0]: zlib.crc32(str(d[0]).encode()) % 5 == 1 for d in docs}
    c = Counter(t for d in docs if not held[d[0]] for t in tokens(d[1]))
    n, v = sum(c.values()), len(c)
    assert len(rows) == len(docs)
    for i, text, *_ in docs:
        r, own = rows[i], tokens(text)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(own), sum(c[t] > 0 for t in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own))
        assert r.score < 0
    unseen = [r for i, r in rows.items() if r.held_out and i < 500]
    assert sum(r.score for r in unseen) > 0.75 * sum(r.base_score for r in unseen)  # a lower perplexity


def test_tables():
    rng = np.random.default_rng(1)
    assert py.tables(np.array([0, 1, 1]), np.array([1.0, 5.0, 0.1]), rng).tolist() == [0, 1, 1]
    many = py.tables(np.full(4000, 6), np.full(4000, 0.7), rng)
    t = np.ones(4000)
    for i in range(1, 6):
        t += rng.random(4000) < 0.7 / (0.7 + i - py.DISCOUNT * t)
    assert abs(many.mean() - t.mean()) < 0.08 and many.min() >= 1 and many.max() <= 6
    assert (py.tables(np.full(50, 10**6), np.full(50, 0.5), rng) < 60).all()


def test_model_by_hand(spark):
    """Pairs that occur once take one table each, so every probability is known."""
    df = spark.createDataFrame([(1, "a b"), (2, "c d"), (3, "a x"), (4, "q b")], "doc_id bigint, text string").selectExpr("doc_id", "text", "doc_id > 2 as held")
    got = {r.doc_id: r.score for r in py.scores(df).collect()}
    d, s = py.DISCOUNT, py.STRENGTH
    # pairs: start-a, a-b, b-end, start-c, c-d, d-end; the parent has customers a b c d once and end twice
    ok = False
    for end_tables in (1, 2):  # sampled
        k, t, v = 6, 4 + end_tables, 5
        parent = lambda c, tab: (c - d * tab + (s + d * t) / (v + 1)) / (s + k)
        one, end, new = parent(1, 1), parent(2, end_tables), parent(0, 0)
        after_start = (1 - d + (s + 2 * d) * one) / (s + 2)
        follow = lambda p, seen: ((1 - d) * seen + (s + d) * p) / (s + 1)
        first = math.log10(after_start * follow(one, True) * follow(end, True))
        unseen = math.log10(after_start * follow(new, False) * end)
        ok |= got[1] == pytest.approx(first, rel=1e-5) and got[3] == pytest.approx(unseen, rel=1e-5)
        assert parent(1, 1) * 4 + end + new == pytest.approx(1)
    assert ok


def test_empty_and_untrained(spark):
    assert py.scored_documents(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (2, None)], "doc_id bigint, text string").selectExpr("doc_id", "text", "true as held")
    rows = py.scores(df).collect()
    assert len(rows) == 3 and all(r.train_tokens == 0 and r.n_known == 0 and r.score <= 0 for r in rows)


def test_hot_context_is_seated_in_slices(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(f"the w{min(int(rng.paretovariate(0.7)), 3000)}" for _ in range(300)), i % 5 == 1) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, held boolean").repartition(3)
    packed = df.select("doc_id", df.text.cast("binary").alias("text"), "held").mapInArrow(py._tokenize, py._DDL).cache()
    hot = py.hot_contexts(packed, 3, 64, 600, 100)
    customers = Counter(a for _, text, held in docs if not held for a, b in zip([""] + tokens(text), tokens(text)))
    assert hot.names.tolist() == [py._Words()[b"the"]] and hot.customers.tolist() == [customers["the"]] and hot.slices[0] > 5
    parts = {}
    for r in packed.mapInArrow(py._ask(64, py.ASK_CONTEXT, hot), py._DDL).collect():
        contexts, runs = py.unpack48(r.x[: 6 * r.n]), py._array(r.x[6 * r.n :], np.int32)
        words = np.split(py.unpack48(r.y), np.cumsum(runs)[:-1])
        for c, w in zip(contexts.tolist(), words):
            if c in hot.names:
                parts.setdefault(r.bucket, []).extend(w.tolist())
    followers = {b for _, text, _ in docs for a, b in zip(tokens(text), tokens(text)[1:]) if a == "the"}
    assert len(parts) > 5 and max(map(len, parts.values())) < sum(map(len, parts.values())) / 2
    assert sum(len(set(w)) for w in parts.values()) == len(followers)  # every word in one slice
    whole = {r.doc_id: r for r in py.scores(df).collect()}
    sliced = {r.doc_id: r for r in py.scores(df, 600, 100).collect()}
    assert len(sliced) == len(docs)
    assert all(sliced[i].base_score == whole[i].base_score for i in sliced)
    assert sum(r.score for r in sliced.values()) == pytest.approx(sum(r.score for r in whole.values()), rel=0.02)


def test_customers_leave_before_they_are_seated_again():
    one = np.zeros(1, np.int64)
    got = [py.seat(np.array([2]), one, one, np.random.default_rng(i))[0][0] for i in range(1500)]
    # The other customer alone: one table here, which is the parent's one customer; one word and the unknown.
    d, s = py.DISCOUNT, py.STRENGTH
    pull = (s + d) * (1 - d + (s + d) / 2) / (s + 1)
    assert abs(np.mean(got) - 1 - pull / (pull + 1 - d)) < 0.025


def test_all_customers_have_a_seat_and_blocks_agree(monkeypatch):
    rng = np.random.default_rng(3)
    customers = np.r_[rng.integers(1, 6, 300), rng.integers(50, 400, 12)]
    context, word = rng.integers(0, 12, 312), rng.integers(0, 50, 312)
    found = []
    for heavy in (16_384, 40):
        monkeypatch.setattr(py, "HEAVY", heavy)
        s = py.Seating(customers, context, word, rng)
        t = np.zeros(312)
        for sweep in range(50):
            s.sweep()
            light = np.flatnonzero(customers <= heavy)
            assert (np.bincount(s.pair, s.size, minlength=312)[light] == customers[light]).all() and (s.table >= 0).all()
            assert (np.bincount(s.pair, s.size > 0, minlength=312)[light] == s.t[light]).all()
            assert all(x.sum() == customers[p] and len(x) == s.t[p] and x.min() > 0 for p, x in s.heavy.items())
            assert (s.here == np.bincount(context, s.t, minlength=12)).all() and (s.of_word == np.bincount(word, s.t, minlength=50)).all() and s.total == s.t.sum()
            t += s.t / 40 if sweep >= 10 else 0
        found.append(t)
    assert found[0].sum() == pytest.approx(found[1].sum(), rel=0.08)


def test_counts_are_added_in_the_type_of_their_array(monkeypatch):
    """``at`` with a number of another type casts every element, at some fifty times the cost."""

    class Same:
        def __init__(self, of):
            self.of, self.seen = of, 0

        def at(self, array, places, by):
            assert np.asarray(by).dtype == array.dtype
            self.seen += 1
            self.of.at(array, places, by)

    class Numpy:
        add, subtract = Same(np.add), Same(np.subtract)

        def __getattr__(self, name):
            return getattr(np, name)

    monkeypatch.setattr(py, "np", Numpy())
    monkeypatch.setattr(py, "HEAVY", 40)
    rng = np.random.default_rng(3)
    py.seat(rng.integers(1, 60, 200), rng.integers(0, 9, 200), rng.integers(0, 30, 200), rng)
    assert Numpy.add.seen and Numpy.subtract.seen


def test_hot_contexts_need_only_their_own_tokens(spark):
    """What is asked of hot contexts alone is what is asked of them among all."""
    docs = [(i, " ".join(f"the w{(i * j) % 41}" for j in range(90)), i % 5 == 1) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, held boolean").repartition(1)
    row = df.select("doc_id", df.text.cast("binary").alias("text"), "held").mapInArrow(py._tokenize, py._DDL).first().asDict()
    names, pairs = py.Batch(row, 64).many(20)
    followers = {b for _, text, _ in docs for a, b in zip(tokens(text), tokens(text)[1:]) if a == "the"}
    assert names.tolist() == [py._Words()[b"the"]] and pairs.tolist() == [len(followers)]
    hot = py.Hot(names.astype(np.uint64), np.array([3]))
    alone = py.Batch(row, 64, hot)
    asked = alone.ask_contexts(0, True)
    assert len(alone.pair) == sum(t == "the" for _, text, _ in docs for t in tokens(text))
    every = {r["bucket"]: dict(zip(py.unpack48(r["y"]).tolist(), py._array(r["z"], np.int32).tolist())) for r in py.Batch(row, 64, hot).ask_contexts(0)}
    for r in asked:
        got = dict(zip(py.unpack48(r["y"]).tolist(), py._array(r["z"], np.int32).tolist()))
        assert got and got.items() <= every[r["bucket"]].items()
    assert sum(int(py._array(r["z"], np.int32).sum()) for r in asked) == sum(t == "the" for i, text, held in docs if not held for t in tokens(text))


@pytest.mark.parametrize("most", [40, 10**9])
def test_batches_hold_every_token(monkeypatch, most):
    monkeypatch.setattr(py, "BATCH", most)
    monkeypatch.setattr(py, "TEXTS", 7)
    monkeypatch.setattr(py, "TaskContext", type("Task", (), {"get": classmethod(lambda cls: cls), "partitionId": classmethod(lambda cls: 0)}))
    rng = random.Random(5)
    parts = ["a", "Be", "ÜN", "the", "\x1f", "\x85", "\u00a0", "\0", "x" * 300]
    texts = [None, "", " \t", " a\n", "\x0b\x0cA\r"] + ["".join(rng.choice(parts) + rng.choice([" ", "\n\n", "\t", " \r\n"]) for _ in range(rng.randint(0, 30))) for _ in range(40)]
    source = [py.pa.record_batch({"doc_id": list(range(a, b)), "text": py.pa.array([t and t.encode() for t in texts[a:b]], py.pa.binary()), "held": [False] * (b - a)}) for a, b in ((0, 5), (5, 5), (5, 45)) if b > a]
    got, sizes = {}, []
    for batch in py._tokenize(iter(source)):
        row = batch.to_pylist()[0]
        own = py.Batch(row, 4)
        sizes.append(own.length.sum())
        assert row["n"] == sizes[-1] and (np.diff(np.bincount(own.word)) <= 0).all()
        for key, start, n in zip(row["doc_id"], own.start, own.length):
            got[key] = own.vocab[own.word[start : start + n]].tolist()
    assert got == {i: [py._Words()[t.encode()] if t else 0 for t in tokens(text)] for i, text in enumerate(texts)}
    assert len(sizes) > 5 if most == 40 else len(sizes) == 1
