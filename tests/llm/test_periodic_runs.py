"""Runs against a search of all periods, and the query's digests against a plain computation."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings as hypothesis_settings
from hypothesis import strategies as st

from twinsift.llm.periodic_runs import collapsed, find_runs, planted, run_digests, runs_of


def brute(w):
    """Every period by itself: maximal stretches, without those that have a smaller period."""
    found, n = {}, len(w)
    w = np.asarray(w)
    for q in range(1, n // 3 + 1):
        begin = None
        for i, same in enumerate([*(w[: n - q] == w[q:]).tolist(), False]):
            if same and begin is None:
                begin = i
            elif not same and begin is not None:
                if i + q - begin >= max(24, 3 * q):
                    found.setdefault((begin, i + q), q)
                begin = None
    return sorted((s, e - s, q) for (s, e), q in found.items())


def ours(texts):
    out = [[] for _ in texts]
    for text, *run in zip(*(x.tolist() for x in find_runs([np.array(t, np.int64) for t in texts]))):
        out[text].append(tuple(run))
    return out


def periodic(rng, letters):
    """Nested and adjoining repetitions with noise between them."""
    w = []
    for _ in range(rng.randint(1, 5)):
        w += [rng.randrange(letters) for _ in range(rng.choice([0, 3, 40]))]
        block = [rng.randrange(letters) for _ in range(rng.choice([1, 2, 5, 11, 12, 13, 23, 24, 47, 60, 150]))]
        if rng.random() < 0.4:
            inner = block[: rng.choice([1, 2, 3])]
            block = inner * rng.randint(2, 30) + block
        times = rng.choice([2, 3, 3, 4, 7])
        w += block * times + block[: rng.randrange(len(block))]
    return w


@pytest.mark.parametrize("letters", [1, 2, 3, 50, 10_000])
def test_runs_of_nested_repetitions(letters):
    rng = random.Random(letters)
    texts = [periodic(rng, letters) for _ in range(60)]
    assert ours(texts) == [brute(w) for w in texts]


def test_runs_of_special_words():
    fibonacci, thue = [0], [0]
    a, b = [0], [0, 1]
    while len(b) < 1500:
        a, b = b, b + a
    fibonacci = b
    while len(thue) < 1024:
        thue = thue + [1 - x for x in thue]
    texts = [fibonacci, thue, [5] * 700, [], [1], [2] * 23, [2] * 24, list(range(100)) * 3, list(range(100)) * 2 + list(range(99))]
    assert ours(texts) == [brute(w) for w in texts]


@hypothesis_settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 1), min_size=1, max_size=30), st.integers(1, 6)), max_size=6))
def test_runs_of_any_blocks(blocks):
    w = [x for block, times in blocks for x in block * times]
    assert ours([w, w[::-1]]) == [brute(w), brute(w[::-1])]


def test_texts_do_not_meet():
    same = [list(range(30))] * 4
    assert ours(same) == [[], [], [], []]
    rng = random.Random(3)
    texts = [periodic(rng, 4) if i % 3 else [] for i in range(40)]
    assert ours(texts) == [run for w in texts for run in ours([w])]


SCHEMA = "doc_id bigint, text string, key string, start int"


def test_digests(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randint(1, 400))), "x", 1) for i in range(120)]
    rows += [(200, None, None, None), (201, "", "y", 0), (None, "a b " * 50, "z", 2), (203, " \t\n\x0b\x0c\r", "z", 2)]
    rows += [(204, "\x1c  " * 40, "z", 2), (1, rows[1][1], "x", 1), (205, "long " * 60_000, None, None)]
    got = run_digests(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()

    def want(key, text):
        words = planted([w.encode() for w in (text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w], key)
        runs = [(0, len(words), 1)] if len(set(words)) == 1 and len(words) >= 24 else brute(np.unique(words, return_inverse=True)[1]) if words else []
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        facts = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        return (key, len(runs), *facts, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())

    assert sorted(map(tuple, got), key=str) == sorted((want(r[0], r[1]) for r in rows), key=str)
    assert sum(r.n_runs > 0 for r in got) > 8
    assert run_digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_planted_ends():
    for key in range(300):
        words = [str(i).encode() for i in range(50)]
        h = zlib.crc32(str(key).encode())
        g = h // 10
        a, want = g % 50, list(words)
        if h % 10 == 0:
            p = 1 + (50 - a) // (3 + g % 8)
            want = [words[i] if i < a else words[a + (i - a) % p] for i in range(50)]
        assert planted(words, key) == want


def test_general_results(spark):
    rows = [(1, "x " + "a b c " * 10, None, 0), (2, None, None, 0), (None, "q " * 30, None, 0), (3, "plain words", None, 0)]
    documents = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in runs_of(documents).collect()} == {(1, 1, 30, 3), (None, 0, 30, 1)}
    assert {r.key: r.text for r in collapsed(documents).collect()} == {1: "x a b c", 2: None, None: "q", 3: "plain words"}
    assert runs_of(documents.limit(0)).count() == collapsed(documents.limit(0)).count() == 0
