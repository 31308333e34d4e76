"""Ranked search against scores of all documents, and bounds against the scores they bound."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from twinsift.llm import ranked_search
from twinsift.llm.ranked_search import Segment, segment_of, terms, top_documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(documents, items, k=10):
    found = [(key, Counter(plain_terms(text))) for key, text in documents]
    n_docs, n_words = sum(bool(c) for _, c in found), sum(c.total() for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scored = []
        for key, c in found:
            m = 25 + 75 * c.total() * n_docs // n_words if n_words else 0
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in plain_terms(text) if t in c
            )
            if score > 0:
                scored.append((-score, key is None, key or 0))
        out += [(item, rank + 1, None if none else key, -score) for rank, (score, none, key) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def test_terms():
    text = "Ab9-\x00É d e f_g{h}\x7fZz퟿中文, 1.5"
    assert [t.decode() for t in terms(text.encode())] == plain_terms(text)
    assert terms(None) == terms(b"") == terms(b" -\x00") == []


SCHEMA = "doc_id bigint, text string, key string, n int, score int"


def made(rng, n, words):
    weight = [1 / (i + 1) for i in range(len(words))]
    return [" ".join(rng.choices(words, weight, k=rng.choice([1, 3, 20, 60]))) for _ in range(n)]


@pytest.mark.parametrize("segment, block", [(1024, 32), (40, 4)])
def test_ranks(spark, monkeypatch, segment, block):
    rng = random.Random(segment)
    words = [f"w{i}" for i in range(300)]
    texts = made(rng, 400, words)
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, texts[i % 3]) for i in range(60)]
    rows += [(None, texts[5]), (None, None), (2000, None), (2001, ""), (2002, " -- \n"), (7, texts[7]), (7, texts[7])]
    rows += [(2003, "w1 w299 " * 20_000), (2004, "W3 É中文 w3É")]
    items = list(enumerate(made(rng, 25, words))) + [(90, None), (91, ""), (92, "unknown"), (93, "É中文 w3é W3"), (3, "w1 w1 W1"), (None, "w2")]
    documents = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)
    asked = spark.createDataFrame([(*r, "x", 1) for r in items], "item_id bigint, text string, doc_id string, rank int")
    got = []
    with monkeypatch.context() as patch:
        patch.setattr(ranked_search, "SEGMENT", segment)  # the driver's values travel only with closures
        patch.setattr(ranked_search, "ITEMS", 20)
        got = sorted((tuple(r) for r in top_documents(documents, asked).collect()), key=str)
    assert got == brute(rows, items)
    assert top_documents(documents, asked, k=3).count() == len(brute(rows, items, 3))


def test_empty_tables(spark):
    documents = spark.createDataFrame([(1, "a b", "", 0, 0)], SCHEMA)
    items = spark.createDataFrame([("i", "a c")], "item_id string, text string")
    assert [tuple(r)[:3] for r in top_documents(documents, items).collect()] == [("i", 1, 1)]
    assert top_documents(documents.limit(0), items).count() == 0
    assert top_documents(documents, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    assert top_documents(documents, spark.createDataFrame([("i", None)], "item_id string, text string")).count() == 0


def test_bounds_and_skips():
    rng = np.random.default_rng(3)
    n, n_terms, n_items = 600, 200, 70
    topics = rng.integers(0, 6, n)  # documents of one topic share their words
    of = [np.unique(np.concatenate([rng.integers(0, 12, 6), 12 + 31 * t + rng.integers(0, 31, 9)])) for t in topics]
    ptr = np.r_[0, np.cumsum([len(x) for x in of])]
    term, impact = np.concatenate(of), rng.integers(1, 900_000, ptr[-1])
    asked = [np.unique(np.r_[rng.integers(0, 12, 3), 12 + 31 * (i % 6) + rng.integers(0, 31, 5)]) for i in range(n_items)]
    bits = np.zeros((n_terms, 2), np.uint64)
    for i, at in enumerate(asked):
        bits[at, i // 64] |= np.uint64(1 << i % 64)
    weights = np.r_[rng.integers(1, 400, 12), rng.integers(2000, 8000, n_terms - 12)]  # frequent words weigh little
    keys = np.arange(n) + 5
    arrays = segment_of(keys, ptr, term, impact, weights, bits)
    segment = Segment({k: v.tobytes() for k, v in arrays.items()}, n_terms)
    dense = np.zeros((n, n_terms), np.int64)
    dense[np.repeat(np.arange(n), np.diff(ptr)), term] = impact
    assert len(arrays["shared"]) and (arrays["block_term"] >= 0).any()
    total = 0
    for at in asked:
        gains = np.zeros(n_terms, np.int64)
        gains[at] = weights[at]
        want = dense @ gains
        every = segment.blocks_for(at, gains[at], 1)
        bounds = segment.bounds(every, gains)
        for block, bound in zip(every, bounds):
            docs = arrays["block_docs"][arrays["block_ptr"][block] : arrays["block_ptr"][block + 1]]
            assert want[docs].max() <= bound
        least = int(np.sort(want)[-10])
        blocks = segment.blocks_for(at, gains[at], least)
        blocks = blocks[segment.bounds(blocks, gains) >= least]
        before = segment.scored
        found, scores = segment.scores(blocks, gains)
        total += segment.scored - before
        assert (scores == want[found - 5]).all()
        assert set(np.flatnonzero(want >= least) + 5) <= set(found)
    assert total < 0.6 * n * n_items  # blocks are skipped
