"""Signatures against their definition, groups against all pairs."""

import random

import numpy as np
import pytest

from tests.llm.test_jaccard_join import SCHEMA, by_hand, corpus
from twinsift.llm import super_minhash as module
from twinsift.llm.super_minhash import band_values, kept_documents, near_duplicates, super_minhash


def by_definition(members, places):
    """Each element goes through a permutation of its own; no early end."""
    out = [2**64 - 1] * places
    for e in members.tolist():
        order = list(range(places))
        for j in range(places):
            x = int(module._mix(np.array([(e + (j + 1) * 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0])
            other = j + ((x >> 32) * (places - j) >> 32)
            order[j], order[other] = order[other], order[j]
            out[order[j]] = min(out[order[j]], (j << 32) | (x & 0xFFFFFFFF))
    return out


def test_signatures(monkeypatch):
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 2, 7, 40, 90)]
    want = [by_definition(s, 24) for s in sets]
    assert super_minhash(sets, 24).tolist() == want
    monkeypatch.setattr(module, "CHUNK", 16)
    assert super_minhash(sets, 24).tolist() == want
    assert super_minhash([]).shape == (0, 200)


def test_agreement_is_the_similarity():
    rng = np.random.default_rng(2)
    shares = []
    for _ in range(200):
        pool = np.unique(rng.integers(0, 2**63, 60, dtype=np.uint64))
        a, b = super_minhash([np.sort(pool[:50]), np.sort(pool[10:])])
        shares.append((a == b).mean())
    j = 40 / 60
    assert abs(np.mean(shares) - j) < 0.01
    assert np.var(shares) < 0.9 * j * (1 - j) / 200  # less than with independent hashes
    assert band_values(super_minhash([pool, pool])).shape == (2, 40)


def drift(seed, steps=25, length=120, branches=4):
    """Texts that move away from the first one a little at a time, so that most links pass others by."""
    rng = random.Random(seed)
    texts = []
    for _ in range(branches):
        w = [f"v{rng.randrange(500)}" for _ in range(length)]
        for _ in range(steps):
            texts.append(" ".join(w))
            for _ in range(rng.choice((1, 2, 3))):
                w[rng.randrange(length)] = f"n{rng.randrange(10**6)}"
    rng.shuffle(texts)
    return [(i, t, "x", "y") for i, t in enumerate(texts)]


@pytest.mark.parametrize("cell, group, hot", [(2048, 512, 10**6), (3, 2, 20)])
def test_groups_against_all_pairs(spark, settings, monkeypatch, cell, group, hot):
    monkeypatch.setattr(module, "CELL", cell)
    monkeypatch.setattr(module, "GROUP", group)
    docs = corpus(cell, n_bases=8) + [(10_000 + i, *rest) for i, *rest in drift(cell)]
    with settings(hotRows=hot):
        got = {r.key: (r.n, r.component_id) for r in near_duplicates(spark.createDataFrame(docs, SCHEMA).repartition(3), 4, 80).collect()}
    want = by_hand(docs, 4, 80)
    assert got == want
    assert len({c for i, (_, c) in want.items() if i >= 10_000}) < 40


def test_other_parameters(spark):
    docs = corpus(9, n_bases=5) + [(5000, "w " * 70_000, None, None), (5001, "w " * 60_000 + "v", None, None)]
    rows = near_duplicates(spark.createDataFrame(docs, SCHEMA), 3, 90).collect()
    want = by_hand(docs, 3, 90)
    assert {r.key: (r.n, r.component_id) for r in rows} == want
    assert all(r.kept == (r.key == r.component_id) for r in rows)


def test_empty_null_and_repeated(spark):
    assert kept_documents(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = [(None, "a b c d", "x", "y"), (None, None, "x", "y"), (5, "A b c d", "x", "y"), (5, "a b c d", "x", "y"), (2, "a b c e", "x", "y"), (9, "", "", ""), (None, "q", "", "")]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in kept_documents(spark.createDataFrame(docs, SCHEMA)).collect())
    assert got == [
        ("2", 1, "2", True), ("5", 1, "5", True), ("5", 1, "5", True), ("9", 0, "9", True),
        ("None", 0, "None", True), ("None", 1, "5", False), ("None", 1, "None", True),
    ]
