import random

import numpy as np
import pytest

from twinsift.llm.toxicity import DRIFT, Weights, background_rate, features, fit, passages, segments, toxic_documents

SCHEMA = "doc_id bigint, text string, label string, n string"


def by_definition(w):
    """Maximal segments by recursion: the best segment, then the same left and right of it."""
    best = max(((sum(w[i : j + 1]), -(j - i), -i, i, j) for i in range(len(w)) for j in range(i, len(w)) if w[i] > 0 and w[j] > 0), default=None)
    if best is None:
        return []
    i, j = best[3:]
    left, right = by_definition(w[:i]), by_definition(w[j + 1 :])
    return left + [(i, j, best[0])] + [(a + j + 1, b + j + 1, s) for a, b, s in right]


def test_segments_against_definition():
    rng = random.Random(5)
    assert segments(np.array([])) == [] == segments(np.array([-1.0, 0.0]))
    for n in (1, 2, 5, 12, 25):
        for _ in range(60):
            w = [rng.choice((-1, 1)) * (rng.random() + 0.01) for _ in range(n)]
            got, want = segments(np.array(w)), by_definition(w)
            assert [x[:2] for x in got] == [x[:2] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want])


def test_background_rate():
    assert background_rate(0, np.array([])) == 1.0
    ups = np.array([3.0] * 10)
    r = background_rate(1000, ups)
    assert (np.exp(3 * r) * 10 + 990 * np.exp(-0.25 * r)) / 1000 == pytest.approx(1, abs=1e-6)


def corpus(spark, n=1500):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    docs, labels, truth = [], [], {}
    for i in range(n):
        w = [word() for _ in range(rng.randint(0, 200))]
        truth[i] = int(rng.random() < 0.15 and len(w) > 5)
        if truth[i]:
            at = rng.randrange(len(w))
            w[at:at] = [rng.choice(("zorgon", "zorgoff", "Zorgen!!", "quux")) for _ in range(3)]
        docs.append((i, " ".join(w), "x", "y"))
        if i % 2:
            labels.append((i, 1, truth[i]))
    return spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), truth


def test_held_out_accuracy(spark):
    docs, labels, truth = corpus(spark)
    rows = toxic_documents(docs, labels).collect()
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    unseen = [r for r in rows if r.held_out or r.doc_id % 2 == 0]
    assert sum(r.predicted != truth[r.doc_id] for r in unseen) <= 0.01 * len(unseen)


def test_passages_point_at_words(spark):
    docs, labels, truth = corpus(spark)
    model = fit(docs, labels)
    text = "aa bb cc zorgon quux dd " + "ee " * 60 + "Zorgoff zorgoff!"
    one = spark.createDataFrame([(1, text, "x", "y")], SCHEMA)
    found = passages(one, model).first()
    assert [(p.first, p.last) for p in found.passages] == [(3, 4), (66, 67)]


def test_degenerate(spark):
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    docs = [(1, None, "x", "y"), (2, "", "x", "y"), (3, "a b", "x", "y"), (3, "a b", "x", "y"), (None, "w " * 50_000, "x", "y")]
    rows = toxic_documents(spark.createDataFrame(docs, SCHEMA), labels).collect()
    assert len(rows) == 5 and all(r.predicted == 0 for r in rows)
    assert toxic_documents(spark.createDataFrame([], SCHEMA), labels).collect() == []
    nulls = spark.createDataFrame([(1, None), (None, 1), (3, 1), (3, 0)], "doc_id bigint, toxic int")
    assert toxic_documents(spark.createDataFrame(docs, SCHEMA), nulls).count() == 5


def test_evidence_of_both_signs_and_long_words():
    long = "x" * 5000
    assert features(long)[0] != features(long + "y")[0] and len(features(long)[0]) == 64 and features("ab") == ["ab"]
    words = Weights({"class": -2.0, "cla-": 1.5, features(long)[0]: 3.0})
    assert words.of("class clay other " + long).tolist() == [-2.0, 1.5, DRIFT, 3.0]


def test_background_rate_with_clean_words():
    many = np.array([3.0] * 10 + [-1.0] * 200)
    plain, with_times = background_rate(1000, many), background_rate(1000, np.array([3.0, -1.0]), np.array([10, 200]))
    assert plain == pytest.approx(with_times) and with_times > background_rate(1000, many[:10])
    assert background_rate(1000, np.array([-1.0])) == 1.0
