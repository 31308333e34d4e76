import random
import re

import pytest

from twinsift.llm.jaccard_join import classes, keep_one, linked_documents

SCHEMA = "doc_id bigint, text string, sig string, component_id string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def by_hand(docs, k, percent):
    sets = {d[0]: shingles(d[1], k) for d in docs}
    boss = {i: i for i in sets}

    def find(i):
        while boss[i] != i:
            i = boss[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((find(a), find(b)))
                boss[high] = low
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, n_bases=12, copies=14):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 5)))
    texts = [None, "", " \t", "A b", "a B", "a b c", "A  B\nC", "x y", "ÄÖ b c", "äÖ b c"]
    for _ in range(n_bases):
        base = [word() for _ in range(rng.choice((5, 40, 120, 300)))]
        texts.append(" ".join(base))
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 1)] = [word()][: rng.randint(0, 1)]
            texts.append(" ".join(w))
    texts += [" ".join(word() for _ in range(60)) for _ in range(40)]
    rng.shuffle(texts)
    return [(i * 3 + 1, t, "x", "y") for i, t in enumerate(texts)]


@pytest.mark.parametrize("few, bucket, width", [(8, 4096, 1024), (2, 4096, 64), (2, 6, 64)])
def test_groups_against_brute_force(spark, few, bucket, width):
    """Also with tiny buckets, and with bitmaps so small that verification refuses candidates."""
    docs = corpus(few + bucket)
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    got = {r.key: (r.n, r.component_id) for r in classes(df, 3, 90, width=width, few=few, bucket=bucket).collect()}
    assert got == by_hand(docs, 3, 90)


def test_other_parameters_and_one_of_each_group(spark):
    docs = corpus(5, n_bases=6)
    df = spark.createDataFrame(docs, SCHEMA)
    want = by_hand(docs, 5, 80)
    got = {r.key: (r.n, r.component_id) for r in classes(df, 5, 80).collect()}
    assert got == want
    kept = keep_one(df)
    assert kept.columns == df.columns
    left = [r.doc_id for r in kept.collect()]
    assert len(left) == len({want[i][1] for i in left}) == len({c for _, c in want.values()})


def test_empty_null_and_repeated(spark):
    assert linked_documents(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = [(None, "a b c d", "x", "y"), (None, None, "x", "y"), (5, "a b c d", "x", "y"), (5, "a b c d", "x", "y"), (2, "a b c e", "x", "y")]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in linked_documents(spark.createDataFrame(docs, SCHEMA)).collect())
    assert got == [("2", 2, "2"), ("5", 2, "5"), ("5", 2, "5"), ("None", 0, "None"), ("None", 2, "5")]
