import hashlib
import random
import re

from pyspark.sql import functions as F

from twinsift.llm.winnowing import edited_likeness, hashes, units, winnow, with_next

K, W = 5, 8


def runs_of(spark, texts):
    """Word run hashes by Spark's own hash function, one text at a time."""
    out = []
    for text in texts:
        tokens = [t for t in (text or "").encode().split()]
        if not tokens:
            out.append(([], []))
            continue
        df = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(tokens)], "i int, w string")
        h = [r.h for r in df.orderBy("i").select(F.xxhash64("w").alias("h")).collect()]
        groups = [h[i : i + K] for i in range(len(h) - K + 1)] + [[x] for x in h]
        rows = spark.createDataFrame([(i, *(g + [None] * (K - len(g)))) for i, g in enumerate(groups)], "i int, " + ", ".join(f"h{j} long" for j in range(K)))
        found = [r.x & ((1 << 36) - 1) for r in rows.orderBy("i").select(F.xxhash64(*(f"h{j}" for j in range(K))).alias("x")).collect()]
        out.append((found[: -len(h)], found[-len(h) :]))
    return out


def chosen_by_hand(runs, singles):
    got = [(run, at) for of in (runs, singles) for at, run in enumerate(of)]
    if len(runs) >= 2 * W:
        got = []
    for start in range(len(runs) - W + 1 if len(runs) >= 2 * W else 0):
        window = runs[start : start + W]
        best = min(range(len(window)), key=lambda j: (window[j], -j))
        if (window[best], start + best) not in got:
            got.append((window[best], start + best))
    return got


def test_winnow_against_brute_force(spark):
    texts = ["", None, " \n\t", "one", "a b c", "x " * 40, " ".join(f"w{i % 7}" for i in range(90)), " ".join(f"q{i * i % 31}" for i in range(200))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: [(v >> 27, ((1 << 27) - 1) - (v & ((1 << 27) - 1))) for v in r.c] for r in df.select("i", winnow(F.col("text")).alias("c")).collect()}
    for i, runs in enumerate(runs_of(spark, texts)):
        assert got[i] == chosen_by_hand(*runs), texts[i]


def test_edited_texts(spark):
    texts = {7: "alpha beta gamma delta " * 5, 3: "ünïcode ☃ 😀 text here and there", 12: "", 9: None, 20: "alpha beta gamma delta " * 5, 1: "z" * 3000}
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id bigint, text string, next_text string")
    got = {r.doc_id: r for r in edited_likeness(df).collect()}
    order = sorted(texts, reverse=True)
    for at, i in enumerate(order):
        own, following = texts[i] or "", texts[order[(at + 1) % len(order)]] or ""
        third = len(own) // 3
        edited = own[: len(own) - third] + following[:third]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].n_chars == len(own)
    assert got[7].fingerprint == got[20].fingerprint != ""
    assert got[12].fingerprint == "" and got[12].near_next == 1.0 == got[12].near_edited
    assert got[7].near_next == 0.0


def units_by_hand(text):
    out = []
    for word in re.split("[\\x20\\x09-\\x0D]+", text):
        unspaced = any("\u3040" <= c <= "\u30ff" or "\u4e00" <= c <= "\u9fff" or "\u0e00" <= c <= "\u0e7f" for c in word)
        out += list(word) if unspaced or len(word) > 24 else [word] if word else []
    return out


def test_units(spark):
    texts = ["plain words  here", "x" * 24 + " " + "y" * 25, "中文字 and ひら mixed中", "ไทย a\u00a0b 😀" + "😀" * 24, "", " "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert {r.i: r.u for r in df.select("i", units(F.col("t")).alias("u")).collect()} == {i: units_by_hand(t) for i, t in enumerate(texts)}


def test_texts_without_blanks_and_short_texts_are_like_their_edits(spark):
    rng = random.Random(4)
    texts = [
        "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(3000)), "".join(rng.choice("ABCdef0123456789+/") for _ in range(8000)),
        "one two three four five six", "a few words here now it goes on to some more words yet", "alpha beta gamma",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: (r.near_edited, r.near_next) for r in edited_likeness(df).collect()}
    assert all(got[i][0] >= 0.3 for i in (0, 1)) and all(got[i][0] > 0 for i in got)
    assert all(near < edited for edited, near in got.values())


def test_shared_passages_share_a_hash(spark):
    """The guarantee: any K + W - 1 units in common, wherever they stand, and none without K."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for i in range(60):
        n = (K + W - 1, K + W, 40, K - 1)[i % 4]
        passage = [word() for _ in range(n)] if i % 8 < 4 else list("".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n)))
        join = " " if i % 8 < 4 else ""
        a, b = ([word() for _ in range(rng.randint(12, 30))] + [join.join(passage)] + [word() for _ in range(rng.randint(0, 30))] for _ in range(2))
        rows.append((i, " ".join(a), " ".join(b)))
    df = spark.createDataFrame(rows, "i int, a string, b string")
    shared = df.select("i", F.size(F.array_intersect(*(hashes(winnow(F.col(c))) for c in "ab"))).alias("n"))
    assert all((r.n > 0) == (r.i % 4 != 3) for r in shared.collect())


def test_next_row_over_many_blocks(spark):
    keys = [i * i % 9973 for i in range(400)]
    df = spark.createDataFrame([(k, f"t{k}") for k in set(keys)], "k bigint, t string")
    order = sorted(set(keys), reverse=True)
    got = {r.k: r.n for r in with_next(df, "k", {"n": "t"}, blocks=4096).collect()}
    assert got == {k: f"t{order[(i + 1) % len(order)]}" for i, k in enumerate(order)}


def test_empty_null_and_repeated(spark):
    schema = "doc_id bigint, text string"
    assert edited_likeness(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, "a b"), (1, "a b"), (None, "c d e f g h i j k l m n"), (None, None)]
    got = edited_likeness(spark.createDataFrame(rows, schema)).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "None", "None"]
