import random
import re
from collections import Counter

from pyspark.sql import functions as F

from twinsift.llm.quality import base_metrics, keep_good, verdicts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_words string"


def by_hand(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def prose(seed, n=80):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(n))


TEXTS = [None, "", " \n \t", "one", "a b c", "a b c a b c", "x\ny\nx\n\n \nx", "a a a a", "ünï | cödé # 😀 x\x1cy \x0b z", "l one\nl one\n" * 30, prose(1) + "\n" + prose(2), "w " * 3000, "$$$###" * 50]


def test_counts_against_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    m = spark.createDataFrame(rows, "i int, text string").select("i", base_metrics(F.col("text")).alias("m")).collect()
    for r in m:
        got = tuple(r.m[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert got == by_hand(TEXTS[r.i]), TEXTS[r.i]


def test_verdicts(spark):
    clean = [(i, prose(i), ("en", "de", None)[i % 3], f"s{i % 2}" if i % 5 else None, "x") for i in range(300)]
    junk = [(1000, prose(7).replace(" ", "$$ "), "en", "s0", "x"), (1001, prose(8).upper() + "!", "de", "s1", "x"), (1002, prose(9).replace(" ", ""), "en", "s0", "x"), (1003, "a b " * 60, "en", "s0", "x"), (1004, None, "xx", "lonely", "x")]
    docs = spark.createDataFrame(clean + junk, SCHEMA)
    got = {r.doc_id: r for r in verdicts(docs, min_rows=20).collect()}
    assert len(got) == 305
    assert all(got[i].kept for i in range(300))
    assert not any(got[i].kept for i in range(1000, 1005))
    assert got[1003].base_failed and got[1004].base_failed and not got[1000].base_failed
    kept = keep_good(docs, min_rows=20)
    assert kept.columns == docs.columns and kept.count() == 300


def test_limits_differ_between_groups(spark):
    pipes = [(i, " | ".join(prose(i).split(" ")), "en", "tables", "x") for i in range(50)]
    plain = [(100 + i, prose(100 + i), "en", "prose", "x") for i in range(50)]
    odd = [(900, " | ".join(prose(900).split(" ")), "en", "prose", "x"), (901, " | ".join(prose(900).split(" ")), "en", "tables", "x")]
    got = {r.doc_id: r.kept for r in verdicts(spark.createDataFrame(pipes + plain + odd, SCHEMA), min_rows=20).collect()}
    assert not got[900] and got[901] and got[3] and got[103]


def test_empty_and_repeated(spark):
    assert verdicts(spark.createDataFrame([], SCHEMA)).collect() == []
    same = [(1, prose(3), "en", "s", "x")] * 5
    assert [r.kept for r in verdicts(spark.createDataFrame(same, SCHEMA)).collect()] == [True] * 5
