import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from twinsift.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


def reference_encoder():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def odd_texts():
    rng = random.Random(4)
    out = [None, "", " ", "\n\n  \t x", "it's we'll I'd 'tis", "a<|endoftext|>b<|endoftext|><|endoftext|>", "<|endoftext", "ünïcödé ☃ 😀👨‍👩‍👧 مرحبا 你好世界", "x\x1cy\x85z w\xa0v", "0123456789" * 20, "z" * 5000, "ab" * 3000, " " * 300 + "x"]
    for n in (3, 10, 40, 200):
        for _ in range(40):
            out.append("".join(rng.choice(rng.choice(["abcdefgh ", "ABC xyz", " .,!?'", "0123", "éèüñ", "\n\t ", "日本語", "😀☃"])) for _ in range(n)))
            out.append(" ".join("".join(rng.choice(("th", "er", "on", "an", "tion", "eux", "ñ", "ing", "q", "x", "z")) for _ in range(rng.randint(1, 6))) for _ in range(n // 3)))
    return out


def test_same_as_the_library(spark):
    texts = odd_texts()
    schema = "doc_id bigint, text string, ids string"
    rows = {r.doc_id: r for r in bpe.token_digests(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], schema).repartition(3)).collect()}
    own = reference_encoder()
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        ids = own.encode(text or "", add_special_tokens=False).ids
        assert rows[i].n_tokens == len(ids), text
        assert rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), text
        assert rows[i].decoded_sha256 == hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest(), text


def test_pairs_against_merging():
    v = bpe.vocabulary(open(PATH, "rb").read())
    rng = random.Random(1)
    pairs = [(rng.choice(list(v.ids.values())[: 10 ** rng.randint(2, 5)]), rng.choice(list(v.ids.values())[: 10 ** rng.randint(2, 5)])) for _ in range(4000)]
    import numpy as np

    got = v.compatible(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    want = [v.merge(v.tokens[a] + v.tokens[b]) == [a, b] for a, b in pairs]
    assert got.tolist() == want and 0 < sum(want) < len(want)


def test_only_failing_words_are_merged_exactly():
    v = bpe.vocabulary(open(PATH, "rb").read())
    words = [w.encode() for t in odd_texts() if t for w in t.split()]
    flat, count, failed = v.encode_words(words)
    assert 0 < failed < len(words) / 2
    at = 0
    for w, n in zip(words, count):
        assert flat[at : at + n].tolist() == v.merge(w)
        at += n


def test_empty_table(spark):
    assert bpe.token_digests(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
