import random

import corpus_pipeline
from twinsift.llm import bpe
from twinsift.staging import staged_paths


def test_stages_in_order(spark, tmp_path):
    rng = random.Random(6)
    prose = lambda: " ".join("".join(rng.choice("aeioulnrstd") for _ in range(rng.randint(2, 8))) for _ in range(120))
    texts = {i: prose() for i in range(60)}
    texts |= {100: texts[3], 101: texts[4] + " more", 102: None, 103: "", 104: "too few words", 105: "junk$$ " * 200}
    secret = "0123456789abcdef0123456789abcdef01234567"
    for i in (7, 8, 9):
        texts[i] += f' token = "{secret[i:]}{i}"'
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, step in corpus_pipeline.STAGES:
        step(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        assert name == "encode" or docs.columns == columns
    assert {r.doc_id for r in seen["quality"]} == {*range(60), 100, 101}
    left = {r.doc_id for r in seen["near_duplicates"]}
    assert len(left) == 60 and len(left & {3, 100}) == 1 == len(left & {4, 101})
    clean = {r.doc_id: r for r in seen["secrets"]}
    assert set(clean) == left and all(secret[10:] not in r.text and r.n_chars == len(r.text) for r in clean.values())
    assert {i for i, r in clean.items() if "<secret>" in r.text} == {7, 8, 9}
    vocab = bpe.vocabulary(open(bpe.default_path(), "rb").read())
    import numpy as np

    for r in seen["encode"]:
        assert vocab.decode(np.array(r.ids, np.int64)).decode() == clean[r.doc_id].text and r.n_tokens == len(r.ids)
    assert len(seen["encode"]) == len(seen["mix"])


def test_odd_rows_and_leftovers(spark, tmp_path):
    """Empty tables, repeated rows, nulls anywhere, very long texts and further columns."""
    schema = "text string, doc_id bigint, lang string, source string, n_chars bigint, size string, _row int"
    rng = random.Random(2)
    long, *prose = (" ".join("".join(rng.choice("aeioulnrstd") for _ in range(rng.randint(2, 8))) for _ in range(n)) for n in (60_000, *[90] * 6))
    rows = [(t, i, "en", "a", len(t), "x", 1) for i, t in enumerate(prose)] + [(prose[0], 0, "en", "a", len(prose[0]), "x", 1)] * 2
    rows += [(prose[1] + " b", None, None, None, None, None, None), (long, 50, "en", "b", len(long), None, None), (None, None, None, None, None, None, None)]
    mine = staged_paths(spark)
    for name, part in (("some", rows), ("none", [])):
        spark.createDataFrame(part, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for stage_name, step in corpus_pipeline.STAGES:
            step(spark, docs, f"{tmp_path}/{name}").write.parquet(f"{tmp_path}/{name}/{stage_name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}/{stage_name}")
            assert stage_name == "encode" or dict(docs.dtypes) == dict(part.split() for part in schema.split(", "))
            assert part or docs.count() == 0
            if part and stage_name == "quality":
                good = [r.text for r in docs.collect()]
                assert long in good and good.count(prose[0]) == 3 and None not in good
            if part and stage_name == "near_duplicates":
                texts = [r.text for r in docs.collect()]
                assert len(texts) == len({t.removesuffix(" b") for t in good}) and {t.removesuffix(" b") for t in texts} == {t.removesuffix(" b") for t in good}
        before = staged_paths(spark)
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert sorted(map(str, out.drop("_x").collect())) == sorted(map(str, docs.collect()))
        added = [path for path in staged_paths(spark) if path not in before]
        assert len(added) == 1 and "pipeline-encode" in added[0] and set(mine) <= set(staged_paths(spark))
