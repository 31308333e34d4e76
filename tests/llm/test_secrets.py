import hashlib
import random
import time

from twinsift.llm.secrets import candidates, described, findings, redact

SCHEMA = "doc_id bigint, text string, source string, n_chars bigint, value string"


def corpus():
    rng = random.Random(2)
    word = lambda n=9: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, n)))
    docs, secret = [], {}
    for i in range(400):
        w = [word() for _ in range(60)]
        if i % 8 == 0:
            secret[i] = "".join(rng.choice("0123456789abcdef") for _ in range(40))
            w[20:20] = ["token", "=", f'"{secret[i]}"###']
        if i % 5 == 0:
            w.insert(7, word(9) * 5 + "nesslationship")
        if i % 7 == 0:
            w[30:30] = ["commit", "2669109448945250"]
        docs.append((i, " ".join(w), f"s{i % 4}" if i % 9 else None, 1, "x"))
    return docs + [(1000, None, "s", 0, "x"), (1001, "", None, 0, "x"), (1002, "é" * 30_000, "s", 0, "x")], secret


def test_candidates_have_their_surroundings(spark):
    df = spark.createDataFrame([(1, 'set api_key="abcdefgh12345678XY" now x_y/aaaaaaaaaaaaaaaa=bbbbbb éabcdefghabcdefgh', "p", 1, "x")], SCHEMA)
    rows = sorted((r.word_no, r.part, r.value, r.before, r.after) for r in candidates(df).collect())
    assert rows == [(1, 0, "abcdefgh12345678XY", 'set api_key="', "now"), (3, 0, "x_y/aaaaaaaaaaaaaaaa=bbbbbb", 'api_key="abcdefgh12345678XY" now ', "éabcdefghabcdefgh")]


def test_secrets_are_found_and_others_left(spark):
    docs, secret = corpus()
    rows = findings(spark.createDataFrame(docs, SCHEMA).repartition(3)).collect()
    got = {(r.doc_id, r.value_sha256) for r in rows if r.is_secret}
    assert got == {(i, hashlib.sha256(s.encode()).hexdigest()) for i, s in secret.items()}
    assert len(rows) > len(got) and all(0 <= r.score <= 1 for r in rows)


def test_redaction(spark):
    docs, secret = corpus()
    df = spark.createDataFrame(docs + docs[:1], SCHEMA)
    out = redact(df)
    assert out.columns == df.columns
    rows = out.collect()
    assert len(rows) == len(docs) + 1
    text = {d[0]: d[1] for d in docs}
    for r in rows:
        want = text[r.doc_id].replace(secret[r.doc_id], "<secret>") if r.doc_id in secret else text[r.doc_id]
        assert r.text == want and (r.doc_id not in secret or r.n_chars == len(want))


def test_without_candidates(spark):
    assert findings(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(None, None, None, None, None), (1, "a b c", "s", 1, "x")], SCHEMA)
    assert findings(df).collect() == [] and redact(df).count() == 2


def test_candidates_by_context(spark):
    text = 'say password = "hunter2! x" or pwd=a.b#c; and\n"api_key": "é@1", then postgres://bob:s3c@ret@db.host/x end http://plain.host/a:b'
    df = spark.createDataFrame([(1, text, "p", 1, "x")], SCHEMA)
    rows = {(r.word_no, r.value) for r in candidates(df).collect()}
    assert rows == {(3, "hunter2! x"), (6, "a.b#c"), (9, "é@1"), (11, "s3c@ret")}


def test_short_secrets_are_redacted(spark):
    docs, _ = corpus()
    short = [(2000 + i, f"plain words password = \"hunter{i}!\" and hunter more", "s1", 1, "x") for i in range(30)]
    got = {r.doc_id: r.text for r in redact(spark.createDataFrame(docs + short, SCHEMA)).collect()}
    assert all(got[2000 + i] == "plain words password = \"<secret>\" and hunter more" for i in range(30))


def test_prose_and_code_are_left(spark):
    """What has a secret's name before it and is none stays, beside real ones of the same shape."""
    docs, _ = corpus()
    rng = random.Random(8)
    made = lambda: "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQR23456789!%#") for _ in range(rng.randint(8, 14))) + "7"
    harmless = [
        'password: "the password field is required"', "token = None", "secret: see chapter two", "The key token: remember to bring water",
        "api_key = os.environ(KEY)", 'password = "${DB_PASSWORD}"', "secret = settings.secret_key", "auth: <your token>", 'pwd = "changeme"', "token=null,",
    ]
    plain = {3000 + i: f"plain words {harmless[i % len(harmless)]} and more" for i in range(60)}
    planted = {4000 + i: made() for i in range(60)}
    shapes = ('password = "{}" and more', "pwd={} and more", "api_key: '{}' and more")
    texts = plain | {i: "plain words " + shapes[i % 3].format(v) for i, v in planted.items()}
    rows = docs + [(i, t, f"s{i % 4}", 1, "x") for i, t in texts.items()]
    got = {r.doc_id: r.text for r in redact(spark.createDataFrame(rows, SCHEMA)).collect()}
    lost = [t for i, t in plain.items() if got[i] != t]
    found = [i for i, v in planted.items() if got[i] == texts[i].replace(v, "<secret>")]
    assert not lost
    assert len(found) >= 0.9 * len(planted)
    clean = [i for i, t in ((d[0], d[1]) for d in docs) if i % 8 and got[i] != t]
    assert len(clean) <= (len(found) + 50) // 10  # of what was taken for a secret


def test_a_value_goes_only_where_it_stands(spark):
    docs, _ = corpus()
    key = "0a1b2c3d4e5f60718293a4b5c6d7e8f901234567"
    text = f'token = "{key}" path/{key}/x {key}ff ({key}) pwd=ab1\\Ec pwd=ab1\\Ecd pwd=ab1\\Ec'
    df = spark.createDataFrame(docs + [(5000, text, "s1", 1, "x")], SCHEMA)
    (out,) = [r.text for r in redact(df).collect() if r.doc_id == 5000]
    assert out.startswith(f'token = "<secret>" path/{key}/x {key}ff (<secret>)')


def test_long_series_of_stops_take_linear_time(spark):
    rows = [(1, "token=a" + "," * 100_000 + "b", "s", 1, "x"), (2, "token=" + "a;" * 100_000, "s", 1, "x"), (3, "password='" + "x" * 200_000, "s", 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    start = time.perf_counter()
    found = {r.value[:3] + r.value[-1] for r in candidates(df).collect()}
    assert time.perf_counter() - start < 6 and "a,,b" in found


def test_dictionary_is_a_small_part_of_the_plan(spark):
    rng = random.Random(8)
    known = [rng.random() < 0.3 for _ in range(26**3)]
    values = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzAZ09") for _ in range(rng.randint(1, 60))) for _ in range(200)] + ["zzz", "aaa", "é", "aaB"]
    found = described(spark.createDataFrame([(v, "", "", "", "") for v in values], "value string, before string, after string, path string, lead string"), known)
    assert len(found._jdf.queryExecution().analyzed().toJSON()) < 2_000_000  # no literal for each letter triple
    for r in found.collect():
        t = r.value.lower()
        triples = [t[i : i + 3] for i in range(len(t) - 2) if all("a" <= c <= "z" for c in t[i : i + 3])]
        want = sum(known[(ord(a) - 97) * 676 + (ord(b) - 97) * 26 + ord(c) - 97] for a, b, c in triples)
        assert abs(r.coverage - want / max(len(t) - 2, 1)) < 1e-12
