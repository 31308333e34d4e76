"""Secrets in texts: candidates by form and by context, and a random forest that removes false positives.

A candidate by form is a run of 16 or more characters as keys are made of, standing alone. One by
context is the whole value, of any length and characters, after a secret's name and = or :, or the
password of user:password@host. The forest
judges it by its length, by how often it passes between letters and digits or between cases, by
how much of it the dictionary covers (letter triples that many documents use), by its path (the
document's source: its name, and how often its candidates are labelled) and by its neighbouring
words. It is trained from labelled findings, of which ``max_rows`` at most (about) are used.

Everything runs on Spark's own functions and its random forest.
"""

from __future__ import annotations

import uuid

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.llm.common import numbered, passing_columns, words
from twinsift.staging import scratch_dir, small_side, stage, stage_counted

#: Form of a candidate.
FORM = r"(?<![\p{L}\p{N}])[A-Za-z0-9_+/=\-]{16,}(?![\p{L}\p{N}])"

#: Candidates by context: what leads to a value, and the value, to its quote or the end of its word.
LEAD = (
    r"""(?i:token|secret|passw|pwd|api.?key|access.?key|private.?key|auth|bearer|credential|client.?key)[\w\-]{0,40}["'`\]]?\s{0,20}(?:=>|:=|==|[=:](?!//))\s{0,20}["'`]?+"""
    r"""|://[^\s:/@]{0,200}:|(?<![\w.%+\-:/])[\w.%+\-]{1,200}:(?=[^\s/:@]{1,200}@[\w.\-]+[:/.])"""
)
VALUE = (
    r"""(?<=://[^\s:/@]{0,200}:)[^\s/]+(?=@[\w\[])|(?<=")(?:(?!(?<!\\)")[^\n])++(?=")|(?<=')(?:(?!(?<!\\)')[^\n])++(?=')|(?<=`)(?:(?!(?<!\\)`)[^\n])++(?=`)"""
    r"""|(?<!//[^\s:/@]{0,200}:)(?<=:)[^\s/:]+(?=@[\w.\-]+[:/.])|(?<!//[^\s:/@]{0,200}:)(?![/"'`])(?:[^\s,;&"'`]|&(?![\w.\-]{1,40}=)|[,;"'`]++(?!(?<=[;,])[\w.\-]{1,40}=)(?=\S))++"""
)
CONTEXT = f"({LEAD})({VALUE})"

# Words around secrets, around other long strings, and in paths of samples.
NAMES = r"(?i)(token|secret|passw|pwd|api.?key|access.?key|private.?key|auth|bearer|credential|client.?key)"
OTHERS = r"(?i)(sha\d*|md5|hash|digest|checksum|commit|uuid|guid|http|www|example|sample|dummy|xxxx)"
SAMPLES = r"(?i)(test|example|sample|mock|fixture|doc)"
#: Values that stand for no secret, whatever name they are assigned to.
PLACEHOLDERS = (
    r"(?i)^(none|null|nil|true|false|undefined|todo|tbd|n/?a|required|optional|str|string|bytes|int|value|your[\w\- ]*|change[\-_ ]?me|example|redacted|hidden"
    r"|x{3,}|\*{3,}|\.{3,}|<[^>]*>|\$\{[^}]*\}|\$\(.*|\$\w+|%\w+%|\{\{.*|[A-Za-z_][\w.]*\(.*|[A-Za-z_]\w*(\.[A-Za-z_]\w*)+)$"
)
FORMATS = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk_(live|test)_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9\-]{10,}|AIza[A-Za-z0-9_\-]{35}|glpat-[A-Za-z0-9_\-]{20}|eyJ[A-Za-z0-9_\-]{10,})"

#: Labelled findings used by a fit at most (about); trees and depth of the forest.
MAX_ROWS, TREES, DEPTH = 20_000, 20, 6

#: Share of documents that makes a letter triple part of the dictionary.
COMMON = 0.02

#: Share of a value's letter triples in the dictionary from which a value of letters alone is prose.
PROSE = 0.5

FEATURES = ["log_length", "letter_digit", "case_turns", "digits", "coverage", "in_sample_path", "path_rate", "named", "other", "assigned", "quoted", "known_format"]


def candidates(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """``(key, word_no, part, value, before, after, path, lead)`` for every candidate of every document.

    Candidates by context have a ``lead``, the text that leads to the value, and parts below 0.
    """
    every = documents.select(F.col(key).alias("key"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), F.col(text).alias("text"))
    read = every.where(F.col("text").rlike(FORM))
    cut = read.select("key", "path", words(F.col("text")).alias("w"))
    at = F.filter(F.transform("w", lambda x, i: F.struct(i.alias("word_no"), x.alias("word"))), lambda s: s["word"].rlike(FORM))
    one = cut.select("key", "path", "w", F.inline(at))
    around = one.select(
        "key", "path", "word_no", "word",
        F.concat_ws(" ", F.get("w", F.col("word_no") - 2), F.get("w", F.col("word_no") - 1)).alias("left"),
        F.coalesce(F.get("w", F.col("word_no") + 1), F.lit("")).alias("after"),
    )
    parts = around.select("key", "path", "word_no", "word", "left", "after", F.posexplode(F.regexp_extract_all("word", F.lit(FORM), F.lit(0))).alias("part", "value"))
    by_form = parts.select("key", "word_no", "part", "value", F.concat_ws(" ", "left", F.expr("substring_index(word, value, 1)")).alias("before"), "after", "path", F.lit("").alias("lead"))
    return by_form.unionByName(_by_context(every.where(F.col("text").rlike(CONTEXT))))


def _by_context(read: DataFrame) -> DataFrame:
    # The text is cut into pieces that each end with a value, so that words can be counted up to it.
    every = lambda group: F.regexp_extract_all("text", F.lit(f"\\G(?s:.*?){CONTEXT}"), F.lit(group))
    starts = lambda t: F.size(F.split(t, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")) - 1
    cut = read.select("key", "path", "text", every(0).alias("piece"), every(1).alias("leads"), every(2).alias("values"))
    rest = F.expr("substring(text, 1 + int(aggregate(piece, 0L, (n, x) -> n + length(x))))")
    cut = cut.select("key", "path", "leads", "values", "piece", rest.alias("rest"), F.transform("piece", starts).alias("starts"), F.col("text").rlike(r"^[^\x20\x09-\x0D]").cast("int").alias("first"))

    def one(value: Column, i: Column) -> Column:
        piece, lead = F.get("piece", i), F.get("leads", i)
        head = piece.substr(F.lit(1), F.length(piece) - F.length(value) + 1)
        earlier = F.aggregate(F.slice("starts", F.lit(1), i), F.lit(0), lambda n, x: n + x)
        after = F.coalesce(F.get(words(F.coalesce(F.get("piece", i + 1), F.col("rest"))), F.lit(0)), F.lit(""))
        return F.struct((earlier + starts(head) + F.col("first") - 1).alias("word_no"), (-1 - i).alias("part"), value.alias("value"), lead.alias("before"), after.alias("after"), lead.alias("lead"))

    found = cut.select("key", "path", F.inline(F.transform("values", one)))
    # Those that have the form of keys throughout are candidates by form already.
    return found.where(~F.col("value").rlike(r"^[A-Za-z0-9_+/=\-]{16,}$")).select("key", "word_no", "part", "value", "before", "after", "path", "lead")


def dictionary(documents: DataFrame, text: str = "text") -> list[bool]:
    """Which of the 26 ** 3 letter triples are in the dictionary, over all documents."""
    triples = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit("(?=([a-z]{3}))"), F.lit(1)))
    n = documents.agg(F.count(F.col(text))).first()[0]
    counts = documents.select(F.explode(triples).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    common = {r.t for r in counts.where(F.col("n") >= COMMON * n).collect()}  # at most 17,576 rows
    letters = "abcdefghijklmnopqrstuvwxyz"
    return [a + b + c in common for a in letters for b in letters for c in letters]


def _turns(value: Column, one: str, other: str) -> Column:
    return (F.size(F.split(value, f"(?<=[{one}])(?=[{other}])|(?<=[{other}])(?=[{one}])")) - 1) / F.length(value)


def described(found: DataFrame, known: list[bool]) -> DataFrame:
    """Candidates with their features, but for ``path_rate``."""
    # 63 triples a number: a literal for each triple makes plans that fill the driver's memory.
    packed = [sum(x << i for i, x in enumerate(known[at : at + 63])) for at in range(0, len(known), 63)]
    bits = F.split(F.lit(",".join(map(str, packed))), ",").cast("array<bigint>")
    place = lambda t, i: F.ascii(F.substring(t, i, 1)) - 97
    number = lambda t: place(t, 1) * 676 + place(t, 2) * 26 + place(t, 3)
    triples = F.regexp_extract_all(F.lower("value"), F.lit("(?=([a-z]{3}))"), F.lit(1))
    covered = F.size(F.filter(F.col("_t"), lambda t: F.getbit(F.get(bits, F.floor(number(t) / 63).cast("int")), F.pmod(number(t), F.lit(63))) == 1))
    value, before = F.col("value"), F.col("before")
    flag = lambda c: c.cast("double")
    return found.withColumn("_t", triples).select(
        *found.columns,
        F.log2(F.length(value)).alias("log_length"),
        _turns(value, "A-Za-z", "0-9").alias("letter_digit"),
        _turns(value, "a-z", "A-Z").alias("case_turns"),
        ((F.size(F.split(value, "[0-9]")) - 1) / F.length(value)).alias("digits"),
        (covered / F.greatest(F.length(value) - 2, F.lit(1))).alias("coverage"),
        flag(F.col("path").rlike(SAMPLES)).alias("in_sample_path"),
        flag(before.rlike(NAMES) | F.col("lead").rlike("^://")).alias("named"),
        flag(before.rlike(OTHERS) | F.col("after").rlike(OTHERS)).alias("other"),
        flag(before.rlike(r"[:=]\s*[\"'`]*\s*$")).alias("assigned"),
        flag(before.rlike(r"[\"'`]\s*$")).alias("quoted"),
        flag(value.rlike(FORMATS)).alias("known_format"),
        flag(_harmless(value, F.col("lead"), covered / F.greatest(F.length(value) - 2, F.lit(1)))).alias("harmless"),
    )


def _harmless(value: Column, lead: Column, coverage: Column) -> Column:
    """Whether a value is evidently none: a placeholder, a call, or words as prose has them.

    Prose is letters with blanks and stops alone: several words of which one at least is in the
    dictionary, one word that is mostly in it, or the next word after a colon, without quotes.
    """
    letters = value.rlike(r"^[\p{L}\p{M}\s'’.,!?()\-]+$")
    several = value.rlike(r"\S\s+\S") & (coverage > 0)
    told = lead.rlike(r":\s+$")
    return value.rlike(PLACEHOLDERS) | (letters & (several | told | (coverage >= PROSE)))


def seed_labels(found: DataFrame) -> DataFrame:
    """Labelled findings by rule, where nobody has labelled any: 1 for values with digits that are
    assigned to a name of a secret or have a known format; 0 for those that are harmless in
    themselves, named or not, and for others without name and format."""
    strong = (F.col("named") + F.col("assigned") >= 2) & (F.col("digits") > 0) & (F.col("other") == 0) | (F.col("known_format") > 0)
    weak = (F.col("harmless") > 0) | (F.col("named") + F.col("known_format") == 0)
    return found.withColumn("label", F.when(strong & (F.col("harmless") == 0), 1.0).when(weak, 0.0))


def judged(found: DataFrame, max_rows: int = MAX_ROWS, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """Described candidates with a ``label`` (1, 0 or null), rated by a forest trained on the labelled.

    Adds ``path_rate``, ``score`` and ``is_secret``; what is harmless in itself is no secret. If the labels are of one kind only there is
    nothing to train, and every score is that label (0 without labels).
    """
    paths = found.where("label is not null").groupBy("path").agg(((F.sum("label") + 1) / (F.count("*") + 20)).alias("path_rate"))
    paths, n_paths = stage_counted(paths.toDF("_path", "path_rate"), "secret-paths")
    rated = found.join(small_side(paths, n_paths), F.col("path") == F.col("_path"), "left").drop("_path").fillna(0.05, ["path_rate"])
    kinds = found.where("label is not null").agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("ones")).first()
    if kinds.ones in (0, kinds.n):
        score = 1.0 if kinds.ones else 0.0
        verdict = F.when(F.col("harmless") > 0, 0).otherwise(int(score))
        return rated.withColumns({"score": F.lit(score), "is_secret": verdict})
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="_features")
    sample = stage(_drawn(rated.where("label is not null"), max_rows), "secret-labels")
    forest = RandomForestClassifier(featuresCol="_features", labelCol="label", weightCol="weight", probabilityCol="_p", rawPredictionCol="_r", predictionCol="_y", numTrees=trees, maxDepth=depth, seed=7)
    # Saved and loaded: a model fresh from its fit drags its training summary, and the session, into every task.
    saved = f"{scratch_dir(found.sparkSession)}/secret-forest-{uuid.uuid4().hex}"
    forest.fit(vectors.transform(sample)).save(saved)
    model = RandomForestClassificationModel.load(saved)
    scored = model.transform(vectors.transform(rated)).withColumn("score", vector_to_array("_p")[1])
    verdict = ((F.col("score") >= 0.5) & (F.col("harmless") == 0)).cast("int")
    return scored.withColumn("is_secret", verdict).drop("_features", "_p", "_r", "_y")


def _drawn(labelled: DataFrame, max_rows: int) -> DataFrame:
    """``(label, weight, features)``: at most ``max_rows / 2`` kinds of findings of each label, by chance.

    Findings that look alike to the forest are one kind with their number as its weight, so a
    copied value counts, but fills no room, and each label is there however rare.
    """
    kinds = labelled.groupBy("label", *FEATURES).agg(F.count("*").cast("double").alias("n"))
    spread = F.xxhash64(*FEATURES, F.lit(23))
    parts = []
    for label in (0.0, 1.0):
        mine = kinds.where(F.col("label") == label)
        parts.append(mine.orderBy(spread, *FEATURES).limit(max_rows // 2))
    return parts[0].unionByName(parts[1]).withColumn("weight", F.log2(F.col("n") + 1)).drop("n")


def find(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every candidate of ``documents(key, text, source)`` with features, score and verdict.

    Null and empty texts have none; equal rows have each their own; a null source is the path "";
    an empty table gives no rows.
    """
    known = dictionary(documents)
    found = stage(seed_labels(described(candidates(documents, key), known)), "secret-candidates")
    return judged(found)


def findings(documents: DataFrame) -> DataFrame:
    """Candidates with verdicts; the value itself is given by its digest only."""
    return find(documents).select(
        F.col("key").alias("doc_id"), F.col("word_no").cast("bigint").alias("word_no"), F.col("part").cast("int").alias("part"),
        F.length("value").cast("bigint").alias("length"), F.sha2("value", 256).alias("value_sha256"), "score", "is_secret",
    )


@passing_columns
def redact(documents: DataFrame) -> DataFrame:
    """The documents with every secret replaced by ``<secret>``, and ``n_chars``, if there, renewed.

    Rows are told apart by their place, so null and repeated ids do no harm.
    """
    staged = numbered(documents, "secret-documents")
    # One row for each document with secrets; equal values are replaced together. A value goes only
    # where it stands as it was found: by itself, or between its lead and its end.
    quoted = lambda c: F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    by_form = F.concat(F.lit(r"(?<![\p{L}\p{N}_+/=\-])()"), quoted(F.col("value")), F.lit(r"(?![\p{L}\p{N}_+/=\-])"))
    by_context = F.concat(F.lit("("), quoted(F.col("lead")), F.lit(")"), quoted(F.col("value")), F.lit(r"""(?=$|[\s"'`,;&@])"""))
    values = find(staged, "_row").where("is_secret = 1").select(F.col("key").alias("_row"), F.when(F.col("lead") == "", by_form).otherwise(by_context).alias("pattern"), F.length("value").alias("length")).distinct()
    lists = values.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("length", "pattern")), lambda a, b: b["length"] - a["length"]).alias("_secrets"))
    lists, n = stage_counted(lists, "secret-lists")
    clean = F.aggregate("_secrets", F.col("text"), lambda t, s: F.regexp_replace(t, s["pattern"], F.lit("$1<secret>")))
    joined = staged.join(small_side(lists, n), "_row", "left").withColumn("text", F.when(F.col("_secrets").isNull(), F.col("text")).otherwise(clean))
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        joined = joined.withColumn("n_chars", F.when(F.col("_secrets").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(kind)))
    return joined.select(*documents.columns)
