"""Toxic passages by maximum-scoring segments of token log-odds.

Every word, and its first letters (a stem may take many endings), has a log-odds of toxic
against other documents under a Dirichlet prior. Significant ones are weights: those of words of either
sign, those of first letters where they speak for toxicity and the word itself says nothing; any
other word weighs a little less than nothing. In a text, all maximal segments of the weights are found in
one linear scan (Ruzzo and Tompa, 1999). By extreme-value theory the best segment of ``n``
random words exceeds ``s`` with a chance of about ``often * n * exp(-rate * s)``, where ``rate``
follows from the weights' distribution in clean text and ``often`` from its segments; what
each segment has beyond that is summed, and a logistic curve turns it into a probability. Weights and curve are fitted
on different rows, so a word that was rare by chance does not pass for a strong one.

The fit uses a bounded sample of labelled rows (``max_rows``); the weights that it may return
are bounded too (``max_features``), so they can be sent to every task.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.staging import ship_package, small_side, stage, stage_counted

#: Labelled rows that a fit uses at most (about), and weights that it may have.
MAX_ROWS, MAX_FEATURES = 30_000, 50_000

#: Lengths of word beginnings that are features besides the whole word.
STEMS = range(3, 8)

#: Weight of a word that says nothing, least significance of a weight, prior count of each.
DRIFT, SIGNIFICANT, PRIOR = -0.25, 2.5, 0.5

#: Letters of a word that stands for itself among the features.
LONGEST = 200

_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    weights: dict[str, float]
    rate: float
    often: float
    slope: float
    offset: float


class Weights(dict):
    """Weight of a word: that of its strongest feature; short words are remembered."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        own, *stems = features(word)
        value = self.weights.get(own)  # a word's own evidence, for or against, comes before its stems'
        if value is None:
            value = max((x for f in stems if (x := self.weights.get(f)) is not None), default=DRIFT)
        if len(word) <= 40:
            if len(self) > 1_000_000:
                self.clear()
            self[word] = value
        return value

    def of(self, text: str) -> np.ndarray:
        found = _LETTERS.findall(text.lower())
        return np.fromiter(map(self.__getitem__, found), float, len(found))


def features(word: str) -> list[str]:
    """The whole word, a very long one by its digest, and its beginnings."""
    own = word if len(word) <= LONGEST else hashlib.sha256(word.encode()).hexdigest()
    return [own, *(word[:k] + "-" for k in STEMS if len(word) > k)]


def segments(weights: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (first, last, score), disjoint and in order.

    Only positive weights open or extend a segment, so the scan visits those and takes what
    lies between them from prefix sums.
    """
    up = np.flatnonzero(weights > 0)
    if not len(up):
        return []
    total = np.cumsum(weights)
    found: list[tuple[int, int, float, float]] = []  # first, last, sum before, sum after
    for at, after, own in zip(up.tolist(), total[up].tolist(), weights[up].tolist()):
        first, before = at, after - own
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= before:
                j -= 1
            if j < 0 or found[j][3] >= after:
                found.append((first, at, before, after))
                break
            first, before = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, after - before) for a, b, before, after in found]


def strength(parts: list[tuple[int, int, float]], n: int, rate: float, often: float) -> float:
    """What the segments of ``n`` words have beyond chance: log(1 + 1 / expected number) of each,
    summed; the logarithm of 1 more, so that one odd row can't bend the curve."""
    return math.log1p(np.logaddexp(0.0, [rate * s - math.log(often * n + 1e-9) for _, _, s in parts]).sum())


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [(t.as_py() or b"").decode("utf-8", "replace") for t in batch.column("text")]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each feature, toxic and not, summed per batch."""
    for batch in batches:
        sums = (Counter(), Counter())
        for text, toxic in zip(_texts(batch), batch.column("toxic").to_pylist()):
            sums[toxic].update({f for w in set(_LETTERS.findall(text.lower())) for f in features(w)})
        names = list(sums[0] | sums[1])
        counts = [pa.array([s[f] for f in names], pa.int64()) for s in sums]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *counts], ["feature", "clean", "toxic"])


def log_odds(counts: DataFrame, n_toxic: int, max_features: int) -> DataFrame:
    """``(feature, weight, z)``: significant log-odds, of either sign, of ``counts(feature, clean, toxic)``."""
    sums = counts.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    sums = stage(sums, "feature-counts")
    all_clean, all_toxic = sums.agg(F.coalesce(F.sum("clean"), F.lit(0)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    odds = lambda c, n: F.log((F.col(c) + PRIOR) / F.greatest(F.lit(n) - F.col(c) + PRIOR, F.lit(PRIOR)))
    weight = odds("toxic", all_toxic) - odds("clean", all_clean)
    z = weight / F.sqrt(1 / (F.col("toxic") + PRIOR) + 1 / (F.col("clean") + PRIOR))
    least = max(3, math.ceil(0.002 * n_toxic))
    strong = sums.where(F.col("toxic") >= least).select("feature", weight.alias("weight"), z.alias("z")).where(F.col("z") >= SIGNIFICANT)
    # Evidence against is that of whole words alone, since stems take endings of all kinds.
    against = sums.where(~F.col("feature").endswith("-")).select("feature", weight.alias("weight"), z.alias("z")).where(F.col("z") <= -SIGNIFICANT)
    return strong.unionByName(against).orderBy(F.desc(F.abs("z")), "feature").limit(max_features)


def _measure(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Weights(weights.value)
        for batch in batches:
            found = [words.of(text) for text in _texts(batch)]
            kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))
            parts = pa.array([[dict(first=a, last=b, score=s) for a, b, s in segments(w)] for w in found], kind)
            ups = pa.array([w[w != DRIFT].tolist() for w in found], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([len(w) for w in found], pa.int32()), parts, ups], ["doc_id", "label", "n", "passages", "ups"])

    return run


_MEASURED = "doc_id bigint, label int, n int, passages array<struct<first int, last int, score double>>, ups array<double>"


def background_rate(n_words: int, ups: np.ndarray, times: np.ndarray | None = None) -> float:
    """The positive solution of mean(exp(rate * weight)) = 1 over clean words; 1 if they never rise.

    ``ups`` are the weights of known words, each ``times`` as often (once); the others weigh ``DRIFT``.
    """
    if not (ups > 0).any() or not n_words:
        return 1.0
    times = np.ones(len(ups)) if times is None else times
    mean = lambda r: ((times * np.exp(r * ups)).sum() + (n_words - times.sum()) * math.exp(r * DRIFT)) / n_words
    low, high = 1e-3, 2.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if mean(mid) > 1 else (mid, high)
    return max(low, 0.05)


def background_tail(n_words: int, scores: np.ndarray, rate: float) -> tuple[float, float]:
    """Rate and frequency of the segments of clean text, by quartiles, which mislabelled rows hardly move.

    ``rate`` is what theory says; it stays where the segments are too few or too equal.
    """
    if len(scores) < 20:
        return rate, 1.0
    middle, high = np.quantile(scores, [0.5, 0.75])
    if high - middle > 1e-3:
        rate = min(math.log(2) / (high - middle), 2 * rate)
    return rate, min(1.0, (scores >= high).sum() / n_words * math.exp(rate * high))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a curve for labels ``y``, with the targets of Platt (1999)."""
    pos, neg = int(y.sum()), int(len(y) - y.sum())
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 0.0, math.log((pos + 1) / (neg + 1))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - target) * x).sum() + 1e-3 * a, (p - target).sum()])
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a), 0.0), float(b)


def fit(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES) -> Model:
    """A model from ``documents(doc_id, text)`` and ``labels(doc_id, toxic)``.

    Rows without a label, labels without a document and null labels don't take part; an id with
    several labels is toxic if one says so. Without toxic and other rows every score is the share
    of toxic rows.
    """
    spark = documents.sparkSession
    ship_package(spark)
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    one, n = stage_counted(one, "labels")
    draw = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000))
    sample = one.withColumn("draw", draw).where(F.col("draw") < int(1e6 * min(1.0, max_rows / max(n, 1))))
    # The sample is bounded by max_rows, up to chance.
    known = documents.select("doc_id", F.col("text").cast("binary").alias("text")).join(small_side(sample, max_rows), "doc_id")
    known = stage(known, "labelled")
    weighing = known.where("draw % 3 < 2").select("text", "toxic")
    n_toxic = weighing.agg(F.coalesce(F.sum("toxic"), F.lit(0))).first()[0]
    chosen = _weights(weighing, n_toxic, max_features)
    shared = spark.sparkContext.broadcast(chosen)
    rest = known.where("draw % 3 = 2").select("doc_id", "text", F.col("toxic").alias("label"))
    measured = stage(rest.mapInArrow(_measure(shared), _MEASURED), "measured")
    rows = measured.drop("ups").collect()  # a third of the sample
    found = measured.where("label = 0").select(F.explode("ups").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    weights = found.collect()  # no more than there are weights
    if not rows:
        return Model(chosen, 1.0, 1.0, 0.0, -30.0)
    clean = [r for r in rows if not r.label]
    rate = background_rate(sum(r.n for r in clean), np.array([r.w for r in weights]), np.array([r.n for r in weights]))
    rate, often = background_tail(sum(r.n for r in clean), np.array([p.score for r in clean for p in r.passages]), rate)
    x = np.array([strength([tuple(p) for p in r.passages], r.n, rate, often) for r in rows])
    slope, offset = logistic(x, np.array([r.label for r in rows]))
    # The curve stands; the weights may use all rows now.
    every = known.select("text", "toxic")
    return Model(_weights(every, every.agg(F.sum("toxic")).first()[0], max_features), rate, often, slope, offset)


def _weights(rows: DataFrame, n_toxic: int, max_features: int) -> dict[str, float]:
    counts = rows.mapInArrow(_count, "feature string, clean bigint, toxic bigint")
    return {r.feature: r.weight for r in log_odds(counts, n_toxic, max_features).collect()}


def passages(documents: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, n, passages, strength, score)`` for every document.

    ``passages`` are the maximal segments that are beyond chance, by word numbers; ``score`` is
    between 0 and 1. Null, empty and blank texts have none and a low score. Equal rows stay.
    """
    ship_package(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model.weights)
    read = documents.select("doc_id", F.col("text").cast("binary").alias("text"), F.lit(None).cast("int").alias("label"))
    found = read.mapInArrow(_measure(shared), _MEASURED)
    chance = F.log(F.lit(model.often) * F.col("n") + 1e-9)
    over = lambda p: F.lit(model.rate) * p["score"] - chance
    strong = found.withColumn("strong", F.filter("passages", lambda p: over(p) > 0))
    total = lambda p: F.aggregate(p, F.lit(0.0), lambda s, x: s + beyond(over(x)))
    beyond = lambda x: F.when(x > 30, x).otherwise(F.log1p(F.exp(x)))
    rated = strong.withColumn("strength", F.log1p(total("passages")))
    score = 1 / (1 + F.exp(-(F.lit(model.slope) * F.col("strength") + model.offset)))
    return rated.select("doc_id", "n", F.col("strong").alias("passages"), "strength", score.alias("score"))


def held_out(doc_id: Column, of: int, part: int) -> Column:
    """Whether crc32 of the id's digits leaves this remainder; null ids don't."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of == part, F.lit(False))


def toxic_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a model fitted on the rows that are not held out."""
    model = fit(documents, labels.where(~held_out(F.col("doc_id"), 4, 2)))
    rated = passages(documents, model)
    return rated.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
