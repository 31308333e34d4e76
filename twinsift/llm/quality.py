"""Quality rules with limits that adapt to each language and source.

Every document gets a few rates (symbols, shouting, repeated lines, repeated words, word
length). Their distributions are kept as logarithmic histograms per (lang, source): a quantile
sketch whose merge is the addition of counts, so it is built by a map-side combined count, and
the sketch of a language, or of everything, is the sum of its parts. A document is rejected if
a rate lies far above (for word length also far below) what is usual in its own group.

The limit of a rate is its median plus ``spread`` times the distance from the 10 % quantile to
the median, at least ``slack`` above the median. Only the lower half of a distribution sets its
limit, so a group in which a third of the documents are junk still has the limits of its clean
part. A group of fewer than ``min_rows`` documents takes the limits of its language, and that
those of all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsift.llm.common import let, passing_columns, words
from twinsift.staging import small_side, stage, stage_counted

#: Least distance of a limit from the median, by rate.
SLACK = {"symbols": 0.3, "shouting": 0.1, "dup_lines": 0.5, "repeats": 0.4, "word_length": 1.25}

#: Buckets per factor e of 1 + rate: a quantile is right to 1/200 of that.
RESOLUTION = 200


def base_metrics(text: Column) -> Column:
    """Counts of a text as a struct; all are 0 for a null or blank text."""
    text = F.coalesce(text, F.lit(""))
    return let(_counts(text), lambda c: c.withField("n_dup_lines", (c["lines"]["n"] - c["lines"]["distinct"]).cast("bigint")))


def _counts(text: Column) -> Column:
    return let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            (F.size(F.split(text, r"[#*$%&|<>]")) - 1).cast("bigint").alias("n_symbols"),
            let(
                F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
                lambda lines: F.struct(F.size(lines).alias("n"), F.size(F.array_distinct(lines)).alias("distinct")),
            ).alias("lines"),
            F.when(F.size(w) > 3, let(F.transform(w, lambda x: F.xxhash64(x)), _repeat_words)).otherwise(F.lit(0)).cast("bigint").alias("n_repeat_words"),
            (F.size(F.split(text, r"[\p{Lu}!]")) - 1).cast("bigint").alias("n_shouts"),
        ),
    )


def _repeat_words(h: Column) -> Column:
    """Words that lie in a window of three which occurs twice or more."""

    def covered(ordered: Column) -> Column:
        twice = F.filter(ordered, lambda x, i: (x["g"] == F.get(ordered, i - 1)["g"]) | (x["g"] == F.get(ordered, i + 1)["g"]))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    windows = F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))
    # Sorting is for the few texts with a repeated window only.
    return let(
        windows,
        lambda g: F.when(
            F.size(F.array_distinct(g)) < F.size(g),
            let(F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i")))), covered),
        ).otherwise(F.lit(0)),
    )


def rates(metrics: Column, n_chars: Column) -> dict[str, Column]:
    """The judged rates of a document."""
    n = F.greatest(metrics["n_words"], F.lit(1))
    return {
        "symbols": metrics["n_symbols"] / n,
        "shouting": metrics["n_shouts"] / F.greatest(n_chars, F.lit(1)),
        "dup_lines": metrics["n_dup_lines"] / F.greatest(metrics["lines"]["n"], F.lit(1)),
        "repeats": metrics["n_repeat_words"] / n,
        "word_length": metrics["word_chars"] / n,
    }


def limits(measured: DataFrame, min_rows: int = 100, spread: float = 5.0) -> DataFrame:
    """``(lang, source, at)``: per group a map from rate to its ``low`` and ``high`` limit.

    ``measured`` has lang, source and a struct ``rates``. Nulls are a language and a source
    like others. The result has one row per group; an empty table has none.
    """
    names = measured.schema["rates"].dataType.names
    bucket = lambda rate: F.floor(F.log1p(rate) * RESOLUTION)
    each = F.array(*(F.struct(F.lit(n).alias("rate"), bucket(F.col("rates")[n]).alias("bucket")) for n in names))
    levels = F.array(*(F.struct(F.lit(i).alias("level"), (F.col("lang") if i else F.lit(None)).alias("lang"), (F.col("source") if i > 1 else F.lit(None)).alias("source")) for i in (2, 1, 0)))
    counts = measured.select("lang", "source", F.inline(each)).groupBy("lang", "source", "rate", "bucket").agg(F.count("*").alias("n"))
    merged = counts.select("rate", "bucket", "n", F.inline(levels.alias("l"))).groupBy("level", "lang", "source", "rate", "bucket").agg(F.sum("n").alias("n"))
    of = Window.partitionBy("level", "lang", "source", "rate")
    ranked = merged.withColumns({"total": F.sum("n").over(of), "upto": F.sum("n").over(of.orderBy("bucket"))})
    # Back from the bucket to the rate at its upper end.
    quantile = lambda q: F.expm1((F.min(F.when(F.col("upto") >= F.col("total") * q, F.col("bucket"))) + 1) / RESOLUTION)
    slack = F.create_map(*(F.lit(x) for n in names for x in (n, SLACK[n])))
    fences = (
        ranked.groupBy("level", "lang", "source", "rate")
        .agg(F.max("total").alias("total"), quantile(0.1).alias("q10"), quantile(0.5).alias("q50"))
        .withColumn("reach", F.greatest(F.lit(spread) * (F.col("q50") - F.col("q10")), slack[F.col("rate")]))
        .withColumn("low", F.when(F.col("rate") == "word_length", F.col("q50") - F.col("reach")).otherwise(F.lit(float("-inf"))))
        .groupBy("level", "lang", "source")
        .agg(F.max("total").alias("total"), F.map_from_entries(F.collect_list(F.struct("rate", F.struct("low", (F.col("q50") + F.col("reach")).alias("high"))))).alias("at"))
    )
    fences = stage(fences, "quality-limits")
    own = fences.where("level = 2").select("lang", "source", "total", F.col("at").alias("own"))
    lang = fences.where("level = 1").select(F.col("lang").alias("l"), F.col("total").alias("in_lang"), F.col("at").alias("of_lang"))
    every = fences.where("level = 0").select((F.col("total") >= 0).alias("one"), F.col("at").alias("of_all"))
    return (
        own.join(lang, F.col("lang").eqNullSafe(F.col("l")))
        .withColumn("one", F.col("total") >= 0)
        .join(every, "one")
        .select("lang", "source", F.when(F.col("total") >= min_rows, F.col("own")).when(F.col("in_lang") >= min_rows, F.col("of_lang")).otherwise(F.col("of_all")).alias("at"))
    )


def measure(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with ``_m`` (the counts), ``_rates`` and ``_base_failed``."""
    n_chars = F.char_length(F.coalesce(F.col(text), F.lit("")))
    measured = documents.withColumn("_m", base_metrics(F.col(text)))
    few, repeated = F.col("_m.n_words") < 50, 100 * F.col("_m.n_repeat_words") > 50 * F.col("_m.n_words")
    return measured.withColumns({"_rates": F.struct(*(rate.alias(n) for n, rate in rates(F.col("_m"), n_chars).items())), "_base_failed": few | repeated})


def decide(measured: DataFrame, min_rows: int = 100, spread: float = 5.0) -> DataFrame:
    """Rows of ``measure`` with ``_kept``.

    The rates are staged for the limits; ``measured`` itself is read again for the verdicts, so
    stage it before if that costs less than measuring twice. Documents that fail the base rules neither stay nor shape limits. The limits, one row per
    group, are broadcast if counted to be few and joined by shuffle otherwise.
    """
    names = list(SLACK)
    passed = stage(measured.where("not _base_failed").select("lang", "source", F.col("_rates").alias("rates")), "quality-rates")
    fences, n = stage_counted(limits(passed, min_rows, spread).toDF("_lang", "_source", "_at"), "quality-fences")
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    usual = [F.col("_rates")[r].between(F.col("_at")[r]["low"], F.col("_at")[r]["high"]) for r in names]
    fine = usual[0]
    for more in usual[1:]:
        fine = fine & more
    joined = measured.join(small_side(fences, n), same, "left")
    return joined.withColumn("_kept", ~F.col("_base_failed") & F.coalesce(fine, F.lit(False))).drop("_lang", "_source", "_at")


@passing_columns
def keep_good(documents: DataFrame, min_rows: int = 100, spread: float = 5.0) -> DataFrame:
    """The documents that pass, with their own columns. Needs text, lang and source.

    Null and empty texts fail (fewer than 50 words); repeated rows are judged alike; an empty
    table stays empty.
    """
    return decide(measure(documents), min_rows, spread).where("_kept").select(*documents.columns)


def verdicts(documents: DataFrame, min_rows: int = 100, spread: float = 5.0) -> DataFrame:
    """One row per document: the base counts, whether they fail the base rules, and the verdict."""
    measured = stage(measure(documents.select("doc_id", "text", "lang", "source")).drop("text"), "quality")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    judged = decide(measured, min_rows, spread)
    return judged.select("doc_id", *(F.col("_m")[c].alias(c) for c in counts), F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))
