"""The corpus pipeline: stages over the documents table, each written and read again by the next.

A stage begins by deleting what the stage before has staged on its way, as its result is written
by then; nothing else in the session is touched.

Texts may be null, empty or very long, rows may repeat, any column may be null, and tables may be
empty: see each stage. Further columns pass through all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.llm import bpe, jaccard_join, mixing, quality, secrets
from twinsift.llm.common import table
from twinsift.staging import discard, discard_paths, stage, staged_paths

Step = Callable[[SparkSession, DataFrame, str], DataFrame]

#: By session, the tables that the last stage has staged.
_left: dict[str, list[str]] = {}


def _tidy(spark: SparkSession) -> None:
    discard_paths(spark, _left.pop(spark.sparkContext.applicationId, []))


def tidy(step: Step) -> Step:
    """``step``, which first deletes what the step before it has staged."""

    @wraps(step)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _tidy(spark)
        before = set(staged_paths(spark))
        out = step(spark, docs, sf_dir)
        _left[spark.sparkContext.applicationId] = [path for path in staged_paths(spark) if path not in before]
        return out

    return run


@tidy
def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: rejected documents go, among them null, empty and blank texts.

    Each of repeated rows gets the same verdict; null languages and sources are a group like
    others. An empty table stays empty.
    """
    return quality.keep_good(docs)


@tidy
def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near duplicates (five-word shingles, 0.8): one document of each group stays.

    Texts without words are copies of nothing and stay. Of repeated rows one stays, whatever their
    ids; a null id is an id like others.
    """
    return jaccard_join.keep_one(docs, 5, 80)


@tidy
def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scan: secrets give way to a mark; no document goes, and null texts stay null."""
    return secrets.redact(docs)


@tidy
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents are repeated or left out.

    A null source is the last one. Texts without words have size 0, so no weight asks for them.
    """
    return mixing.repeat_documents(docs)


@tidy
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, in place of its text; a null text has none. Further columns are dropped."""
    return bpe.with_tokens(docs).select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Step]] = [
    ("quality", good),
    ("near_duplicates", distinct),
    ("secrets", without_secrets),
    ("mix", mixed),
    ("encode", encoded),
]

#: The stages are not expressible in SQL; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written as Parquet and read again as the documents of the next."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    _tidy(spark)
    return docs
