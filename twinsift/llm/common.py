"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.staging import ship_package, stage

#: What stands between words: the ASCII white space of the contracts.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Columns of documents that the operators use by name.
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def passing_columns(step: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``step`` over documents, whose further columns come out as they went in, whatever their names."""

    @wraps(step)
    def run(documents: DataFrame, *args, **options) -> DataFrame:
        names = documents.columns
        plain = [name if name in OWN else f"column_{i}" for i, name in enumerate(names)]
        return step(documents.toDF(*plain), *args, **options).select(*plain).toDF(*names)

    return run


def numbered(documents: DataFrame, label: str) -> DataFrame:
    """``documents`` with ``_row``, which tells all rows apart: the place in its file, so that nothing
    is copied; for tables that are not read from Parquet files a number in a staged copy."""
    try:
        return documents.select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("_row"))
    except AnalysisException:
        return stage(documents.withColumn("_row", F.monotonically_increasing_id()), label)


def words(text: Column) -> Column:
    """The maximal runs of characters that are not ASCII white space; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
