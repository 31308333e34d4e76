"""Inventory views over tables: documents as files, embeddings as small gray rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.staging import ship_package

EPOCH = "timestamp_ntz'2024-01-01 00:00:00'"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def document_path() -> str:
    return """concat('/corpus/', case when doc_id % 2 = 0 then 'set.old' else 'set' end, '/', source, '/', lang,
        '/doc_', lpad(cast(doc_id as string), 7, '0'),
        case cast(doc_id % 4 as int) when 0 then '.txt' when 1 then '.JPG' when 2 then '.md' else '.png' end)"""


def document_files(documents: DataFrame) -> DataFrame:
    """``files(path, size, mtime, mtime_day, content)``, one file per document."""
    return documents.selectExpr(
        f"{document_path()} as path",
        "cast(octet_length(text) as bigint) as size",
        f"timestampadd(SECOND, cast((doc_id * 7919) % 86400 as int), {EPOCH}) as mtime",
        f"timestampadd(DAY, cast(doc_id % 3 as int), {EPOCH}) as mtime_day",
        "text as content",
    )


def embedding_rasters(embeddings: DataFrame) -> DataFrame:
    """``rasters(path, img_id, width, height, channels, pixels)``, 8 x 8 gray values per vector."""
    pixels = F.transform(
        "embedding",
        lambda v: F.least(
            F.lit(255), F.greatest(F.lit(0), F.floor((v.cast("double") + 1.0) * 127.5))
        ).cast("int"),
    )
    return embeddings.select(
        F.concat(F.lit("/img/"), F.lpad(F.col("vec_id").cast("string"), 7, "0"), F.lit(".png")).alias("path"),
        F.col("vec_id").alias("img_id"),
        F.lit(8).alias("width"),
        F.lit(8).alias("height"),
        F.lit(1).alias("channels"),
        pixels.alias("pixels"),
    )


def document_images(documents: DataFrame, embeddings: DataFrame) -> DataFrame:
    """``(path, size, mtime, mtime_day, width, height, channels, pixels)``: the files, with a raster if they have one."""
    rasters = embedding_rasters(embeddings).drop("path")
    files = documents.selectExpr(
        "doc_id as img_id",
        f"{document_path()} as path",
        "cast(octet_length(text) as bigint) as size",
        f"timestampadd(SECOND, cast((doc_id * 7919) % 86400 as int), {EPOCH}) as mtime",
        f"timestampadd(DAY, cast(doc_id % 3 as int), {EPOCH}) as mtime_day",
    )
    return files.join(rasters, "img_id", "left")
