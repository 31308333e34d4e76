"""Deletion vectors: rows of a file table named by their places, and marked where they are scanned.

A place is a file and a row number in it, as the scan itself knows them. A vector has the bits
of ``CHUNK`` rows of one file; there are some only where rows are named. A scan looks its rows'
bits up in broadcast vectors, so the table's own columns are never shuffled, however many rows
are named. Vectors that are too many for one broadcast are taken by ranges of files, and each
range is a scan of its files alone.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.staging import broadcast_rows, stage_counted

#: Rows of a file that share a vector, and of one word of it.
CHUNK, WORD = 4096, 64

#: Vectors are some 800 bytes, and take the room of so many listed keys.
ROOM = 4


def with_places(table: DataFrame) -> DataFrame | None:
    """``table`` with ``_file`` and ``_row``; None if its rows do not come straight from a scan."""
    try:
        return table.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        return None


def vectors_of(places: DataFrame) -> tuple[DataFrame, int]:
    """``(_file, _chunk, _words)`` for rows ``(_file, _row)``, which may repeat, and how many there are."""
    words = places.groupBy("_file", F.expr(f"_row div {WORD}").alias("_word")).agg(
        F.expr(f"bit_or(shiftleft(1L, cast(_row % {WORD} as int)))").alias("_bits")
    )
    per = CHUNK // WORD
    found = words.groupBy("_file", F.expr(f"_word div {per}").alias("_chunk")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.expr(f"cast(_word % {per} as int)"), "_bits"))).alias("_found")
    )
    dense = f"transform(sequence(0, {per - 1}), i -> coalesce(_found[i], 0L)) as _words"
    return stage_counted(found.selectExpr("_file", "_chunk", dense), "vectors")


def marked(table: DataFrame, vectors: DataFrame, n: int) -> DataFrame:
    """``table`` with ``_named``, whether the ``n`` vectors name the row; no row moves."""
    limit = max(1, broadcast_rows(table.sparkSession) // ROOM)
    file = F.col("_metadata.file_path")
    out = None
    for low, high in _file_ranges(vectors, -(-n // limit)):
        # The scan leaves out files by a condition on their names.
        part, listed = table, vectors
        if low is not None:
            part, listed = part.where(file >= low), listed.where(F.col("_file") >= low)
        if high is not None:
            part, listed = part.where(file < high), listed.where(F.col("_file") < high)
        rows = with_places(part).withColumn("_chunk", F.expr(f"_row div {CHUNK}"))
        looked = rows.join(F.broadcast(listed), ["_file", "_chunk"], "left")
        word = f"get(_words, cast(_row div {WORD} % {CHUNK // WORD} as int))"
        bit = F.expr(f"coalesce(bit_get({word}, cast(_row % {WORD} as int)), 0) = 1")
        found = looked.select(*table.columns, bit.alias("_named"))
        out = found if out is None else out.unionByName(found)
    return out


def _file_ranges(vectors: DataFrame, parts: int) -> list[tuple[str | None, str | None]]:
    """Ranges of file names, open at both ends, that have about as many vectors each."""
    if parts <= 1:
        return [(None, None)]
    ranged = vectors.repartitionByRange(parts, "_file").groupBy(F.spark_partition_id()).agg(F.min("_file").alias("low"))
    edges = [None, *sorted(row.low for row in ranged.collect())[1:], None]  # at most one row per part
    return list(zip(edges, edges[1:]))
