"""Expressions over file content (STRING or BINARY)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_size(content: Column) -> Column:
    return F.octet_length(content).cast("bigint")


def fingerprint(content: Column) -> Column:
    """64-bit xxHash of the content (Spark's seed, 42). Only ever compared, never shown."""
    return F.when(content.isNotNull(), F.xxhash64(content))


def digest(content: Column) -> Column:
    """SHA-256 of the content as 32 bytes."""
    return F.unhex(F.sha2(content, 256))


#: Bytes of a content's first piece; each further one is twice as long as the one before.
FIRST_PIECE = 64 * 1024


def digests_of_pieces(content: Column) -> Column:
    """SHA-256 of the pieces of a content, in order: equal for equal contents alone."""
    data = content.cast("binary")
    n = F.octet_length(data)
    # Piece i starts at FIRST_PIECE * (2 ** i - 1).
    last = F.floor(F.log2((F.greatest(n, F.lit(1)) - 1) / FIRST_PIECE + 1)).cast("int")

    def piece(i: Column) -> Column:
        size = F.pow(F.lit(2.0), i) * FIRST_PIECE
        start = (size - FIRST_PIECE + 1).cast("int")
        return F.unhex(F.sha2(F.substring(data, start, F.least(size, F.lit(2.0**31 - 1)).cast("int")), 256))

    return F.when(data.isNotNull(), F.transform(F.sequence(F.lit(0), last), piece))


def files_identical(
    path_a: Column, size_a: Column, content_a: Column,
    path_b: Column, size_b: Column, content_b: Column,
) -> Column:
    """Whether two files are the same: same path, or same size and same content.

    Unreadable (null) content is never identical to another file's. Digests serve as
    content where the bytes themselves are too wide to ship.
    """
    same = (path_a == path_b) | ((size_a == size_b) & (content_a == content_b))
    return F.coalesce(same, F.lit(False))
