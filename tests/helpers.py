"""Builders for small fixtures."""

import struct
import zlib
from pathlib import Path


def write_png(path, width, height, pixel):
    """An RGB PNG whose pixel (x, y) has the gray value ``pixel(x, y)``."""
    rows = b"".join(
        b"\0" + b"".join(bytes([pixel(x, y)] * 3) for x in range(width)) for y in range(height)
    )

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    header = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    Path(path).write_bytes(
        b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    )


def gradient(width, inverted=False):
    return lambda x, y: 255 - x * 255 // width if inverted else x * 255 // width


def checkerboard(x, y):
    return 255 if (x // 10) % 2 == (y // 10) % 2 else 0


def inventory(spark, contents, times=None):
    """``files`` from {path: content}; times in seconds."""
    rows = [
        (path, None if c is None else len(c), (times or {}).get(path, 0), None if c is None else bytearray(c))
        for path, c in contents.items()
    ]
    return spark.createDataFrame(rows, "path string, size bigint, at bigint, content binary").selectExpr(
        "path", "size", "timestamp_seconds(at) as mtime", "content"
    )


def grouped(members):
    groups = {}
    for row in members.collect():
        groups.setdefault(row.group_id, []).append(row.path)
    return {g: sorted(paths) for g, paths in groups.items()}
