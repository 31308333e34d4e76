"""Difference hash of images: a 9 x 8 grid of mean brightness, one bit per neighbouring pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# Grid size and the integer brightness weights of red, green and blue.
GRID_WIDTH, GRID_HEIGHT = 9, 8
RED, GREEN, BLUE, SCALE = 299, 587, 114, 1000


# --- numpy form, for real images -------------------------------------------------------


def _bounds(extent: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    edges = np.arange(cells + 1) * extent // cells
    start = edges[:-1]
    return start, np.minimum(np.maximum(edges[1:], start + 1), extent)


#: Pixels of equally sized images are hashed together up to this many bytes, and larger images
#: are summed up in bands of so many.
STACK_BYTES = 1 << 22


def _bright(pixels: np.ndarray, bgr: bool) -> np.ndarray:
    """Brightness of (..., channels) bytes."""
    if pixels.shape[-1] < 3:
        return (pixels[..., 0].astype(np.uint32) * (RED + GREEN + BLUE)) // SCALE
    red, blue = (2, 0) if bgr else (0, 2)
    total = pixels[..., red].astype(np.uint32)
    total *= RED
    for channel, weight in ((1, GREEN), (blue, BLUE)):
        total += pixels[..., channel].astype(np.uint32) * np.uint32(weight)
    total //= SCALE
    return total


def _stack_hashes(stack: np.ndarray, bgr: bool) -> np.ndarray:
    """Hashes of images of one shape: (images, height, width, channels) of bytes.

    Rows of a cell are added up band by band, so besides the images there is never more than a
    band. Small images make cells overlap; cells look their columns up in running sums.
    """
    n, height, width, channels = stack.shape
    x0, x1 = _bounds(width, GRID_WIDTH)
    y0, y1 = _bounds(height, GRID_HEIGHT)
    step = max(1, STACK_BYTES // (n * width * channels))
    grid = np.empty((n, GRID_HEIGHT, GRID_WIDTH), np.int64)
    for row, (top, bottom) in enumerate(zip(y0.tolist(), y1.tolist())):
        columns = np.zeros((n, width + 1), np.int64)
        for at in range(top, bottom, step):
            columns[:, 1:] += _bright(stack[:, at : min(at + step, bottom)], bgr).sum(axis=1, dtype=np.int64)
        sums = columns.cumsum(axis=1)
        grid[:, row] = (sums[:, x1] - sums[:, x0]) // ((bottom - top) * (x1 - x0))
    rises = (grid[:, :, :-1] < grid[:, :, 1:]).reshape(n, -1)
    packed = np.packbits(rises, axis=1, bitorder="little")
    return np.ascontiguousarray(packed).view("<i8")[:, 0]


def _hash_images(width, height, channels, data, bgr: bool) -> list[int | None]:
    hashes: list[int | None] = [None] * len(data)
    shapes: dict[tuple[int, int, int], list[tuple[int, np.ndarray]]] = {}
    for i, (w, h, c, pixels) in enumerate(zip(width, height, channels, data)):
        if pixels is None:
            continue
        pixels = _as_bytes(pixels)
        if pixels is None:
            continue
        if w <= 0 or h <= 0 or c <= 0 or pixels.size == 0:
            hashes[i] = 0
        elif pixels.size >= w * h * c:
            shapes.setdefault((int(h), int(w), int(c)), []).append((i, pixels))
    for shape, images in shapes.items():
        needed = shape[0] * shape[1] * shape[2]
        step = max(1, STACK_BYTES // needed)
        for start in range(0, len(images), step):
            part = images[start : start + step]
            # One image alone is not copied.
            stack = part[0][1][:needed] if len(part) == 1 else np.stack([pixels[:needed] for _, pixels in part])
            stack = stack.reshape(-1, *shape)
            for (i, _), value in zip(part, _stack_hashes(stack, bgr)):
                hashes[i] = int(value)
    return hashes


def _as_bytes(data) -> np.ndarray | None:
    """The values of a raster; None if one of them is no byte."""
    if isinstance(data, (bytes, bytearray, memoryview)):
        return np.frombuffer(data, dtype=np.uint8)
    values = np.asarray(data)
    if values.dtype.kind not in "iub" or values.size and not (0 <= values.min() and values.max() <= 255):
        return None
    return values.astype(np.uint8)


def _hash_batches(batches, bgr: bool) -> Iterator[pd.Series]:
    for width, height, channels, data in batches:
        yield pd.Series(_hash_images(width, height, channels, data, bgr), dtype="Int64")


@F.pandas_udf(LongType())
def dhash(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Hash of (width, height, channels, interleaved RGB(A) or gray bytes); null data gives null."""
    yield from _hash_batches(batches, bgr=False)


@F.pandas_udf(LongType())
def dhash_bgr(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The same for the blue-green-red order of Spark's image source."""
    yield from _hash_batches(batches, bgr=True)


# --- expression form, for pixel arrays -------------------------------------------------


def luma_grid(width: str, height: str, channels: str, pixels: str) -> str:
    """SQL for the 72 cell means, row by row, of an ARRAY<INT> raster, without leaving the row.

    A cell is never empty: in images narrower or lower than the grid, cells share pixels.
    ``transform(array(x), y -> ...)[0]`` computes ``x`` once for many uses.
    """
    gray = f"{channels} < 3"
    red = f"get({pixels}, i * {channels})"
    green = f"if({gray}, {red}, get({pixels}, i * {channels} + 1))"
    blue = f"if({gray}, {red}, get({pixels}, i * {channels} + 2))"
    bright = f"""transform(sequence(0, {width} * {height} - 1),
        i -> ({RED} * {red} + {GREEN} * {green} + {BLUE} * {blue}) div {SCALE})"""
    bounds = f"""array(struct(
        cast((c % {GRID_WIDTH}) * {width} div {GRID_WIDTH} as int) as x0,
        cast((c % {GRID_WIDTH} + 1) * {width} div {GRID_WIDTH} as int) as x1,
        cast((c div {GRID_WIDTH}) * {height} div {GRID_HEIGHT} as int) as y0,
        cast((c div {GRID_WIDTH} + 1) * {height} div {GRID_HEIGHT} as int) as y1))"""
    some = f"""array(struct(b.x0 as x, least({width}, greatest(b.x1, b.x0 + 1)) - b.x0 as w,
        b.y0 as y, least({height}, greatest(b.y1, b.y0 + 1)) - b.y0 as h))"""
    row_sum = f"aggregate(slice(light, r * {width} + s.x + 1, s.w), 0L, (t, v) -> t + v)"
    mean = f"aggregate(sequence(s.y, s.y + s.h - 1), 0L, (total, r) -> total + {row_sum}) div (s.w * s.h)"
    cell = f"transform({bounds}, b -> transform({some}, s -> {mean})[0])[0]"
    cells = f"transform(sequence(0, {GRID_WIDTH * GRID_HEIGHT - 1}), c -> {cell})"
    return f"transform(array({bright}), light -> {cells})[0]"


def grid_bits(grid: str) -> str:
    """SQL: bit k, for the k-th of the 8 x 8 left neighbours, is set where the cell to its right is brighter."""
    step = f"cast(k + k div {GRID_WIDTH - 1} as int)"
    bits = f"""aggregate(sequence(0, {(GRID_WIDTH - 1) * GRID_HEIGHT - 1}), 0L, (bits, k) ->
        if(get(g, {step}) < get(g, {step} + 1), bits | shiftleft(1L, k), bits))"""
    return f"transform(array({grid}), g -> {bits})[0]"


def dhash_of_pixels(width: str, height: str, channels: str, pixels: str) -> str:
    """SQL for the difference hash of an ARRAY<INT> raster; 0 for an empty one, null without pixels."""
    return f"""case when {pixels} is null then null
        when {width} <= 0 or {height} <= 0 or {channels} <= 0 or size({pixels}) = 0 then 0L
        else {grid_bits(luma_grid(width, height, channels, pixels))} end"""

