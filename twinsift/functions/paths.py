"""Path expressions. Two orders exist: by bytes of the string, and component by component."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions that are hashed as images, and those that get a preview.
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".bmp"]
PREVIEW_EXTENSIONS = [".jpg", ".jpeg", ".png", ".bmp", ".gif"]


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot; a name whose only dot leads it has none."""
    return F.lower(F.regexp_extract(path, r"[^/]([.][^./]*)$", 1))


def is_image_path(path: Column) -> Column:
    return extension(path).isin(IMAGE_EXTENSIONS)


def has_preview(path: Column) -> Column:
    return extension(path).isin(PREVIEW_EXTENSIONS)


def component_key(path: Column) -> Column:
    """String whose byte order is the component-wise order of ``path``.

    The separator becomes the smallest character, which no file name may contain, so
    ``set/x`` sorts before ``set.old/x``.
    """
    return F.replace(path, F.lit("/"), F.lit("\0"))
