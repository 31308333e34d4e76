"""Files by plain path or, where no one mounts them, by URI through pyarrow's file systems."""

from __future__ import annotations

from functools import lru_cache
from urllib.parse import quote, unquote, urlsplit

from pyarrow import fs

#: Bytes of a URI's name that stand for themselves.
PLAIN = "/!$&'()*+,;=:@~"


def is_uri(path: str | bytes) -> bool:
    return (b"://" if isinstance(path, bytes) else "://") in path


@lru_cache(maxsize=64)
def _store(scheme: str, place: str) -> tuple[fs.FileSystem, bool]:
    """The file system of a place, and whether its paths begin with the place."""
    store, path = fs.FileSystem.from_uri(f"{scheme}://{place}/")
    return store, bool(place) and path.strip("/") == place


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it."""
    parts = urlsplit(uri, allow_fragments=False)
    store, with_place = _store(parts.scheme, parts.netloc)
    path = unquote(parts.path)
    return store, f"{parts.netloc}{path}" if with_place else path or "/"


def joined(folder: str, name: str) -> str:
    """The URI of a name in a folder."""
    return f"{folder}/{quote(name, safe=PLAIN)}"


def open_bytes(path: bytes):
    """A stream of a file's bytes."""
    if not is_uri(path):
        return open(path, "rb")
    store, at = located(path.decode())
    return store.open_input_stream(at)
