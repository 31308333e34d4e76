"""Runs of periodic words, found by string synchronising sets.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) that no
neighbouring word extends with that period, at least ``LEAST`` words and ``TIMES * q`` long.

Periods up to ``SMALL`` are read off directly: the stretches on which a text equals itself
shifted by q. Longer periods come from synchronising sets (Kempa and Kociumaka, 2019) at the
scales t = 8, 16, 32, ...: a position belongs to the set of scale t if, of the hashes of the t
words at each of the next t + 1 positions, the smallest stands first or last. Whether it does
depends on the 2t words that follow it alone, so equal contexts have equal members. Positions
whose t words have a period of at most t / 3 have no hash; the runs already found at smaller
scales tell which these are, and supply those periods.

A run of period q with 1.5 t <= q < 3 t holds two members q apart with equal contexts (a window
without any would have a period below t / 3, and so would the run). Members with equal contexts
at such a distance therefore propose all periods; each proposal is extended word by word to its
whole run, which proves or discards it, and runs whose period is a multiple of a smaller one go.

Texts are handled many at a time as one array, with a separator of its own behind each text, so
no stretch crosses texts. A text is one row, and work and memory follow its words.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.staging import ship_package

#: Least length of a run in words, and in periods.
LEAST, TIMES = 24, 3

#: Longest period that is read off directly, and the first scale, which goes on from there.
SMALL, SCALE = 11, 8

#: Words of texts that are handled together.
CHUNK = 400_000

_NONE = np.uint64(2**64 - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def _doubled(h: np.ndarray, length: int) -> np.ndarray:
    """Hashes of twice the length, of all positions that have so many words."""
    if len(h) <= length:
        return h[:0]
    return _mix(h[:-length] * np.uint64(0xA0761D6478BD642F) + h[length:])


def _smallest(h: np.ndarray, length: int) -> np.ndarray:
    """The minimum of every window of ``length`` (a power of two) and the position behind it."""
    low, width = h, 1
    while width < length:
        low, width = np.minimum(low[:-width], low[width:]), 2 * width
    n = len(h) - length
    return np.minimum(low[:n], h[length:])


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the stretches of true values."""
    edges = np.diff(np.concatenate([[0], equal.view(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _reach(w: np.ndarray, at: int, d: int) -> tuple[int, int]:
    """The longest stretch [a, b) around ``at`` on which w[x] == w[x + d]."""
    end, step = at, 32
    while True:
        other = w[end + d : end + d + step]
        differ = np.flatnonzero(w[end : end + len(other)] != other)
        if len(differ):
            end += int(differ[0])
            break
        end += len(other)
        if len(other) < step:
            break
        step *= 2
    begin, step = at, 32
    while begin:
        low = max(0, begin - step)
        differ = np.flatnonzero(w[low:begin] != w[low + d : begin + d])
        if len(differ):
            begin = low + int(differ[-1]) + 1
            break
        begin, step = low, 2 * step
    return begin, end


def _proposals(h2: np.ndarray, members: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and distances of members with equal contexts, 1.5 to 3 scales apart."""
    context = h2[members]
    order = np.argsort(context, kind="stable")
    context, members = context[order], members[order]
    at, by, step = [], [], 1
    while step < len(members):
        apart = members[step:] - members[:-step]
        close = (context[step:] == context[:-step]) & (apart < 3 * scale)
        if not close.any():
            break
        fit = np.flatnonzero(close & (2 * apart >= 3 * scale))
        at.append(members[fit])
        by.append(apart[fit])
        step += 1
    return (np.concatenate(at), np.concatenate(by)) if at else (members[:0], members[:0])


def find_runs(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs of texts of word numbers (non-negative, equal for equal words): arrays of text,
    start, length and period, by text, start and period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes + 1)
    w = np.empty(int(ends[-1]) if len(texts) else 0, np.int64)
    for number, (text, end) in enumerate(zip(texts, ends)):
        w[end - 1 - len(text) : end - 1] = text
        w[end - 1] = -1 - number
    found = [np.empty((0, 3), np.int64)]
    for q in range(1, min(SMALL, len(w) - 1) + 1):
        a, b = _stretches(w[:-q] == w[q:])
        long = b - a + q >= max(TIMES * q, SCALE)
        found.append(np.stack([a[long], b[long] + q, np.full(long.sum(), q)], 1))

    # Texts too short for a scale leave; ``place`` tells where each word was.
    place, h, scale, length = np.arange(len(w)), _mix(w.astype(np.uint64)), SCALE, 1
    left = np.arange(len(texts))
    while True:
        stay = 2 * sizes[left] >= 3 * TIMES * scale
        if not stay.any():
            break
        whole = np.concatenate([h, np.full(len(place) - len(h), _NONE)])  # positions near the end have no hash
        kept = np.repeat(stay, sizes[left] + 1)
        whole, place, left = whole[kept], place[kept], left[stay]
        h = whole[: len(whole) - length + 1]
        while length < scale:
            h, length = _doubled(h, length), 2 * length
        twice = _doubled(h, scale)
        known = np.concatenate(found)
        known = known[(TIMES * known[:, 2] <= scale) & (known[:, 1] - known[:, 0] >= scale)]
        known = known[np.isin(known[:, 0], place, assume_unique=False)]
        named = h.copy()
        if len(known):
            change = np.zeros(len(place) + 1, np.int64)
            begin = np.searchsorted(place, known[:, 0])
            np.add.at(change, begin, 1)
            np.add.at(change, begin + (known[:, 1] - known[:, 0]) - scale + 1, -1)
            named[np.cumsum(change)[: len(named)] > 0] = _NONE
        low = _smallest(named, scale)
        n = min(len(low), len(twice))
        low = low[:n]
        members = np.flatnonzero(((low == named[:n]) | (low == named[scale : scale + n])) & (low != _NONE))
        at, by = _proposals(twice, members, scale)
        words, before, covered, runs = w[place], -1, -1, []
        for k in np.lexsort((at, by)).tolist():
            i, d = int(at[k]), int(by[k])
            if d == before and i < covered:
                continue
            begin, end = _reach(words, i, d)
            before, covered = d, end
            if end - begin + d >= max(LEAST, TIMES * d):
                runs.append((place[begin], place[begin] + end - begin + d, d))
        if runs:
            found.append(np.array(runs, np.int64))
        scale *= 2

    runs = np.concatenate(found)
    runs = runs[runs[:, 1] - runs[:, 0] >= LEAST]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)  # the same stretch with a multiple of its period is no other run
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[first]
    text = np.searchsorted(ends, runs[:, 0], side="right")
    start = runs[:, 0] - (ends - sizes - 1)[text]
    order = np.lexsort((runs[:, 2], start, text))
    return text[order], start[order], (runs[:, 1] - runs[:, 0])[order], runs[order, 2]


def planted(words: list[bytes], key: int | None) -> list[bytes]:
    """The text with a periodic end if the checksum of its key is a multiple of ten, else as it is."""
    if key is None or not words:
        return words
    g, rest = divmod(zlib.crc32(str(key).encode()), 10)
    if rest:
        return words
    n = len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = words[a : a + p]
    return words[:a] + (block * -(-(n - a) // p))[: n - a]


class Numbers(dict):
    """Word numbers, the same for equal words."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def _each(batches: Iterator[pa.RecordBatch], plant: bool):
    """Per batch of rows, in chunks of bounded words: row numbers, words and runs of their texts."""
    for batch in batches:
        keys = batch.column("key").to_pylist()
        rows, texts, held = [], [], 0
        for row, text in enumerate(batch.column("text")):
            words = (text.as_py() or b"").split()  # parts at ASCII white space
            words = planted(words, keys[row]) if plant else words
            rows.append(row)
            texts.append(words)
            held += len(words)
            if held >= CHUNK or row == len(keys) - 1:
                numbers = Numbers()
                yield batch, rows, texts, find_runs([numbers.of(words) for words in texts])
                rows, texts, held = [], [], 0


def _per_text(n: int, runs) -> list[list[tuple[int, int, int]]]:
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    for text, *run in zip(*(x.tolist() for x in runs)):
        out[text].append(tuple(run))
    return out


def _without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def _as_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, rows, _, (text, *runs) in _each(batches, False):
        key = batch.column("key").take(pa.array(np.array(rows, np.int64)[text]))
        yield pa.RecordBatch.from_arrays([key, *(pa.array(x) for x in runs)], ["key", "start", "length", "period"])


def _as_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, rows, texts, runs in _each(batches, False):
        kept = [b" ".join(_without_repeats(*x)) for x in zip(texts, _per_text(len(texts), runs))]
        whole = batch.column("text").take(pa.array(rows))
        out = [None if old is None else new for old, new in zip(whole.to_pylist(), kept)]
        yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(rows)), pa.array(out, pa.binary())], ["key", "text"])


def _strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with most periods; of equals the first, then that of the shortest period."""
    best = None
    for run in runs:  # by start, then period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _as_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    for batch, rows, texts, found in _each(batches, True):
        columns: list[list] = [[] for _ in names[1:]]
        for words, runs in zip(texts, _per_text(len(texts), found)):
            best = _strongest(runs)
            listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
            kept = b" ".join(_without_repeats(words, runs))
            facts = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
            digests = hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest()
            for column, value in zip(columns, (len(runs), *facts, *digests)):
                column.append(value)
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        arrays = [pa.array(v, t) for v, t in zip(columns, kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(rows)), *arrays], names)


def _read(documents: DataFrame, key: str) -> DataFrame:
    ship_package(documents.sparkSession)
    return documents.select(F.col(key).cast("bigint").alias("key"), F.col("text").cast("binary").alias("text"))


def runs_of(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, start, length, period)``: one row per run of every text; words count from 0.

    Null, empty and short texts have no runs. Repeated rows give their runs once per row, null
    keys stay null, and other columns do not matter. An empty table gives no rows.
    """
    return _read(documents, key).mapInArrow(_as_runs, "key bigint, start bigint, length bigint, period bigint")


def collapsed(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, text)``: the texts without what runs repeat, words joined by one space.

    Of each run its first period stays. A null text stays null; rows are as for ``runs_of``.
    """
    out = _read(documents, key).mapInArrow(_as_texts, "key bigint, text binary")
    return out.withColumn("text", F.col("text").cast("string"))


def run_digests(documents: DataFrame) -> DataFrame:
    """The runs of all documents, some with a periodic end put in, with the columns of the query.

    A null or empty text has no run and the digests of nothing. A null ``doc_id`` gets no
    periodic end and stays; repeated rows stay, and other columns do not matter.
    """
    kinds = ("bigint",) * 6 + ("string",) * 2
    names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    return _read(documents, "doc_id").mapInArrow(_as_digests, ", ".join(map(" ".join, zip(names, kinds))))
