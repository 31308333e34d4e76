"""Ranked lexical search: per-term geometric blocks with coordinatewise-maximum summaries.

A document is a sparse vector of the impacts of its terms (term frequencies, saturated and set
off against the document's length); its score for an item is the sum of its impacts at the
item's terms, times their weights. All numbers are integers, so scores and ties are exact.

The index is a table of segments of up to ``SEGMENT`` documents that lie close to each other (a
range partitioning by the signs of random projections). In a segment each term has the list of
its documents, cut into blocks by similarity: documents go to the nearest of some of the list's
own documents. A block's summary is the coordinatewise maximum of its vectors, over the terms
that some item asks together with the block's term. Terms of more than a quarter of a segment
share one set of blocks, of all its documents, with whole summaries.

A search reads the segments twice. First each item scores the block with the best bound of
every segment, which gives a score that its k best documents reach. Then, per segment, the
item's terms are taken by their largest contributions: the lists of the smallest ones, which
together stay below that score, cannot bring in a document; of the other lists a block is
skipped if its summary's score stays below, and all other blocks are scored in full. Bounds are
never estimates, so nothing is lost. The reached score rises as a task goes on.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinsift.staging import ship_package, shuffle_width, stage

#: Documents of a segment, and of a block on average.
SEGMENT, BLOCK = 1024, 32

#: Items that are searched together; more are searched in blocks of so many.
ITEMS = 1024

#: Dimensions of the projections that tell which documents are similar.
PROJECTED = 48

#: Signs of projections by which documents are put in segments.
SIGNS = 12

#: Stands for a null key within the index.
NO_KEY = 2**63 - 1

#: Term occurrences that are expanded at once.
CHUNK = 1 << 20

#: Letters and digits of ASCII, A-Z in lower case, and all bytes of other characters; blanks elsewhere.
_FOLD = bytes(b if b > 127 or bytes([b]).isalnum() else 32 for b in bytes(range(256)).lower())


def terms(text: bytes | None) -> list[bytes]:
    """The runs of ASCII letters and digits and of characters beyond ASCII, A-Z in lower case."""
    return (text or b"").translate(_FOLD).split()


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every range, one range after the other."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


@lru_cache(maxsize=4)
def _projections(n: int, dimensions: int) -> np.ndarray:
    return np.random.default_rng(17).standard_normal((n, dimensions)).astype(np.float32)


def _vectors(shared):
    """Per document its length, the asked terms in it with their frequencies, and its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        signs, powers = _projections(len(number), SIGNS), 1 << np.arange(SIGNS)
        done = 0
        for batch in batches:
            n, which, often, place = [], [], [], []
            for text in batch.column("text"):
                found = terms(text.as_py())
                codes = np.fromiter(map(number.get, found, repeat(-1)), np.int32, len(found))
                at, tf = np.unique(codes[codes >= 0], return_counts=True)
                n.append(len(found))
                which.append(at.tobytes())
                often.append(tf.astype(np.int32).tobytes())
                gray = int(((np.log1p(tf) @ signs[at] > 0) * powers).sum())
                for shift in (1, 2, 4, 8):  # neighbouring numbers differ in one sign
                    gray ^= gray >> shift
                place.append(gray)
            spread = (np.arange(done, done + len(n)) * 0x9E3779B1) % 2**31
            done += len(n)
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32())
            arrays = [pa.array(v, t) for v, t in zip((n, which, often, place, spread), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *arrays], ["key", "n", "terms", "tfs", "place", "spread"])

    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: documents of each term; documents and words in all under the terms -1 and -2."""
    sums: Counter = Counter()
    for batch in batches:
        n = batch.column("n").to_numpy()
        sums[-1] += int((n > 0).sum())
        sums[-2] += int(n.sum())
        every = np.frombuffer(b"".join(batch.column("terms").to_pylist()), np.int32)
        sums.update(dict(zip(*(x.tolist() for x in np.unique(every, return_counts=True)))))
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.int64())], ["term", "n"])


_ARRAYS = {
    "keys": np.int64, "ptr": np.int64, "terms": np.int32, "impacts": np.int32,
    "block_term": np.int32, "block_ptr": np.int64, "block_docs": np.int16,
    "sum_ptr": np.int64, "sum_terms": np.int32, "sum_max": np.int32, "shared": np.int32,
}


def _nearest(projected: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each document of a list which of some of the list's documents it is most similar to."""
    k = -(-len(docs) // BLOCK)
    if k == 1:
        return np.zeros(len(docs), np.int64)
    centres = projected[docs[np.arange(k) * len(docs) // k]]
    return (projected[docs] @ centres.T).argmax(axis=1)


def segment_of(keys: np.ndarray, ptr: np.ndarray, term: np.ndarray, impact: np.ndarray, weights: np.ndarray, asked: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays of a segment: its vectors, the blocks of its lists, and their summaries.

    ``asked`` has a bit set per term, of the items with it. Block term -1 is that of the shared blocks.
    """
    n, size = len(keys), np.diff(ptr)
    doc = np.repeat(np.arange(n), size)
    projected = np.add.reduceat((impact * weights[term] / 1e9).astype(np.float32)[:, None] * _projections(len(weights), PROJECTED)[term], ptr[:-1])
    projected /= np.maximum(np.linalg.norm(projected, axis=1, keepdims=True), 1e-9)
    order = np.argsort(term, kind="stable")
    by_term, by_doc = term[order], doc[order]
    start = np.flatnonzero(np.r_[True, np.diff(by_term) != 0])
    length = np.diff(np.r_[start, len(by_term)])
    frequent = length * 4 > n
    lists = [(int(by_term[s]), by_doc[s : s + m]) for s, m in zip(start[~frequent], length[~frequent])]
    if frequent.any():
        lists.append((-1, np.arange(n)))
    # One row per document of a list, by list and block.
    list_term = np.repeat(np.array([t for t, _ in lists], np.int64), [len(d) for _, d in lists])
    docs = np.concatenate([d for _, d in lists])
    part = np.concatenate([_nearest(projected, d) for _, d in lists])
    number = np.repeat(np.arange(len(lists)), [len(d) for _, d in lists])
    order = np.lexsort((docs, part, number))
    list_term, docs, part, number = list_term[order], docs[order], part[order], number[order]
    new = np.r_[True, (np.diff(number) != 0) | (np.diff(part) != 0)]
    first, block = np.flatnonzero(new), np.cumsum(new) - 1
    pieces, at = [], 0
    expanded = np.cumsum(size[docs])
    while at < len(docs):
        to = max(at + 1, int(np.searchsorted(expanded, (expanded[at - 1] if at else 0) + CHUNK)))
        rows = np.arange(at, to)
        entry = _ranges(ptr[docs[rows]], size[docs[rows]])
        row = np.repeat(rows, size[docs[rows]])
        together = (asked[list_term[row]] & asked[term[entry]]).any(axis=1) | (list_term[row] < 0)
        entry, row = entry[together], row[together]
        name = block[row] * len(weights) + term[entry]
        by = np.argsort(name, kind="stable")
        begin = np.flatnonzero(np.r_[True, np.diff(name[by]) != 0])
        pieces.append((name[by][begin], np.maximum.reduceat(impact[entry][by], begin)))
        at = to
    name, most = (np.concatenate(x) for x in zip(*pieces))
    by = np.argsort(name, kind="stable")  # a block may lie in two pieces
    begin = np.flatnonzero(np.r_[True, np.diff(name[by]) != 0])
    name, most = name[by][begin], np.maximum.reduceat(most[by], begin)
    arrays = {
        "keys": keys, "ptr": ptr, "terms": term, "impacts": impact,
        "block_term": list_term[first], "block_ptr": np.r_[first, len(docs)], "block_docs": docs,
        "sum_ptr": np.searchsorted(name, np.arange(len(first) + 1) * len(weights)),
        "sum_terms": name % len(weights), "sum_max": most, "shared": by_term[start[frequent]],
    }
    return {k: v.astype(_ARRAYS[k]) for k, v in arrays.items()}


def _segments(shared, n_documents: int, n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, asked = shared.value
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            keys = np.array([NO_KEY if k is None else k for k, *_ in held], np.int64)
            n = np.array([n for _, n, *_ in held], object)  # exact however large
            m = np.array([25 + 75 * x * n_documents // n_words for x in n], np.int64)
            which = [np.frombuffer(t, np.int32) for _, _, t, _ in held]
            size = np.array([len(t) for t in which])
            tf = np.frombuffer(b"".join(t for *_, t in held), np.int32).astype(np.int64)
            impact = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, size))
            arrays = segment_of(keys, np.r_[0, np.cumsum(size)], np.concatenate(which), impact, weights, asked)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([arrays[k].tobytes()], pa.binary()) for k in _ARRAYS], list(_ARRAYS))

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "terms", "tfs"))):
                held.append(row)
                if len(held) == SEGMENT:
                    yield flush()
        if held:
            yield flush()

    return run


class Segment:
    """One segment under search."""

    def __init__(self, row: dict[str, bytes], n_terms: int):
        for name, kind in _ARRAYS.items():
            setattr(self, name, np.frombuffer(row[name], kind))
        self.most = np.zeros(n_terms, np.int64)
        np.maximum.at(self.most, self.terms, self.impacts)
        self.is_shared = np.zeros(n_terms, bool)
        self.is_shared[self.shared] = True
        self.scored = 0  # documents, for tests

    def blocks_for(self, asked: np.ndarray, gain: np.ndarray, least: int) -> np.ndarray:
        """The blocks of the lists without which no document reaches ``least``."""
        most = gain * self.most[asked]
        order = np.argsort(most, kind="stable")
        needed = asked[order][(np.cumsum(most[order]) >= least) & (most[order] > 0)]
        if not len(needed):
            return needed
        own = np.unique(np.where(self.is_shared[needed], -1, needed))
        n_own = int((self.block_term >= 0).sum())  # blocks come by term, the shared ones last
        low = np.searchsorted(self.block_term[:n_own], own[own >= 0])
        high = np.searchsorted(self.block_term[:n_own], own[own >= 0], side="right")
        found = _ranges(low, high - low)
        return np.r_[found, np.arange(n_own, len(self.block_term))] if own[0] < 0 else found

    def bounds(self, blocks: np.ndarray, gains: np.ndarray) -> np.ndarray:
        size = np.diff(self.sum_ptr)[blocks]
        entry = _ranges(self.sum_ptr[blocks], size)
        return np.add.reduceat(self.sum_max[entry] * gains[self.sum_terms[entry]], np.cumsum(size) - size)

    def scores(self, blocks: np.ndarray, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys and whole scores of the documents of some blocks."""
        docs = np.unique(self.block_docs[_ranges(self.block_ptr[blocks], np.diff(self.block_ptr)[blocks])]).astype(np.int64)
        self.scored += len(docs)
        size = np.diff(self.ptr)[docs]
        entry = _ranges(self.ptr[docs], size)
        return self.keys[docs], np.add.reduceat(self.impacts[entry] * gains[self.terms[entry]], np.cumsum(size) - size)


def _best(keys: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    by = np.lexsort((keys, -scores))[:k]
    return keys[by], scores[by]


def _search(shared, least: list[int], k: int, only_best: bool):
    """Per task the ``k`` best documents of every item that reach its ``least`` score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, items = shared.value
        none = np.empty(0, np.int64)
        found, reached = [(none, none)] * len(items), list(least)
        gains = np.zeros(len(weights), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                segment = Segment(row, len(weights))
                for i, (asked, times) in enumerate(items):
                    gain = times * weights[asked]
                    blocks = segment.blocks_for(asked, gain, reached[i])
                    if not len(blocks):
                        continue
                    gains[asked] = gain
                    bounds = segment.bounds(blocks, gains)
                    blocks = blocks[[bounds.argmax()]] if only_best else blocks[bounds >= reached[i]]
                    if len(blocks):
                        keys, scores = segment.scores(blocks, gains)
                        good = scores >= reached[i]
                        found[i] = _best(np.r_[found[i][0], keys[good]], np.r_[found[i][1], scores[good]], k)
                        if len(found[i][1]) == k:
                            reached[i] = max(reached[i], int(found[i][1][-1]))
                    gains[asked] = 0
        item = np.repeat(np.arange(len(items), dtype=np.int32), [len(f[0]) for f in found])
        flat = [np.concatenate([f[c] for f in found]) if found else none for c in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(item), *map(pa.array, flat)], ["item", "key", "score"])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    of = Window.partitionBy("item").orderBy(F.desc("score"), "key")
    return found.withColumn("rank", F.row_number().over(of)).where(F.col("rank") <= k)


def build_index(documents: DataFrame, items: list[tuple[object, bytes | None]], key: str = "doc_id"):
    """The staged table of segments for a block of items, and what a search needs besides."""
    spark = documents.sparkSession
    ship_package(spark)
    counted = [Counter(terms(text)) for _, text in items]
    number = {t: i for i, t in enumerate(sorted(set().union(*counted)))}
    asked = [(np.array([number[t] for t in sorted(c)], np.int64), np.array([c[t] for t in sorted(c)], np.int64)) for c in counted]
    bits = np.zeros((max(1, len(number)), -(-len(items) // 64)), np.uint64)
    for i, (at, _) in enumerate(asked):
        bits[at, i // 64] |= np.uint64(1 << i % 64)

    read = documents.select(F.col(key).cast("bigint").alias("key"), F.col("text").cast("binary").alias("text"))
    names = spark.sparkContext.broadcast(number)
    columns = "key bigint, n bigint, terms binary, tfs binary, place int, spread int"
    vectors = stage(read.mapInArrow(_vectors(names), columns), "vectors")
    counts = vectors.select("n", "terms").mapInArrow(_counts, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    n_of = {row.term: row.n for row in counts.collect()}  # a row per asked term
    names.unpersist()
    n_documents, n_words = n_of.get(-1, 0), n_of.get(-2, 0)
    weights = np.array([math.floor(1000 * math.log((2 * n_documents + 2) / (2 * n_of.get(i, 0) + 1))) for i in range(len(number))] or [0], np.int64)

    model = spark.sparkContext.broadcast((weights, bits))
    slices = max(shuffle_width(spark), n_documents // (4 * SEGMENT) + 1)
    placed = vectors.where("length(terms) > 0").repartitionByRange(slices, "place", "spread").sortWithinPartitions("place", "spread")
    index = stage(placed.mapInArrow(_segments(model, n_documents, n_words), ", ".join(f"{c} binary" for c in _ARRAYS)), "segments")
    model.unpersist()
    return index, weights, asked


def search(index: DataFrame, weights: np.ndarray, asked: list, k: int) -> DataFrame:
    """``(item, rank, key, score)`` of the items by their numbers, from an index made for them."""
    spark = index.sparkSession
    shared = spark.sparkContext.broadcast((weights, asked))
    first = index.mapInArrow(_search(shared, [1] * len(asked), k, True), "item int, key bigint, score bigint")
    reached = [1] * len(asked)
    for row in _ranked(first, k).where(F.col("rank") == k).collect():  # at most one row per item
        reached[row.item] = row.score
    return _ranked(index.mapInArrow(_search(shared, reached, k, False), "item int, key bigint, score bigint"), k)


def top_documents(documents: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of every row of ``items``.

    Only documents with a score above 0 are ranked, equal scores by ascending key with null keys
    last. Null and empty texts have no terms: such documents are found by nothing, such items
    find nothing. Repeated rows count and rank each by itself, as do repeated items. Other
    columns do not matter. Empty tables give no rows. Items are searched ``ITEMS`` at a time.
    """
    spark = documents.sparkSession
    kind = items.schema[item].dataType.simpleString()
    rows = ((row[0], None if row[1] is None else bytes(row[1])) for row in items.select(F.col(item), F.col("text").cast("binary")).toLocalIterator())
    out = None
    while block := list(islice(rows, ITEMS)):
        index, weights, asked = build_index(documents, block, key)
        names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(block)], f"item int, _name {kind}")
        found = search(index, weights, asked, k).join(F.broadcast(names), "item")
        plain = F.when(F.col("key") != NO_KEY, F.col("key"))
        found = stage(found.select(F.col("_name").alias("item_id"), "rank", plain.alias("doc_id"), "score"), "ranked")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
