"""N-gram Jaccard self-join with rare-first prefix filtering, and the groups it links.

A document's set has its distinct word n-grams (64-bit hashes). Two sets can only be as similar
as asked if the first few grams of each, in one global order, share a gram; with the rarest
first, few do. Then, per pair that meets at a gram:

* length filter: the smaller set is at least ``percent`` of the larger one;
* positional filter: what follows the shared gram in both sets can still bring enough overlap
  (tight where two sets meet first, and every true pair passes there);
* suffix filter: each set has a parity bitmap; the bits in which two differ are at most the
  elements in which the sets differ, so too many of them rule a pair out;
* verification, once per pair, by the intersection of both whole sets.

Rarity is the frequency of a gram's rarest word, an upper bound of its own, from a count sketch
of fixed size over all documents; it decides the order only, so collisions cost no pair.

Documents with equal sets are one node. In a bucket of many similar sets not all pairs are
verified, as only groups are asked for: a search that removes whom it has reached emits a
spanning forest. What verification refuses may have hidden another link, so for the buckets
where it did, a second round emits every passing pair between different groups.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinsift.llm.common import passing_columns
from twinsift.llm.set_pairs import linked_pairs
from twinsift.operators.components import connected_components
from twinsift.staging import ship_package, small_side, stage, stage_counted

#: Counters of the word sketch, and how many of them travel in one row.
SKETCH, CHUNK = 1 << 22, 1 << 16

#: Bits of a set's parity bitmap.
BITMAP = 1024

#: Rows of a gram above which its bucket is cut into blocks that meet pairwise.
BUCKET = 4096

#: Rows of a gram up to which all passing pairs are emitted at once.
FEW = 8


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a fixed number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 2_000_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, text: bytes | None) -> np.ndarray:
        """Hashes of the words, with A-Z in lower case. bytes.split() parts at ASCII white space."""
        found = (text or b"").lower().split()
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash for every run of ``k`` words; for fewer words one for all of them."""
    if not len(h):
        return h
    size = min(k, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for j in range(size):
        out = _mix(out * np.uint64(0xD6E8FEB86659FD93) + h[j : len(h) - size + 1 + j])
    return out


def bitmap(members: np.ndarray, bits: int = BITMAP) -> bytes:
    return np.packbits(np.bincount((members >> np.uint64(40)).astype(np.int64) % bits, minlength=bits) & 1).tobytes()


def signature(members: np.ndarray) -> bytes:
    """80 bits that name a set: enough for 10**11 different ones, and less to shuffle than 128."""
    return xxhash.xxh3_128_digest(members.tobytes())[:10]


def _profile(k: int, width: int):
    """Per document its key, set size, set signature and bitmap; per task the word counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = WordHashes(), np.zeros(SKETCH, np.int32)
        names = ["key", "n", "sig", "bits", "chunk", "counts"]
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
        for batch in batches:
            n, sig, bits = [], [], []
            for text in batch.column("text"):
                h = hashes.of(text.as_py())
                np.add.at(counts, (h % np.uint64(SKETCH)).astype(np.int64), 1)
                members = np.unique(grams(h, k))
                n.append(len(members))
                sig.append(signature(members))
                bits.append(bitmap(members, width))
            none = [None] * len(n)
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(v, t) for v, t in zip((n, sig, bits, none, none), kinds[1:]))], names)
        at = [i for i in range(SKETCH // CHUNK) if counts[i * CHUNK : (i + 1) * CHUNK].any()]
        blobs = [zlib.compress(counts[i * CHUNK : (i + 1) * CHUNK].tobytes(), 1) for i in at]
        none = [None] * len(at)
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((none, none, none, none, at, blobs), kinds)], names)

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the counts of each chunk, one row of them at a time."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, blob in zip(batch.column("chunk").to_pylist(), batch.column("counts")):
            part = np.frombuffer(zlib.decompress(blob.as_py()), np.int32)
            sums[at] = np.minimum(sums[at].astype(np.int64) + part, 2**31 - 1).astype(np.int32) if at in sums else part
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(v.tobytes(), 1) for v in sums.values()], pa.binary())], ["chunk", "counts"])


def _prefixes(k: int, percent: int, sketch):
    """The first grams of each set in rare-first order, with their positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, common, seen = WordHashes(), sketch.value, set()
        for batch in batches:
            gram, sig, size, pos = [], [], [], []
            for text in batch.column("text"):
                h = hashes.of(text.as_py())
                if not len(h):
                    continue
                often = common[(h % np.uint64(SKETCH)).astype(np.int64)]
                every = grams(h, k)
                rarest = np.lib.stride_tricks.sliding_window_view(often, min(k, len(h))).min(axis=1)
                members, first = np.unique(every, return_index=True)
                own = signature(members)
                if own in seen:  # a copy within this task adds nothing
                    continue
                if len(seen) < 500_000:
                    seen.add(own)
                n = len(members)
                take = n - -(-percent * n // 100) + 1
                order = np.lexsort((members, rarest[first]))[:take]
                gram.append(members[order])
                sig += [own] * take
                size.append(np.full(take, n, np.int32))
                pos.append(np.arange(take, dtype=np.int32))
            if gram:
                flat = [pa.array(np.concatenate(gram).view(np.int64)), pa.array(sig, pa.binary()), pa.array(np.concatenate(size)), pa.array(np.concatenate(pos))]
                yield pa.RecordBatch.from_arrays(flat, ["gram", "sig", "n", "pos"])

    return run


def most_differences(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """In how many elements sets of these sizes may differ; negative if the sizes rule it out."""
    total = a.astype(np.int64) + b
    overlap = -(-percent * total // (100 + percent))
    return np.where(overlap > np.minimum(a, b), -1, total - 2 * overlap)


class Bucket:
    """The sets that meet at one gram."""

    def __init__(self, n, pos, bits, percent):
        self.n, self.pos, self.bits, self.percent = n, pos, bits, percent

    def passing(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs pass the length, positional and suffix filters."""
        ni, nj = self.n[i], self.n[j]
        differ = most_differences(ni, nj, self.percent)
        overlap = (ni.astype(np.int64) + nj - differ) // 2
        ok = (differ >= 0) & (np.minimum(ni - self.pos[i], nj - self.pos[j]) >= overlap)
        out = np.zeros(len(ok), bool)
        at = np.flatnonzero(ok)
        i = np.broadcast_to(i, ok.shape)[at]
        j = np.broadcast_to(j, ok.shape)[at]
        out[at] = np.bitwise_count(self.bits[i] ^ self.bits[j]).sum(axis=1, dtype=np.int64) <= differ[at]
        return out

    def forest(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Edges that connect whatever passing pairs connect, at most one per member."""
        edges, rest = [], np.arange(len(self.n))
        while len(rest):
            stack, rest = [rest[0]], rest[1:]
            while stack and len(rest):
                at = stack.pop()
                ok = self.passing(np.array([at]), rest)
                new, rest = rest[ok], rest[~ok]
                edges.append((np.full(len(new), at), new))
                stack.extend(new)
        return edges

    def across(self, group: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Every passing pair of members of different groups."""
        edges = []
        for at in range(len(self.n) - 1):
            rest = at + 1 + np.flatnonzero(group[at + 1 :] != group[at])
            edges.append((np.full(len(rest), at), rest))
            edges[-1] = tuple(x[self.passing(*edges[-1])] for x in edges[-1])
        return edges


def _meet(percent: int, between_groups: bool, width: int, few_rows: int):
    """Candidate pairs of the buckets, which come whole and in order of gram and block."""

    def candidates(t: pa.Table) -> tuple[list[int], list[bytes], list[bytes]]:
        cols = {c: t.column(c).to_numpy() for c in ("gram", "low", "high", "n", "pos")}
        bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(-1, width // 64)
        sig = np.array(t.column("sig").to_pylist(), object)
        group = np.array(t.column("grp").to_pylist(), object) if between_groups else None
        start = np.flatnonzero(np.r_[True, (np.diff(cols["gram"]) != 0) | (np.diff(cols["low"]) != 0) | (np.diff(cols["high"]) != 0)])
        size = np.diff(np.r_[start, len(sig)])
        whole = Bucket(cols["n"], cols["pos"], bits, percent)
        left, right = [], []
        few = np.repeat(size <= few_rows, size)
        number = np.repeat(np.arange(len(size)), size)
        for step in range(1, few_rows):
            i = np.flatnonzero(few[:-step] & (number[:-step] == number[step:])) if len(sig) > step else np.array([], int)
            if between_groups:
                i = i[group[i] != group[i + step]]
            i = i[whole.passing(i, i + step)] if len(i) else i
            left.append(i)
            right.append(i + step)
        for at, m in zip(start[size > few_rows], size[size > few_rows]):
            part = slice(at, at + m)
            bucket = Bucket(cols["n"][part], cols["pos"][part], bits[part], percent)
            for i, j in bucket.across(group[part]) if between_groups else bucket.forest():
                left.append(at + i)
                right.append(at + j)
        i, j = np.concatenate(left).astype(int), np.concatenate(right).astype(int)
        pairs = {(g, min(a, b), max(a, b)) for g, a, b in zip(cols["gram"][i].tolist(), sig[i], sig[j]) if a != b}
        return [g for g, _, _ in pairs], [a for _, a, _ in pairs], [b for _, _, b in pairs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(t: pa.Table) -> pa.RecordBatch:
            gram, a, b = candidates(t)
            return pa.RecordBatch.from_arrays([pa.array(gram, pa.int64()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["gram", "a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            t = pa.Table.from_batches(held)
            key = [t.column(c).to_numpy() for c in ("gram", "low", "high")]
            other = np.flatnonzero((key[0] != key[0][-1]) | (key[1] != key[1][-1]) | (key[2] != key[2][-1]))
            cut = other[-1] + 1 if len(other) else 0  # the last bucket may go on in the next batch
            if cut:
                yield flush(t.slice(0, cut).combine_chunks())
            held = t.slice(cut).combine_chunks().to_batches()
        if held:
            yield flush(pa.Table.from_batches(held).combine_chunks())

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            members = [np.unique(grams(hashes.of(text.as_py()), k)) for text in batch.column("text")]
            arrays = [pa.array([f(m) for m in members], pa.binary()) for f in (signature, lambda m: m.tobytes())]
            yield pa.RecordBatch.from_arrays(arrays, ["name", "members"])

    return run


def _bucketed(postings: DataFrame, bucket: int) -> DataFrame:
    """Postings of grams with several sets, in blocks where a gram has very many."""
    of = Window.partitionBy("gram")
    many = postings.withColumn("m", F.count("*").over(of)).where("m > 1")
    blocks = F.ceil(F.col("m") / bucket).cast("int")
    own = F.pmod(F.xxhash64("sig"), blocks).cast("int")
    cut = many.withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
    return cut.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("m", "own", "other")


def _candidates(postings: DataFrame, percent: int, between_groups: bool, width: int, few: int, bucket: int) -> DataFrame:
    keys = ["gram", "low", "high"]
    met = _bucketed(postings, bucket).repartition("gram", "low", "high").sortWithinPartitions(*keys)
    return met.mapInArrow(_meet(percent, between_groups, width, few), "gram bigint, a binary, b binary")


def classes(documents: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", width: int = BITMAP, few: int = FEW, bucket: int = BUCKET) -> DataFrame:
    """``(key, n, sig, component_id)`` for every document.

    ``n`` is the size of its set and ``component_id`` the smallest key it is linked to, over any
    number of links: ``100 * intersection >= percent * union``. Null, empty and blank texts have
    empty sets, which are linked with nothing: their component is their own key. Null keys never
    name a component that has another. Equal rows stay; an empty table gives no rows.
    """
    spark = documents.sparkSession
    ship_package(spark)
    read = documents.select(F.col(key).cast("bigint").alias("key"), F.col("text").cast("binary").alias("text"))
    profile = stage(read.mapInArrow(_profile(k, width), "key bigint, n int, sig binary, bits binary, chunk int, counts binary"), "profiles")
    each = profile.where("sig is not null").select("key", "n", "sig", "bits")
    nodes = stage(each.where("n > 0").groupBy("sig").agg(F.min("key").alias("first_key"), F.max("bits").alias("bits")), "nodes")

    sums = profile.where("chunk is not null").select("chunk", "counts").repartition("chunk").mapInArrow(_add_up, "chunk int, counts binary")
    sketch = np.zeros(SKETCH, np.int32)
    for row in sums.collect():  # SKETCH / CHUNK rows, whatever the input
        sketch[row.chunk * CHUNK : (row.chunk + 1) * CHUNK] = np.frombuffer(zlib.decompress(row.counts), np.int32)
    shared = spark.sparkContext.broadcast(sketch)

    prefixes = read.select("text").mapInArrow(_prefixes(k, percent, shared), "gram bigint, sig binary, n int, pos int")
    # Copies that came from several tasks go; so does who has no partner of a fitting size.
    apart = prefixes.repartition("gram").dropDuplicates(["gram", "sig"])
    by_size = Window.partitionBy("gram").orderBy("n", "sig")
    near = [other.isNotNull() & (100 * F.least("n", other) >= percent * F.greatest("n", other)) for other in (F.lag("n").over(by_size), F.lead("n").over(by_size))]
    met = apart.withColumn("_near", near[0] | near[1]).where("_near").drop("_near")
    postings = stage(met.join(nodes.select("sig", "bits"), "sig"), "postings")
    shared.unpersist()

    found = stage(_candidates(postings, percent, False, width, few, bucket), "candidates")
    links, refused = _verified(read, nodes, found.select("a", "b").distinct(), k, percent)
    if refused:
        # Where all that was emitted is true, all that passes is within one group.
        wrong = found.join(links, ["a", "b"], "left_anti").select("gram").distinct()
        again = postings.join(wrong, "gram", "left_semi")
        groups = connected_components(links).toDF("sig", "linked")
        regrouped = again.join(groups, "sig", "left").withColumn("grp", F.coalesce("linked", "sig")).drop("linked")
        of = Window.partitionBy("gram")
        mixed = regrouped.withColumns({"_l": F.min("grp").over(of), "_h": F.max("grp").over(of)}).where("_l < _h").drop("_l", "_h")
        more, _ = _verified(read, nodes, _candidates(mixed, percent, True, width, few, bucket).select("a", "b").distinct(), k, percent)
        links = links.unionByName(more)
    groups = stage(connected_components(links).toDF("sig", "linked"), "groups")
    members = nodes.join(groups, "sig", "left").withColumn("linked", F.coalesce("linked", "sig"))
    firsts = members.groupBy("linked").agg(F.min("first_key").alias("component_id"))
    named = members.select("sig", "linked").join(firsts, "linked").select("sig", "component_id")
    return each.drop("bits").join(named, "sig", "left").select("key", "n", "sig", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id"))


def _verified(read: DataFrame, nodes: DataFrame, pairs: DataFrame, k: int, percent: int) -> tuple[DataFrame, int]:
    """The true links among candidate pairs, and how many candidates are none."""
    pairs, n = stage_counted(pairs, "pairs")
    ends = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct()
    wanted, n_wanted = stage_counted(ends.join(nodes, "sig").select("sig", "first_key"), "wanted")
    keyed = read.join(small_side(wanted.select(F.col("first_key").alias("key")), n_wanted), "key", "left_semi")
    texts = keyed.unionByName(read.where("key is null")).select("text")
    sets = texts.mapInArrow(_sets(k), "name binary, members binary")
    sets = stage(sets.join(small_side(wanted.select(F.col("sig").alias("name")), n_wanted), "name", "left_semi"), "sets")
    links, n_links = linked_pairs(pairs, n, sets, percent)
    return links, n - n_links


def linked_documents(documents: DataFrame) -> DataFrame:
    """The groups of three-word shingles at 90 %, with the columns of the query."""
    return classes(documents, 3, 90).select(F.col("key").alias("doc_id"), F.col("n").cast("bigint").alias("n_shingles"), "component_id")


def _placed(documents: DataFrame) -> DataFrame:
    """``documents`` with a number ``_row`` that tells all rows apart, made of their places in files.

    Where that is a hash which two rows share, or the rows do not come straight from files, it is
    a number in a staged copy.
    """
    try:
        placed = documents.select("*", F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("_row"))
        if placed.groupBy("_row").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            return placed
    except AnalysisException:
        pass
    return stage(documents.withColumn("_row", F.monotonically_increasing_id()), "near-documents")


@passing_columns
def keep_one(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one of each group of near copies, and all that have no words.

    Rows are told apart by their places, so null and repeated ids do no harm, and repeated rows
    are copies like others.
    """
    placed = _placed(documents)
    found = classes(placed, k, percent, key="_row")
    rest, n = stage_counted(found.where("key <> component_id").select(F.col("key").alias("_row")), "near-copies")
    return placed.join(small_side(rest, n), "_row", "left_anti").select(*documents.columns)
