"""Near duplicates by SuperMinHash signatures, banding, verification and union-find grouping.

A document's set has its distinct word n-grams (64-bit hashes). SuperMinHash (Ertl, 2017) deals
each element to all places of the signature in an order of its own: its j-th place gets the
value j + r with r below 1, and each place keeps the least value. Values grow with j, so a set is
done as soon as all its places are below j, which for long texts is after a few steps. The places
of two sets agree with the probability of their Jaccard similarity, and since an element's values
are spread over the places, the share that agrees varies less than with independent hashes.

Documents with equal sets are one node. Nodes meet where all places of a band agree. Per band
value the members are tied to one of them, a pivot that most bands of a group share, and each
pair is verified once on the whole sets. Where a member is refused by its pivot it may still be
linked to another one, so those band values are searched: members outside of the largest
component so far meet all members of other components whose signatures agree well enough and
whose parity bitmaps differ in no more bits than the sets may differ in elements. A first search
verifies the best partner of each, which joins most components, a second one whatever is left. Sets at the limit miss each other in all bands, or fall below the agreement asked for,
with a probability below 10**-6.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.llm.jaccard_join import WordHashes, bitmap, grams, most_differences, signature
from twinsift.llm.set_pairs import linked_pairs
from twinsift.operators.components import connected_components
from twinsift.skew import join_groups, with_aggregates
from twinsift.staging import ship_package, small_side, stage, stage_counted

#: Bands and their places: sets of similarity 0.8 miss each other with probability 1.3e-7.
BANDS, PLACES = 40, 5

#: Elements that are dealt at once.
CHUNK = 50_000

#: Members of a pivot that are verified in one task, and of a band value that meet in one.
GROUP, CELL = 512, 2048

#: Deviations below the asked similarity at which the agreement of signatures rules a pair out.
DEVIATIONS = 5


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def super_minhash(sets: list[np.ndarray], places: int = BANDS * PLACES) -> np.ndarray:
    """Signatures (one row per set) of non-empty sets of distinct 64-bit hashes."""
    least = np.full((len(sets), places), 2**64 - 1, np.uint64)
    at, piece, owners, held = 0, [], [], 0
    for number, members in enumerate(sets):
        for at in range(0, len(members), CHUNK):
            part = members[at : at + CHUNK]
            piece.append(part)
            owners.append(np.full(len(part), number))
            held += len(part)
            if held >= CHUNK:
                _deal(np.concatenate(piece), np.concatenate(owners), least)
                piece, owners, held = [], [], 0
    if piece:
        _deal(np.concatenate(piece), np.concatenate(owners), least)
    return least


def _deal(elements: np.ndarray, owner: np.ndarray, least: np.ndarray) -> None:
    """Lower the places of the owners' signatures to the values of their elements."""
    places = least.shape[1]
    order = np.tile(np.arange(places, dtype=np.uint8 if places <= 256 else np.uint16), (len(elements), 1))
    row, flat, sets = np.arange(len(elements)), least.reshape(-1), np.unique(owner)
    for j in range(places):
        x = _mix(elements[row] + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64))
        other = j + (((x >> np.uint64(32)) * np.uint64(places - j)) >> np.uint64(32)).astype(np.int64)
        place = order[row, other]
        order[row, other] = order[row, j]
        value = (x & np.uint64(0xFFFFFFFF)) | np.uint64(j << 32)
        np.minimum.at(flat, owner[row] * places + place, value)
        left = least[sets].max(axis=1) >= np.uint64((j + 1) << 32)
        if not left.all():
            sets = sets[left]
            if not len(sets):
                return
            open_set = np.zeros(len(least), bool)
            open_set[sets] = True
            row = row[open_set[owner[row]]]


def band_values(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit value per set and band."""
    out = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signatures), 1))
    for part in np.moveaxis(signatures.reshape(-1, BANDS, PLACES), 2, 0):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + part)
    return out


def _profile(k: int):
    """Per document its key, the size and name of its set, a byte per place, a bitmap and the band values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            n, names, new, at = [], [], [], {}
            for text in batch.column("text"):
                members = np.unique(grams(hashes.of(text.as_py()), k))
                n.append(len(members))
                names.append(signature(members) if len(members) else None)
                if len(members) and names[-1] not in at:
                    at[names[-1]] = len(new)
                    new.append(members)
            signs = super_minhash(new)
            low, bands = (signs & np.uint64(255)).astype(np.uint8), band_values(signs)
            bits = [bitmap(members) for members in new]
            rows = [None if name is None else at[name] for name in names]
            yield pa.RecordBatch.from_arrays([
                batch.column("key"), pa.array(n, pa.int32()), pa.array(names, pa.binary()),
                pa.array([None if i is None else low[i].tobytes() for i in rows], pa.binary()),
                pa.array([None if i is None else bits[i] for i in rows], pa.binary()),
                pa.array([None if i is None else bands[i].view(np.int64) for i in rows], pa.list_(pa.int64())),
            ], ["key", "n", "sig", "low", "bits", "bands"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            members = [np.unique(grams(hashes.of(text.as_py()), k)) for text in batch.column("text")]
            arrays = [pa.array([f(m) for m in members], pa.binary()) for f in (signature, lambda m: m.tobytes())]
            yield pa.RecordBatch.from_arrays(arrays, ["sig", "members"])

    return run


def _verified(read: DataFrame, nodes: DataFrame, pairs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame, int]:
    """``(a, b)`` of the staged distinct pairs, those that are links, and how many are not."""
    pairs, n = stage_counted(pairs.distinct(), "met")
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted, n_wanted = stage_counted(ends.join(nodes.select("node", "sig", "first_key"), "node"), "wanted")
    keyed = read.join(small_side(wanted.select(F.col("first_key").alias("key")).distinct(), n_wanted), "key", "left_semi")
    texts = keyed.unionByName(read.where("key is null")).select("text")
    sets = texts.mapInArrow(_sets(k), "sig binary, members binary")
    sets = stage(sets.join(small_side(wanted.select("sig", F.col("node").alias("name")), n_wanted), "sig").select("name", "members"), "sets")
    links, n_links = linked_pairs(pairs, n, sets, percent, GROUP)
    return pairs, links, n - n_links


def _agreeing(percent: int, only_best: bool):
    """Pairs of different components whose signatures and bitmaps agree well; cells come whole and in order."""
    places = BANDS * PLACES
    p = percent / 100
    least = math.floor(places * p - DEVIATIONS * math.sqrt(places * p * (1 - p)))

    def pairs(t: pa.Table) -> list[tuple[int, int]]:
        node, component, n, minor = (t.column(c).to_numpy() for c in ("node", "component", "n", "minor"))
        low = np.frombuffer(b"".join(t.column("low").to_pylist()), np.uint8).reshape(-1, places)
        bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(len(low), -1)
        rest, found = np.flatnonzero(~minor), []
        for i in np.flatnonzero(minor).tolist():
            differ = most_differences(n[rest], n[i], percent)  # negative where the sizes are too far apart
            fit = np.flatnonzero((component[rest] != component[i]) & (differ >= 0))
            fit = rest[fit[np.bitwise_count(bits[rest[fit]] ^ bits[i]).sum(axis=1, dtype=np.int64) <= differ[fit]]]
            if not len(fit):
                continue
            agree = (low[fit] == low[i]).sum(axis=1)
            fit = fit[[agree.argmax()]] if only_best else fit
            found += [(int(node[i]), int(x)) for x in node[fit[(agree.max(keepdims=True) if only_best else agree) >= least]]]
        return [(min(x), max(x)) for x in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(t: pa.Table) -> pa.RecordBatch:
            key = [t.column(c).to_numpy() for c in ("band", "i", "j")]
            start = np.flatnonzero(np.r_[True, np.any([np.diff(x) != 0 for x in key], axis=0)])
            found = {pair for s, m in zip(start, np.diff(np.r_[start, len(key[0])])) for pair in pairs(t.slice(s, m))}
            return pa.RecordBatch.from_arrays([pa.array([p[c] for p in found], pa.int64()) for c in (0, 1)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            t = pa.Table.from_batches(held)
            key = [t.column(c).to_numpy() for c in ("band", "i", "j")]
            other = np.flatnonzero(np.any([x != x[-1] for x in key], axis=0))
            cut = int(other[-1]) + 1 if len(other) else 0  # the last cell may go on in the next batch
            if cut:
                yield flush(t.slice(0, cut).combine_chunks())
            held = t.slice(cut).combine_chunks().to_batches()
        if held:
            yield flush(pa.Table.from_batches(held).combine_chunks())

    return run


def _across(rows: DataFrame, nodes: DataFrame, links: DataFrame, percent: int, only_best: bool, total: int) -> DataFrame:
    """Pairs to verify of the band values ``rows(band, node)`` at which components meet."""
    groups = connected_components(links).toDF("node", "component")
    named = rows.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = stage(named, "named")
    sizes = named.groupBy("band", "component").agg(F.count("*").alias("m"))
    bands = sizes.groupBy("band").agg(
        F.sum("m").alias("all"), F.max(F.struct("m", "component")).alias("main"), F.count("*").alias("parts")
    ).where("parts > 1").selectExpr("band", "all", "main.component as main", "all - main.m as minors")
    met = join_groups(named, bands, ["band"], "all", total)
    met = met.selectExpr(
        "band", "node", "component", "component <> main as minor", f"cast(ceil(all / {CELL}) as int) as nj", f"cast(ceil(minors / {CELL}) as int) as ni"
    ).join(nodes.select("node", "n", "low", "bits"), "node")
    own = "cast(pmod(xxhash64(node), {}) as int)"
    columns = ["band", "node", "component", "n", "low", "bits"]
    as_minor = met.where("minor").selectExpr(*columns, "true as minor", f"{own.format('ni')} as i", "explode(sequence(0, nj - 1)) as j")
    as_any = met.selectExpr(*columns, "false as minor", "explode(sequence(0, ni - 1)) as i", f"{own.format('nj')} as j")
    dealt = as_minor.unionByName(as_any).repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    return dealt.mapInArrow(_agreeing(percent, only_best), "a bigint, b bigint")


def near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id") -> DataFrame:
    """``(key, n, component_id, kept)`` for every document.

    ``n`` is the size of its set of ``k``-word shingles (A-Z in lower case; fewer words are one
    shingle) and ``component_id`` the smallest key it is linked to, over any number of links:
    ``100 * intersection >= percent * union``. ``kept`` marks whose key this is. Null, empty and
    blank texts have empty sets, which are linked with nothing: their component is their own key,
    and they are kept. Null keys never name a component that has another; where all keys of a
    component are null, so is its name, and its rows are kept. Repeated rows stay, with the same
    values each; other columns do not matter. An empty table gives no rows.
    """
    spark = documents.sparkSession
    ship_package(spark)
    read = documents.select(F.col(key).cast("bigint").alias("key"), F.col("text").cast("binary").alias("text"))
    profile, total = stage_counted(read.mapInArrow(_profile(k), "key bigint, n int, sig binary, low binary, bits binary, bands array<bigint>"), "profiles")
    distinct = profile.where("n > 0").groupBy("sig").agg(
        F.min("key").alias("first_key"), F.count("*").alias("copies"), *[F.any_value(c).alias(c) for c in ("n", "low", "bits", "bands")]
    )
    nodes, n_nodes = stage_counted(distinct.withColumn("node", F.monotonically_increasing_id()), "nodes")

    places = nodes.select("node", F.explode("bands").alias("band"))
    met = with_aggregates(places, ["band"], {"pivot": F.min("node")}, n_nodes * BANDS, having="_rows > 1")
    met = stage(met.select("band", "node", "pivot"), "bands")
    pairs, links, refused = _verified(read, nodes, met.where("node <> pivot").selectExpr("pivot as a", "node as b"), k, percent)
    if refused:
        wrong = pairs.join(links, ["a", "b"], "left_anti").selectExpr("a as pivot", "b as node")
        bands = met.join(small_side(wrong, refused), ["pivot", "node"], "left_semi").select("band").distinct()
        rows, n_rows = stage_counted(met.join(bands, "band", "left_semi").select("band", "node"), "refused")
        for only_best in (True, False):
            _, more, _ = _verified(read, nodes, _across(rows, nodes, links, percent, only_best, n_rows), k, percent)
            links = links.unionByName(more)
    groups = connected_components(links).toDF("node", "component")
    members = nodes.select("node", "sig", "first_key", "copies").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = with_aggregates(members, ["component"], {"component_id": F.min("first_key")}, n_nodes).select("sig", "copies", "component_id")
    each = profile.select("key", "n", "sig")
    found = join_groups(each.where("n > 0"), named, ["sig"], "copies", total).select("key", "n", "component_id")
    out = found.unionByName(each.where("n = 0").select("key", "n", F.col("key").alias("component_id")))
    return out.withColumn("kept", F.col("key").eqNullSafe(F.col("component_id")))


def kept_documents(documents: DataFrame) -> DataFrame:
    """The groups of four-word shingles at 80 %, with the columns of the query."""
    found = near_duplicates(documents, 4, 80)
    return found.select(F.col("key").alias("doc_id"), F.col("n").cast("bigint").alias("n_shingles"), "component_id", "kept")
