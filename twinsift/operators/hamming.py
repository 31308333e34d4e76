"""Exact self-join of 64-bit hashes within a Hamming distance, without comparing all pairs.

The 64 bits are cut into m blocks with radii r_i where the r_i + 1 add up to t + 1. Two
hashes within distance t then agree within r_i in some block i (otherwise they would differ
in at least t + 1 bits), so an equi-join on block values finds every pair: one side flips up
to ceil(r_i / 2) bits of its block value, the other up to floor(r_i / 2). The number of
blocks follows from the number of hashes.

Each pair is found once: it belongs to the first block in which its two hashes are near enough,
and there to the one block value that lies a fixed way from the one to the other. Both follow
from the two hashes, so no list of pairs has to be made distinct.

Block values at which too many pairs would meet are cut again by blocks of the remaining bits,
and so on while bits remain; what is left then, and thresholds for which blocks cost more than
comparing all pairs, is compared in square tiles. So never more than all pairs are compared.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import comb

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.functions.bits import hamming
from twinsift.staging import hot_pairs, shuffle_width, small_side, stage, stage_counted

BITS = 64
BLOCK_TAG = 40  # a probe is (block number << BLOCK_TAG) | block value
MAX_BLOCK = 32

#: Buckets that hold more than this part of all rows are fewer than that.
HOT_SHARE = 1000

#: Bytes of a shuffled probe row, and the bytes that are shuffled in the time one pair is compared.
PROBE_BYTES, PAIR_BYTES = 40, 0.4
#: Most probes one hash may send per side; rules out blocks so wide that their balls explode.
MAX_PROBES = 20_000

#: Hashes on each side of a tile, in which all pairs are compared.
TILE = 8192

#: Pairs one task of a join compares, bytes that it reads, and most tasks a join is given.
PAIRS_PER_TASK = 1_000_000_000
TASK_BYTES = 256 << 20
MAX_TASKS = 50_000
#: A block value is hot only if this many times more pairs meet at it than on even data.
SKEW_FACTOR = 8


@dataclass(frozen=True)
class Block:
    number: int
    shift: int
    width: int
    radius: int

    @property
    def left(self) -> int:
        return (self.radius + 1) // 2

    @property
    def right(self) -> int:
        return self.radius // 2


def _ball(width: int, radius: int) -> int:
    return sum(comb(width, k) for k in range(radius + 1))


def _expected_pairs(n: int, blocks: list[Block]) -> float:
    """Pairs that meet if the hashes are spread evenly."""
    return n * n * sum(_ball(b.width, b.radius) / 2**b.width for b in blocks)


def _cut(regions: list[tuple[int, int]], m: int, threshold: int) -> list[Block]:
    """m blocks within the (shift, width) regions, as even as can be, with their radii."""
    blocks, spare = [], []
    total = sum(width for _, width in regions)
    for shift, width in regions:
        parts = max(1, round(m * width / total))
        edges = [width * i // parts for i in range(parts + 1)]
        spare += [(shift + a, b - a) for a, b in zip(edges, edges[1:])]
    share, extra = divmod(threshold + 1, len(spare))
    for number, (shift, width) in enumerate(spare):
        radius = share + (1 if number < extra else 0) - 1
        if radius >= 0:
            blocks.append(Block(number, shift, width, min(radius, width)))
    return blocks


def _cost(n: int, blocks: list[Block]) -> float:
    """Bytes shuffled, and compared pairs as bytes."""
    probes = sum(_ball(b.width, b.left) + _ball(b.width, b.right) for b in blocks)
    return PROBE_BYTES * n * probes + PAIR_BYTES * _expected_pairs(n, blocks)


def _tiled_cost(n: int) -> float:
    return PROBE_BYTES * n * (-(-n // TILE) + 1) + PAIR_BYTES * n * n / 2


def plan_blocks(n: int, threshold: int, regions: list[tuple[int, int]] | None = None) -> list[Block] | None:
    """The cheapest cut for ``n`` hashes; None if comparing all pairs in tiles costs less."""
    regions = regions or [(0, BITS)]
    bits = sum(width for _, width in regions)
    best, best_cost = None, None
    for m in range(len(regions), bits + 1):
        blocks = _cut(regions, m, threshold)
        if any(b.width > MAX_BLOCK for b in blocks):
            continue
        left = sum(_ball(b.width, b.left) for b in blocks)
        right = sum(_ball(b.width, b.right) for b in blocks)
        if max(left, right) > MAX_PROBES:
            continue
        cost = _cost(n, blocks)
        if best_cost is None or cost < best_cost:
            best, best_cost = blocks, cost
        if m > threshold:  # more blocks than this stay unused
            break
    return best if best is not None and best_cost < _tiled_cost(n) else None


def spread_bits(value: str) -> str:
    """SQL for the bits of a hash in an order that puts neighbouring image rows into different blocks.

    Flat image regions make whole runs of bits equal in many images; spread out, they no
    longer fill a block. Distances do not change under a reordering of bits.
    """
    # 25 and 64 have no common factor, so i -> 25 * i mod 64 reaches every place once.
    moved = [f"shiftleft(shiftrightunsigned({value}, {i}) & 1L, {25 * i % BITS})" for i in range(BITS)]
    return " | ".join(moved)


def _longs(values: list[int]) -> str:
    """SQL for a constant ARRAY<BIGINT>; as text, since thousands of literals are slow to parse."""
    return f"cast(split('{','.join(map(str, values))}', ',') as array<bigint>)"


def _flips(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(width), k)]


def _table(blocks: list[Block], value) -> str:
    """SQL for the array of a value per block, by block number."""
    table = {b.number: value(b) for b in blocks}
    return "array(" + ", ".join(f"{table.get(i, 0)}L" for i in range(max(table) + 1)) + ")"


def _probes(rows: DataFrame, blocks: list[Block], side: str, out: str) -> DataFrame:
    """One row per probe: column ``out`` is the block number and a value near the row's block value."""
    offers = [
        (b.number << BLOCK_TAG) | flip for b in blocks for flip in _flips(b.width, getattr(b, side))
    ]
    own = _block_value("_bits", f"shiftright(_offer, {BLOCK_TAG})", blocks)
    offered = rows.selectExpr("*", f"explode({_longs(offers)}) as _offer")
    return offered.selectExpr(*rows.columns, f"_offer ^ ({own}) as {out}")


def _block_value(bits: str, number: str, blocks: list[Block]) -> str:
    shift, mask = _table(blocks, lambda b: b.shift), _table(blocks, lambda b: (1 << b.width) - 1)
    number = f"cast({number} as int)"
    return f"(shiftrightunsigned({bits}, cast(get({shift}, {number}) as int)) & get({mask}, {number}))"


def _owned(key: str, blocks: list[Block]) -> str:
    """SQL: whether the pair of bits ``_la`` and ``_lb`` that meets at ``key`` belongs there.

    No earlier block may have the pair, and of the values between the two block values it is the
    one that takes the lowest differing bits from the right, as many as the left side may flip.
    """
    number = f"shiftright({key}, {BLOCK_TAG})"
    parts = [
        f"({number} <= {b.number} or bit_count((_la ^ _lb) & {_signed(((1 << b.width) - 1) << b.shift)}) > {b.radius})" for b in blocks[:-1]
    ]
    differ = f"(({_block_value('_la', number, blocks)}) ^ ({_block_value('_lb', number, blocks)}))"
    flips = f"get({_table(blocks, lambda b: b.left)}, cast({number} as int))"
    rest = cleared = differ
    for step in range(1, max(b.left for b in blocks) + 1):  # one lowest bit less for each that the left side may flip
        cleared = f"({cleared} & ({cleared} - 1L))"
        rest = f"if({flips} < {step}, {rest}, {cleared})"
    # What is left to the right side lies above; the key is the right value without it.
    parts.append(f"({key} & {(1 << BLOCK_TAG) - 1}L) = ({_block_value('_lb', number, blocks)} ^ {rest})")
    return " and ".join(parts)


def _signed(value: int) -> str:
    value -= (value >> 63) << 64
    return f"({value}L)" if value > -(2**63) else "shiftleft(1L, 63)"


def _meet(left: DataFrame, right: DataFrame, keys: list[str], threshold: int, owned: str, tasks: int) -> DataFrame:
    """Pairs (a < b) that share the keys, are within the threshold, and are at home there."""
    left = left.selectExpr(*keys, "hash as _ha", "_bits as _la", "_class as _ca")
    right = right.selectExpr(*keys, "hash as _hb", "_bits as _lb", "_class as _cb")
    if tasks > shuffle_width(left.sparkSession):  # the work is in the pairs, which sizes of rows don't tell
        left, right = left.repartition(tasks, *keys), right.repartition(tasks, *keys)
    # A sort-merge join: the optimizer does not see how far the probes multiply the rows.
    return left.hint("merge").join(right, keys).where(
        f"_ha < _hb and bit_count(_ha ^ _hb) <= {threshold} and (_ca is null or _cb is null or _ca <> _cb) and {owned}"
    ).selectExpr("_ha as a", "_hb as b")


def _tasks(n: int, blocks: list[Block]) -> int:
    """Tasks for a join, by the pairs that it compares and the rows that it reads."""
    probes = n * sum(_ball(b.width, b.left) + _ball(b.width, b.right) for b in blocks)
    return min(MAX_TASKS, int(max(_expected_pairs(n, blocks) / PAIRS_PER_TASK, probes * PROBE_BYTES / TASK_BYTES)))


def _tiled(left: DataFrame, right: DataFrame, keys: list[str], sizes: str, threshold: int, owned: str) -> DataFrame:
    """Pairs that share the keys, all of a left tile with all of a right tile in one task.

    ``sizes`` are SQL expressions for the rows of a key on either side.
    """
    n_left, n_right = (f"cast(ceil({size} / {TILE}) as int)" for size in sizes.split(";"))
    place = "cast(pmod(xxhash64(hash), {}) as int)"
    l = left.selectExpr("*", f"{place.format(n_left)} as _i", f"explode(sequence(0, {n_right} - 1)) as _j")
    r = right.selectExpr("*", f"explode(sequence(0, {n_left} - 1)) as _i", f"{place.format(n_right)} as _j")
    return _meet(l, r, [*keys, "_i", "_j"], threshold, owned, 0)


def hamming_pairs(hashes: DataFrame, threshold: int) -> DataFrame:
    """``(a, b)`` with a < b, once each: all pairs of the distinct BIGINT column ``hash`` within ``threshold``."""
    hashes, n = stage_counted(hashes.selectExpr("hash", f"{spread_bits('hash')} as _bits"), "hashes")
    return pairs_of(hashes, n, threshold)


def pairs_of(hashes: DataFrame, n: int, threshold: int, linked: bool = False) -> DataFrame:
    """The same for a staged table of ``n`` rows ``(hash, _bits)``, the bits by ``spread_bits``.

    With ``linked`` only enough of the pairs to keep the same hashes connected: where a dense
    cluster makes a block value hot, its members are tied to one of them and the pairs among
    them are left out, so a cluster of k hashes costs about k pairs instead of k * k.
    """
    if threshold < 0:
        return hashes.selectExpr("hash as a", "hash as b").where("false")
    spark = hashes.sparkSession
    if threshold >= BITS:  # every pair is near: tie all to the smallest
        if not linked:
            raise ValueError("a threshold of 64 or more pairs everything; ask for a smaller one")
        smallest = hashes.agg(F.min("hash").alias("a"))
        return hashes.join(F.broadcast(smallest), F.col("hash") > F.col("a")).selectExpr("a", "hash as b")
    blocks = plan_blocks(n, threshold)
    plain = hashes.selectExpr("*", "cast(null as bigint) as _class")
    many = n * n > hot_pairs(spark)  # else no bucket can be hot
    hot, n_hot = None, 0
    if many and blocks is not None:
        hot, n_hot = stage_counted(_hot_keys(plain, n, blocks, hot_pairs(spark)), "hot-keys")
    star, classed = None, plain
    if linked and (n_hot or many and blocks is None):
        # The class of a hash is the centre of the largest ball it lies in.
        if centres := _centres(plain, blocks or _cut([(0, BITS)], 8, 7), n):
            centres = _by_reach(hashes, centres, threshold)
            classed = stage(
                hashes.selectExpr("*", f"get({_within('hash', centres, threshold)}, 0) as _class"), "classes"
            )
            star = classed.where("_class <> hash").selectExpr("least(hash, _class) as a", "greatest(hash, _class) as b")
    if blocks is None:
        pairs = _tiled(classed, classed, [], f"{n};{n}", threshold, "true")
        return pairs if star is None else pairs.unionByName(star)
    if n_hot == 0:
        return _meet(*_sides(plain, blocks), ["_key"], threshold, _owned("_key", blocks), _tasks(n, blocks))
    left, right = _sides(classed, blocks)
    listed = small_side(hot.select("_key"), n_hot)
    owned = _owned("_key", blocks)
    cold = _meet(
        left.join(listed, "_key", "left_anti"), right.join(listed, "_key", "left_anti"), ["_key"], threshold, owned, _tasks(n, blocks)
    )
    hot_left, hot_right = left.join(listed, "_key", "left_semi"), right.join(listed, "_key", "left_semi")
    pairs = cold
    for l, r in _across_classes(hot_left, hot_right, n_hot) if linked else [(hot_left, hot_right)]:
        pairs = pairs.unionByName(_cut_again(l, r, blocks, hot, ["_key"], [(0, BITS)], threshold, owned))
    return pairs if star is None else pairs.unionByName(star)


def _sides(hashes: DataFrame, blocks: list[Block]) -> tuple[DataFrame, DataFrame]:
    return _probes(hashes, blocks, "left", "_key"), _probes(hashes, blocks, "right", "_key")


def _hot_keys(hashes: DataFrame, n: int, blocks: list[Block], limit: int) -> DataFrame:
    """Keys at which too many pairs would meet, and how many rows do: ``(_key, _met)``.

    Too many is more than ``limit`` and several times what evenly spread hashes would give.
    Counted from block values, of which there are far fewer than probes.
    """
    exact = [Block(b.number, b.shift, b.width, 0) for b in blocks]
    values = _probes(hashes, exact, "left", "_value").groupBy("_value").agg(F.count("*").alias("_n"))
    values = stage(values, "block-values")

    def reach(side: str, out: str) -> DataFrame:
        parts = []
        for b in blocks:
            mine = values.where(F.shiftright("_value", BLOCK_TAG) == b.number)
            near = mine.selectExpr("*", f"explode({_longs(_flips(b.width, getattr(b, side)))}) as _flip")
            parts.append(near.selectExpr("_value ^ _flip as _key", "_n"))
        together = parts[0]
        for part in parts[1:]:
            together = together.unionByName(part)
        return together.groupBy("_key").agg(F.sum("_n").alias(out))

    met = reach("left", "_l").join(reach("right", "_r"), "_key")
    bound = _table(blocks, lambda b: max(limit, int(SKEW_FACTOR * _even_meetings(n, b))))
    return met.where(
        f"cast(_l as double) * _r > get({bound}, cast(shiftright(_key, {BLOCK_TAG}) as int))"
    ).selectExpr("_key", "_l + _r as _met")


def _even_meetings(n: int, block: Block) -> float:
    """Pairs that meet at one value of a block if the hashes are spread evenly."""
    per_value = n / 2**block.width
    return per_value * _ball(block.width, block.left) * per_value * _ball(block.width, block.right)


def _rest_of(block: Block, regions: list[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
    """The regions without the bits of a block, as (shift, width)."""
    out = []
    for shift, width in regions or [(0, BITS)]:
        ends = sorted({shift, shift + width, *(x for x in (block.shift, block.shift + block.width) if shift < x < shift + width)})
        out += [(a, b - a) for a, b in zip(ends, ends[1:]) if not block.shift <= a < block.shift + block.width]
    return out


def _cut_again(
    left: DataFrame, right: DataFrame, blocks: list[Block], hot: DataFrame, keys: list[str],
    regions: list[tuple[int, int]], threshold: int, owned: str,
) -> DataFrame:
    """Pairs that meet at hot keys, cut by the remaining bits until no key is hot or no bits remain.

    ``hot`` has the hot keys and how many rows meet there as ``_met``. Pairs at a hot key are
    near in its block, so the whole threshold may lie in the bits that remain.
    """
    number = F.shiftright(keys[-1], BLOCK_TAG)
    largest = hot.groupBy(number.alias("block")).agg(F.max("_met").alias("rows")).collect()  # a row per block
    rows_in = {row.block: row.rows for row in largest}
    limit, out = hot_pairs(left.sparkSession), None
    for block in (b for b in blocks if b.number in rows_in):
        l, r = (side.where(number == block.number) for side in (left, right))
        rest = _rest_of(block, regions)
        finer = plan_blocks(rows_in[block.number], threshold, rest) if rest else None
        if finer is None:
            sizes = hot.select(*keys, "_met")
            met = _tiled(l.join(sizes, keys), r.join(sizes, keys), keys, "_met;_met", threshold, owned)
        else:
            name = f"_key{len(keys)}"
            l, r = _probes(l, finer, "left", name), _probes(r, finer, "right", name)
            met = _deeper(l, r, finer, [*keys, name], rest, threshold, f"{owned} and {_owned(name, finer)}", limit)
        out = met if out is None else out.unionByName(met)
    return out


def _deeper(
    left: DataFrame, right: DataFrame, blocks: list[Block], keys: list[str],
    regions: list[tuple[int, int]], threshold: int, owned: str, limit: int,
) -> DataFrame:
    """Pairs of probes that share all keys; the keys that are still hot are cut once more."""
    counts = left.groupBy(*keys).agg(F.count("*").alias("_l")).join(right.groupBy(*keys).agg(F.count("*").alias("_r")), keys)
    met = counts.agg(F.sum(F.expr("cast(_l as double) * _r")).alias("pairs"), F.sum(F.expr("_l + _r")).alias("rows")).first()
    if met.pairs is None:
        return left.selectExpr("hash as a", "hash as b").where("false")
    tasks = min(MAX_TASKS, int(max(met.pairs / PAIRS_PER_TASK, met.rows * PROBE_BYTES / TASK_BYTES)))
    hot, n_hot = stage_counted(counts.where(f"cast(_l as double) * _r > {limit}").selectExpr(*keys, "_l + _r as _met"), "hot-keys")
    if n_hot == 0:
        return _meet(left, right, keys, threshold, owned, tasks)
    listed = small_side(hot.select(*keys), n_hot)
    cold = _meet(left.join(listed, keys, "left_anti"), right.join(listed, keys, "left_anti"), keys, threshold, owned, tasks)
    l, r = left.join(listed, keys, "left_semi"), right.join(listed, keys, "left_semi")
    return cold.unionByName(_cut_again(l, r, blocks, hot, keys, regions, threshold, owned))


def _across_classes(l: DataFrame, r: DataFrame, n_hot: int) -> list[tuple[DataFrame, DataFrame]]:
    """The two sides of the meetings at hot keys, but those within a key's largest class."""
    classes = l.where("_class is not null").groupBy("_key", "_class").agg(F.count("*").alias("_n"))
    main = classes.groupBy("_key").agg(F.max_by("_class", "_n").alias("_main"))
    main = small_side(stage(main, "main-classes"), n_hot)
    l, r = l.join(main, "_key", "left"), r.join(main, "_key", "left")
    inside = F.coalesce(F.col("_class") == F.col("_main"), F.lit(False))
    return [(l.where(~inside).drop("_main"), r.drop("_main")), (l.where(inside).drop("_main"), r.where(~inside).drop("_main"))]


def _centres(hashes: DataFrame, blocks: list[Block], n: int) -> list[int]:
    """Hashes near the middle of the largest buckets: at most HOT_SHARE of them.

    Per bucket the majority of every bit is taken, then the member nearest to it.
    """
    exact = [Block(b.number, b.shift, b.width, 0) for b in blocks]
    valued = _probes(hashes, exact, "left", "_value")
    big = max(2, len(blocks) * n // HOT_SHARE)  # fewer than HOT_SHARE buckets are larger
    counts = valued.groupBy("_value").agg(
        F.count("*").alias("_n"),
        *[F.expr(f"sum(shiftrightunsigned(hash, {i}) & 1L) as _s{i}") for i in range(BITS)],
    ).where(F.col("_n") > big)
    middle = " | ".join(f"if(_s{i} * 2 > _n, shiftleft(1L, {i}), 0L)" for i in range(BITS))
    middles = stage(counts.selectExpr("_value", f"{middle} as _middle"), "middles")
    nearest = F.min(F.struct(hamming(F.col("hash"), F.col("_middle")).alias("d"), F.col("hash")))["hash"]
    centres = valued.join(F.broadcast(middles), "_value").groupBy("_value").agg(nearest.alias("centre"))
    return sorted(row.centre for row in centres.select("centre").distinct().collect())


def _by_reach(hashes: DataFrame, centres: list[int], threshold: int) -> list[int]:
    """The centres, those with the most hashes within the threshold first."""
    reached = hashes.selectExpr(f"explode({_within('hash', centres, threshold)}) as centre")
    rows = reached.groupBy("centre").agg(F.count("*").alias("n")).collect()  # at most one per centre
    return [row.centre for row in sorted(rows, key=lambda r: (-r.n, r.centre))]


def _within(value: str, centres: list[int], threshold: int) -> str:
    """SQL for the array of the centres within the threshold, in their order."""
    return f"filter({_longs(centres)}, c -> bit_count({value} ^ c) <= {threshold})"
