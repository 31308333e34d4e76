import random
import tracemalloc

import numpy as np
import pytest
from tests.helpers import grouped
from pyspark.sql import functions as F

from twinsift.functions.bits import hamming, hash_hex, similarity_percent
from twinsift.functions import images as images_module
from twinsift.functions.images import _hash_images, dhash, dhash_bgr, dhash_of_pixels
from twinsift.operators import hamming as hm
from twinsift.operators.components import connected_components
from twinsift.operators.near import near_members, near_pairs, similarity_listing, skipped_images


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def hashes_df(spark, values):
    return spark.createDataFrame([(signed(v),) for v in values], "hash bigint")


def pairs_within(values, t):
    s = sorted(signed(v) for v in set(values))
    return {(a, b) for i, a in enumerate(s) for b in s[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= t}


def variants(rng, base, n, flips):
    out = set()
    while len(out) < n:
        v = base
        for _ in range(rng.randint(0, flips)):
            v ^= 1 << rng.randrange(64)
        out.add(v)
    return out


def mixed_hashes(seed, n=150):
    rng = random.Random(seed)
    values = {rng.getrandbits(64) for _ in range(n)}
    for _ in range(6):
        values |= variants(rng, rng.getrandbits(64), 12, 12)
    return values | {0, 2**64 - 1, 1 << 63, 1}


@pytest.mark.parametrize("t", [0, 3, 10, 20])
def test_pairs_equal_brute_force(spark, t):
    values = mixed_hashes(t)
    got = [(r.a, r.b) for r in hm.hamming_pairs(hashes_df(spark, values), t).collect()]
    assert len(got) == len(set(got))
    assert set(got) == pairs_within(values, t)


@pytest.mark.parametrize("n", [1000, 10**5, 10**7, 10**9])
@pytest.mark.parametrize("t", [0, 2, 5, 10, 14, 25, 63])
def test_every_cut_covers_the_threshold(n, t):
    blocks = hm.plan_blocks(n, t)
    if blocks is None:  # tiles, which compare all pairs
        assert n <= 1000 or t > 14
        return
    assert hm._expected_pairs(n, blocks) <= n * n
    assert sum(b.radius + 1 for b in blocks) >= t + 1 or all(b.radius == b.width for b in blocks)
    assert len({b.number for b in blocks}) == len(blocks)
    bits = [i for b in blocks for i in range(b.shift, b.shift + b.width)]
    assert len(bits) == len(set(bits)) and max(bits) < 64
    for block in blocks:
        rest = hm._rest_of(block)
        assert sum(width for _, width in rest) == 64 - block.width
        finer = hm.plan_blocks(2**31, t, rest)
        assert finer is None or all(b.shift + b.width <= block.shift or b.shift >= block.shift + block.width for b in finer)


@pytest.mark.parametrize("blocks_for", [10**6, 10**9])
def test_pairs_with_the_blocks_of_larger_tables(spark, monkeypatch, blocks_for):
    """The cuts chosen for large tables are exact too."""
    values = mixed_hashes(9, 60)
    plan = hm.plan_blocks
    monkeypatch.setattr(hm, "plan_blocks", lambda n, t, regions=None: plan(blocks_for, t, regions))
    got = [(r.a, r.b) for r in hm.hamming_pairs(hashes_df(spark, values), 8).collect()]
    assert len(got) == len(set(got))
    assert set(got) == pairs_within(values, 8)


def dense_hashes():
    """A third of the hashes around one image, many flat ones, and others that share bits with them."""
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    return variants(rng, centre, 90, 7) | variants(rng, 0, 60, 4) | {rng.getrandbits(64) for _ in range(60)} | {
        (centre & 0xFFFF_FFFF_0000_0000) | rng.getrandbits(32) for _ in range(40)
    }


@pytest.mark.parametrize("t, limit, tile", [(7, 1500, 8192), (7, 20, 16), (2, 3, 8192)])
def test_hot_block_values_keep_all_pairs(spark, settings, monkeypatch, t, limit, tile):
    """Also with so low a limit that values are cut several times, and with small tiles at the end."""
    monkeypatch.setattr(hm, "TILE", tile)
    values = dense_hashes()
    with settings(hotPairs=limit, broadcastRows=10_000):
        got = [(r.a, r.b) for r in hm.hamming_pairs(hashes_df(spark, values), t).collect()]
    assert len(got) == len(set(got))
    assert set(got) == pairs_within(values, t)


def union_find(values, pairs):
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return {v: root(v) for v in values}


@pytest.mark.parametrize("t, broadcast", [(5, 0), (10, 200_000)])
def test_linked_pairs_keep_components_with_fewer_pairs(spark, settings, t, broadcast):
    values = dense_hashes()
    s = sorted(signed(v) for v in values)
    table = hashes_df(spark, values).selectExpr("hash", f"{hm.spread_bits('hash')} as _bits")
    with settings(hotPairs=1500, broadcastRows=broadcast):
        linked = {(r.a, r.b) for r in hm.pairs_of(table, len(values), t, linked=True).collect()}
    everything = pairs_within(values, t)
    assert linked <= everything
    assert union_find(s, linked) == union_find(s, everything)
    assert len(linked) < len(everything) / 2


@pytest.mark.parametrize("t", [5, 16, 30])
def test_blocks_and_tiles_agree(spark, monkeypatch, t):
    values = mixed_hashes(t, 40)
    monkeypatch.setattr(hm, "TILE", 30)
    found = {}
    for kind, cost in (("tiles", 0.0), ("blocks", float("inf"))):
        monkeypatch.setattr(hm, "_tiled_cost", lambda n, cost=cost: cost)
        assert (hm.plan_blocks(len(values), t) is None) == (kind == "tiles")
        found[kind] = [(r.a, r.b) for r in hm.hamming_pairs(hashes_df(spark, values), t).collect()]
        assert len(found[kind]) == len(set(found[kind]))
    assert set(found["tiles"]) == set(found["blocks"]) == pairs_within(values, t)


def test_threshold_edges(spark):
    df = hashes_df(spark, [0, 2**64 - 1, 5])
    assert hm.hamming_pairs(df, -1).count() == 0
    with pytest.raises(ValueError):
        hm.hamming_pairs(df, 64)
    assert hm.hamming_pairs(df, 63).count() == len(pairs_within([0, 2**64 - 1, 5], 63))


@pytest.mark.parametrize("limit", [4, 1_000_000])
def test_components_equal_union_find(spark, settings, limit):
    rng = random.Random(11)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)]
    edges += [(1000 + i, 1001 + i) for i in range(20)]  # a path
    edges += [(5000, 5001 + i) for i in range(60)]  # a hub
    edges += [(-7, 3), (-7, -9)]
    edges = [(a, b) for a, b in edges if a != b]
    nodes = {n for e in edges for n in e}
    with settings(hotRows=limit):
        df = spark.createDataFrame(edges, "a bigint, b bigint")
        got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == union_find(nodes, edges)


def test_components_of_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def images_df(spark, rows):
    return spark.createDataFrame([(p, None if h is None else signed(h)) for p, h in rows], "path string, dhash bigint")


@pytest.mark.parametrize("limit", [3, 1_000_000])
def test_near_groups_are_transitive(spark, settings, limit):
    rows = [("/b", 0b0), ("/a", 0b11111), ("/c", 0b1111111111), ("/far", 2**64 - 1), ("/flat2", 0), ("/bad", None)]
    with settings(hotRows=limit):
        members = near_members(images_df(spark, rows), 5)
        assert grouped(members) == {"/a": ["/a", "/b", "/c", "/flat2"]}
        listing = {r.path: (r.is_reference, r.distance, r.similarity) for r in similarity_listing(members).collect()}
    assert listing == {"/a": (True, 0, 100), "/b": (False, 5, 93), "/flat2": (False, 5, 93), "/c": (False, 5, 93)}
    assert [r.path for r in skipped_images(images_df(spark, rows)).collect()] == ["/bad"]


def test_equal_hashes_group_even_below_zero(spark):
    rows = [("/a", 7), ("/b", 7), ("/c", 2**60)]
    assert grouped(near_members(images_df(spark, rows), 0)) == {"/a": ["/a", "/b"]}
    assert grouped(near_members(images_df(spark, rows), 64)) == {"/a": ["/a", "/b", "/c"]}
    assert near_members(images_df(spark, rows[2:]), 64).count() == 0


def test_a_third_of_images_with_one_hash(spark, settings):
    rng = random.Random(2)
    rows = [(f"/i/{i:04d}", 0 if i % 3 == 0 else rng.getrandbits(64)) for i in range(300)]
    plain = sorted(map(tuple, near_members(images_df(spark, rows), 5).collect()))
    assert len(plain) == 100
    with settings(hotRows=20):
        assert sorted(map(tuple, near_members(images_df(spark, rows), 5).collect())) == plain


def test_near_pairs(spark):
    rows = [("/a", 0b1010), ("/b", 0b0101), ("/c", 0b1010)]
    assert [tuple(r) for r in near_pairs(images_df(spark, rows), 4).collect()] == [(5, 10, 4, 94)]


def test_hamming_helpers(spark):
    df = spark.createDataFrame([(0, 0), (10, 5), (-1, 0)], "a bigint, b bigint")
    d = hamming(F.col("a"), F.col("b"))
    assert [tuple(r) for r in df.select(d, similarity_percent(d), hash_hex(F.col("a"))).collect()] == [
        (0, 100, "0" * 16), (4, 94, "000000000000000a"), (64, 0, "f" * 16),
    ]


def gray_image(width, height, pixel):
    return [v for y in range(height) for x in range(width) for v in [pixel(x, y)] * 3]


def known_images():
    def ramp(w, invert=False):
        return lambda x, y: 255 - x * 255 // w if invert else x * 255 // w

    def checker(x, y):
        return 255 if (x // 10) % 2 == (y // 10) % 2 else 0

    noisy = gray_image(100, 100, ramp(100))
    noisy[:30] = [255 - v for v in noisy[:30]]
    return [
        (100, 100, 3, gray_image(100, 100, ramp(100)), "f" * 16),
        (200, 150, 3, gray_image(200, 150, ramp(200)), "f" * 16),
        (100, 100, 3, gray_image(100, 100, ramp(100, True)), "0" * 16),
        (100, 100, 3, gray_image(100, 100, checker), "a54a4aa54aa5a54a"),
        (10, 15, 3, gray_image(10, 15, lambda x, y: 90), "0" * 16),
        (5, 3, 3, gray_image(5, 3, ramp(5)), "a" * 16),
        (100, 100, 3, noisy, "f" * 16),
        (0, 5, 3, [1], "0" * 16),
        (4, 4, 1, [], "0" * 16),
        (4, 4, 1, None, None),
    ]


def test_known_image_hashes(spark):
    rows = [(i, w, h, c, px) for i, (w, h, c, px, _) in enumerate(known_images())]
    df = spark.createDataFrame(rows, "i int, w int, h int, c int, px array<int>")
    small = df.where("w < 20")  # the expression form is checked below on random rasters too
    numpy_form = df.select("i", hash_hex(dhash("w", "h", "c", "px")).alias("x"))
    sql_form = small.select("i", hash_hex(F.expr(dhash_of_pixels("w", "h", "c", "px"))).alias("x"))
    want = {i: x for i, (*_, x) in enumerate(known_images())}
    assert {r.i: r.x for r in numpy_form.collect()} == want
    assert all(want[r.i] == r.x for r in sql_form.collect())


def test_bands_are_as_good_as_the_whole_image(monkeypatch):
    rng = np.random.default_rng(4)
    shapes = [(h, w, c) for h in (1, 3, 8, 37) for w in (1, 5, 9, 40) for c in (1, 2, 3, 4)]
    images = [rng.integers(0, 256, (3, *shape), dtype=np.uint8) for shape in shapes]
    whole = [images_module._stack_hashes(stack, bgr).tolist() for stack in images for bgr in (False, True)]
    monkeypatch.setattr(images_module, "STACK_BYTES", 1)  # a row at a time
    assert [images_module._stack_hashes(stack, bgr).tolist() for stack in images for bgr in (False, True)] == whole


def test_a_large_image_takes_little_beside_itself():
    side = 6000
    pixels = np.random.default_rng(5).integers(0, 256, side * side * 3, dtype=np.uint8).tobytes()  # 108 MB
    tracemalloc.start()
    (found,) = _hash_images([side], [side], [3], [pixels], True)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert found is not None and peak < 60e6


def test_both_forms_agree_on_random_rasters(spark):
    rng = random.Random(8)
    rows = []
    for i in range(60):
        w, h, c = rng.randint(1, 21), rng.randint(1, 19), rng.choice([1, 2, 3, 4])
        rows.append((i, w, h, c, [rng.randrange(256) for _ in range(w * h * c)]))
    df = spark.createDataFrame(rows, "i int, w int, h int, c int, px array<int>")
    both = df.select(dhash("w", "h", "c", "px").alias("a"), F.expr(dhash_of_pixels("w", "h", "c", "px")).alias("b"))
    assert both.where("a <> b or a is null or b is null").count() == 0


def test_binary_data_and_channel_order(spark):
    rng = np.random.default_rng(4)
    rgb = rng.integers(0, 256, (12, 14, 3), dtype=np.uint8)
    rows = [(14, 12, 3, bytearray(rgb.tobytes()), bytearray(rgb[:, :, ::-1].tobytes()))]
    df = spark.createDataFrame(rows, "w int, h int, c int, rgb binary, bgr binary")
    r = df.select(dhash("w", "h", "c", "rgb"), dhash_bgr("w", "h", "c", "bgr")).first()
    assert r[0] == r[1] == _hash_images([14], [12], [3], [rgb.tobytes()], False)[0]
