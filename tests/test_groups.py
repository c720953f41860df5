"""Signatures, radius search, components and group splits against brute force, with hubs and hot groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.functions import kernels
from assay.operators import components as cc
from assay.operators import neardup


def brute_area(g, h, w):
    """Mean over each target area by fine subdivision."""
    fine = np.kron(g, np.ones((h, w)))  # every source cell becomes h x w parts, so borders fall on parts
    return fine.reshape(h, g.shape[0], w, g.shape[1]).mean((1, 3))


@pytest.mark.parametrize("shape", [(8, 8), (32, 32), (50, 33), (7, 64), (1, 3)])
def test_area_resampling(shape):
    g = np.random.default_rng(1).random(shape)
    assert np.allclose(kernels.area_resample(g[None], 32, 32)[0], brute_area(g, 32, 32))


def test_signatures_of_any_grid_and_of_broken_ones(spark):
    rng = np.random.default_rng(2)
    grids = {i: rng.integers(0, 256, (h, w)).astype(float) for i, (h, w) in enumerate([(16, 16), (40, 24), (32, 32), (5, 9)])}
    rows = [(i, g.shape[0], g.shape[1], g.ravel().tolist()) for i, g in grids.items()]
    rows += [(10 + i, g.shape[0], g.shape[1], (g * 0.25 + 3).ravel().tolist()) for i, g in grids.items()]
    rows += [(90, 4, 4, None), (91, 4, 4, [1.0]), (92, 1, 2, [1.0, None]), (93, 2, 2, [5.0] * 4)]
    got = {r.id: r.signature for r in neardup.signatures(spark.createDataFrame(rows, "id long, h int, w int, grid array<double>"), ["id"]).collect()}
    assert set(got) == {0, 1, 2, 3, 10, 11, 12, 13, 93} and got[93] == [0] * 16
    for i, g in grids.items():
        r = brute_area(g, 32, 32)
        text = "".join("1" if v else "0" for v in (np.round(r, 9) > np.round(r.mean(), 9)).ravel())
        assert "".join(f"{w & (2**64 - 1):064b}" for w in got[i]) == text and got[10 + i] == got[i]


def flipped(rng, bits, n):
    out = bits.copy()
    out[rng.choice(1024, n, replace=False)] ^= 1
    return out


def union(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("radius,tile", [(15, 4096), (4, 7), (0, 4096)])
def test_radius_classes_match_comparing_all(spark, radius, tile):
    rng = np.random.default_rng(3)
    bits = [rng.integers(0, 2, 1024).astype(np.uint8) for _ in range(30)]
    flat = np.zeros(1024, np.uint8)
    for _ in range(40):
        bits.append(flipped(rng, bits[rng.integers(0, len(bits))], rng.integers(0, 20)))
        bits.append(flipped(rng, flat, rng.integers(0, 30)))  # nearly flat pictures share most words
    bits += [flat] * 90  # a third of all rows are copies
    m = np.array(bits)
    far = (m[:, None, :] ^ m[None, :, :]).sum(2)
    roots = union(len(m), np.argwhere(far <= radius).tolist())
    rows = [(i, np.packbits(b).view(">i8").astype(np.int64).tolist()) for i, b in enumerate(m)]
    df = spark.createDataFrame(rows, "id long, signature array<bigint>").repartition(4)
    got = {r.id: (r.class_id, r.n_class) for r in neardup.near_classes(df, "id", radius, tile).collect()}
    assert got == {i: (r, roots.count(r)) for i, r in enumerate(roots)}


def test_copies_cost_no_square(spark):
    """Twenty thousand equal pictures are one signature: no link at all is made."""
    same = spark.range(20_000).select("id", F.array(*[F.lit(7 + i).cast("long") for i in range(16)]).alias("signature"))
    other = spark.range(20_000, 20_050).select("id", F.array(*[(F.col("id") * (i + 3)).cast("long") for i in range(16)]).alias("signature"))
    got = neardup.near_classes(same.unionAll(other), "id", 15)
    assert got.where("class_id = 0").agg(F.max("n_class"), F.count(F.lit(1))).first()[:] == (20_000, 20_000)
    distinct = other.unionAll(same.limit(1))
    assert neardup.near_links(distinct, 15).count() < 50


def test_components_with_hubs_chains_and_gaps(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(600):
        hub = "hub" if i % 3 == 0 and i < 300 else None  # a key of many rows
        chain = f"c{i // 2}" if 400 <= i < 500 else ""
        link = f"l{(i + 1) // 2}" if 400 <= i < 500 else None  # with chain: one long path
        rows.append((i, hub, chain, link, f"r{rng.integers(0, 2000)}"))
    keys = ["hub", "chain", "link", "rare"]
    df = spark.createDataFrame(rows, "id long, hub string, chain string, link string, rare string").repartition(5)
    links, first = [], {}
    for r in rows:
        for kind, value in zip(keys, r[1:]):
            if value:
                links.append((first.setdefault((kind, value), r[0]), r[0]))
    want = union(600, links)
    got = {r.id: r.component for r in cc.with_component(df, "id", keys).collect()}
    assert got == dict(enumerate(want)) and max(map(want.count, set(want))) > 100
    assert cc.with_component(df.limit(0), "id", keys).count() == 0


def test_splits_keep_components_whole_and_shares_within_the_bound(spark):
    rng = np.random.default_rng(5)
    sizes = [2000, 700, 300, 60, 50] + [int(x) for x in rng.integers(1, 6, 2000)]
    rows, at = [], 0
    for c, n in enumerate(sizes):
        label = ["ai", "real", None][int(rng.integers(0, 3))]
        rows += [(at + k, c, label if rng.random() < 0.9 else "real") for k in range(n)]
        at += n
    df = spark.createDataFrame(rows, "id long, c int, label string").repartition(4)
    shares = {"train": 0.7, "dev": 0.2, "test": 0.1}
    dealt = cc.split_components(df, "c", shares, F.col("label"))
    got = {r.component: r.split for r in dealt.collect()}
    assert set(got) == set(range(len(sizes))) and dealt.count() == len(sizes)
    assert got == {r.component: r.split for r in cc.split_components(df.repartition(2), "c", shares, F.col("label")).collect()}
    small = max(2, int(at * 0.001))
    for s, share in shares.items():
        assert abs(sum(n for c, n in enumerate(sizes) if got[c] == s) - share * at) <= 2000 + 9 * small
    even = spark.range(3000).select("id", F.col("id").alias("c"), (F.col("id") % 2).cast("string").alias("label"))
    n = {(r.label, r.split): r.n for r in cc.split_components(even, "c", shares, F.col("label")).join(even.withColumnRenamed("c", "component"), "component").groupBy("label", "split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert all(abs(n[(lab, s)] - 1500 * share) <= 2 for lab in "01" for s, share in shares.items())
