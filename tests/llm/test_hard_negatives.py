"""Hard negatives against scoring every row, on ties, repeated rows, odd vectors and skewed labels."""

import math
import random

import numpy as np

from assay.llm.hard_negatives import SortedLists, first_in, hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, row long, block string, id int"


def brute(rows, every=100, scale=256, k=5, m=10, low=30, high=90):
    whole = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    kept = [(n, i, [math.floor(int(x) * scale if x == int(x) else x * scale) for x in np.array(v, np.float32).astype(float).tolist()], lab) for n, (i, v, lab) in enumerate(rows) if i is not None and lab is not None and whole(v)]
    out = []
    for n, i, v, lab in kept:
        if i % every:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, other) for r, j, w, other in kept if r != n]
        for p, pid, _ in sorted((s for s in scored if s[2] == lab), key=lambda s: (-s[0], s[1]))[:k]:
            negatives = sorted((s for s in scored if s[2] != lab and low * p <= 100 * s[0] <= high * p), key=lambda s: (-s[0], s[1]))[:m]
            out += [(i, pid, rank, j, p, s) for rank, (s, j, _) in enumerate(negatives, 1)]
    return sorted(out)


def found(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, lab, 1, "b", 2) for i, v, lab in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in hard_negatives(df, **kw).collect())


def vectors(seed, n, dim=6, labels=3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(dim)] for _ in range(labels)]
    return [(i, [c + rng.gauss(0.1, 0.25) for c in centres[lab]], lab) for i in range(n) for lab in [rng.choice([0] * 3 + list(range(labels)))]]


def test_matches_scoring_every_row_whatever_the_blocks(spark):
    rows = vectors(1, 300)
    want = brute(rows, every=10)
    assert len(want) > 200
    for block, part in ((16384, 1024), (17, 3)):
        assert found(spark, rows, every=10, block_rows=block, anchor_rows=part) == want


def test_ties_copies_and_rows_that_take_no_part(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-0.25, 0.0, 0.25]) for _ in range(3)], i % 3) for i in range(120)]  # few values: ties everywhere
    rows += [(i, [0.25, 0.25, 0.25], 1) for i in range(200, 260)]  # one common vector
    rows += [(20, [0.25, 0.0, 0.25], 0)] * 2 + [(20, [0.1, 0.2, 0.3], 1), (30, [0.5], 2), (31, [], 2), (40, [0.1] * 5, 0)]
    rows += [(None, [1.0, 1.0, 1.0], 0), (50, None, 0), (60, [1.0, None, 0.0], 1), (70, [float("nan"), 0.0, 0.0], 1), (80, [float("inf"), 0.0, 0.0], 1), (90, [1.0, 1.0, 1.0], None)]
    want = brute(rows, every=10)
    assert want
    assert found(spark, rows, every=10, block_rows=40, anchor_rows=4) == want


def test_huge_components_stay_exact(spark):
    rows = [(i, [float(1 << 20) * (1 + i % 5), -3.0 * i, 0.5], i % 2) for i in range(30)]
    assert found(spark, rows, every=10) == brute(rows, every=10) != []


def test_empty_table_and_no_anchor(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0], 0), (2, [1.0], 0), (3, [0.5], 1)]) == []


def test_descent_stops_early_and_bounds_what_is_left():
    rng = np.random.default_rng(3)
    rows = np.floor(rng.normal(0, 20, (5000, 4)))
    lists, anchor = SortedLists(rows), np.array([9.0, -4.0, 0.0, 1.0])
    met = np.zeros(0, int)
    for new, scores, bound in lists.descend(anchor):
        met = np.concatenate([met, new])
        assert np.array_equal(scores, rows[new] @ anchor)
        left = np.setdiff1d(np.arange(5000), met)
        assert bound is None or (rows[left] @ anchor).max() <= bound
        if bound is not None and np.sort(rows[met] @ anchor)[-5] > bound:
            break
    assert len(met) < 2500
    best = first_in(lists, anchor, np.ones(5000, bool), np.arange(5000), [(None, None)], 5)[0]
    assert [s for _, s in best] == sorted((rows @ anchor).astype(int).tolist())[:-6:-1]
