"""Distributed pooling against pooling in one list, for many shapes, ranges and fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.operators import calibration, isotonic


def pav(n, s):
    """Blocks (first, last, n, s) of cells in the order of scores."""
    out = []
    for i, (a, b) in enumerate(zip(n, s)):
        block = [i, i, int(a), int(b)]
        while out and out[-1][3] * block[2] >= block[3] * out[-1][2]:
            last = out.pop()
            block = [last[0], i, last[2] + block[2], last[3] + block[3]]
        out.append(block)
    return out


SHAPES = {
    "rising": lambda rng, z: (rng.random(len(z)) < z).astype(int),
    "falling": lambda rng, z: (rng.random(len(z)) < 1 - z).astype(int),
    "steps": lambda rng, z: (np.floor(z * 8) % 2).astype(int),
    "perfect": lambda rng, z: (z > 0.5).astype(int),
    "ones": lambda rng, z: np.ones(len(z), int),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_pooling_over_ranges_is_pooling_in_one_list(spark, shape):
    rng = np.random.default_rng(5)
    z = np.sort(rng.random(900))
    n = rng.integers(1, 5, 900)
    s = np.minimum(n, SHAPES[shape](rng, z) * n)
    cells = [(k, float(p), int(a), int(b)) for k in (0, 3) for p, a, b in list(zip(z, n, s))[k * 40 :]]
    blocks = isotonic.pool(spark.createDataFrame(cells, "fit int, p double, n long, s long").repartition(3), cap=37)
    got = sorted((r.fit, r.lo, r.hi, r.n, r.s) for r in blocks.collect())
    want = [(k, z[k * 40 + a], z[k * 40 + b], c, d) for k in (0, 3) for a, b, c, d in pav(n[k * 40 :], s[k * 40 :])]
    assert got == want


def test_a_million_distinct_scores(spark):
    n = 1_000_000
    rows = spark.range(n).select(((F.col("id") + 0.5) / n).alias("p"), F.lit(0).alias("fit"), F.lit(1).cast("long").alias("n"))
    risk = F.col("p") * F.col("p")
    rows = rows.withColumn("s", (F.rand(3) < risk).cast("long"))
    kept = rows.repartition(16).persist()
    try:
        blocks = isotonic.pool(kept)
        got = sorted((r.lo, r.n, r.s) for r in blocks.collect())
        table = kept.toPandas().sort_values("p")
    finally:
        kept.unpersist()
    want = [(table.p.iat[a], c, d) for a, _, c, d in pav(table.n.tolist(), table.s.tolist())]
    assert got == want and len(got) < 2000


def test_interpolation_matches_numpy_and_clips(spark):
    rng = np.random.default_rng(9)
    x = np.unique(np.round(rng.random(40), 3))
    v = np.sort(rng.random(len(x)))
    knots = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, v)], "fit int, boundary double, prediction double")
    asked = np.unique(np.concatenate([rng.random(500), x, [0.0, 1.0]]))
    points = spark.createDataFrame([(1, float(a)) for a in asked], "fit int, p double")
    got = {r.p: r.p_cal for r in isotonic.interpolate(points, knots).collect()}
    assert len(got) == len(asked) and np.allclose([got[float(a)] for a in asked], np.interp(asked, x, v))


def test_cells_of_folds_and_rows_without_score_or_class(spark):
    rows = [(i, i % 2, (i % 7) / 7) for i in range(50)] + [(90, None, 0.5), (91, 1, None)]
    df = spark.createDataFrame(rows, "id long, y int, p double")
    held, train = isotonic.training_cells(df, 3, F.pmod(F.col("id"), F.lit(3)).cast("int"))
    assert held.agg(F.sum("n")).first()[0] == 50
    got = {(r.fit, round(r.p, 9)): (r.n, r.s) for r in train.collect()}
    for fit in range(4):
        for c in range(7):
            mine = [y for i, y, p in rows[:50] if i % 7 == c and i % 3 != fit]
            assert got[(fit, round(c / 7, 9))] == (len(mine), sum(mine))


def test_holes_change_no_fit(spark):
    rows = [(i, int((i * 37 % 100) / 100 > 0.4) if i % 9 else 1, (i * 37 % 100) / 100) for i in range(200)]
    holed = rows + [(500 + i, None, i / 40) for i in range(40)] + [(600 + i, 1, None) for i in range(40)]
    a, b = (spark.createDataFrame(r, "id long, y int, p double") for r in (rows, holed))
    assert calibration.fit_temperature(a) == pytest.approx(calibration.fit_temperature(b), rel=1e-9)
    one, two = (sorted(map(tuple, calibration.calibration_final(d).collect())) for d in (a, b))
    assert [r[0] for r in one] == [r[0] for r in two] and np.allclose([r[1:4] for r in one], [r[1:4] for r in two])
    knots = [sorted(map(tuple, calibration.fit_isotonic(d).knots.collect())) for d in (a, b)]
    assert knots[0] == knots[1]


def test_temperature_of_separable_and_of_useless_scores(spark):
    split = spark.createDataFrame([(i, int(p > 0.5), p) for i, p in enumerate((0.1, 0.2, 0.8, 0.9))], "id long, y int, p double")
    wrong = spark.createDataFrame([(i, int(p < 0.5), p) for i, p in enumerate((0.1, 0.2, 0.8, 0.9))], "id long, y int, p double")
    assert calibration.fit_temperature(split) < 0.1
    assert calibration.fit_temperature(wrong) == float("inf")
    assert calibration.fit_temperature(split.limit(0)) == 1.0


def test_a_crowded_bucket_is_interpolated_in_one_run(spark):
    """No window frame ends at the last row, which would cost the square of a bucket; values are numpy's."""
    import numpy as np

    from assay.operators.isotonic import interpolate

    x = np.linspace(0.3, 0.301, 300)
    y = np.sort(np.random.default_rng(3).random(300))
    p = np.round(np.random.default_rng(4).uniform(0.2, 0.4, 3000), 7)
    p[:2000] = np.round(np.random.default_rng(5).uniform(0.2999, 0.3011, 2000), 8)
    p = np.unique(np.concatenate([p, x[:50]]))
    knots = spark.createDataFrame([(0, float(a), float(b)) for a, b in zip(x, y)], "fit int, boundary double, prediction double")
    out = interpolate(spark.createDataFrame([(0, float(v)) for v in p], "fit int, p double"), knots)
    assert "unboundedfollowing" not in out._jdf.queryExecution().executedPlan().toString()
    got = dict((r.p, r.p_cal) for r in out.collect())
    assert len(got) == len(p) and max(abs(got[v] - w) for v, w in zip(p.tolist(), np.interp(p, x, y))) < 1e-9
