"""Grid kernels through Spark against loop or closed-form references; mixed sizes in one table."""

import colorsys
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.functions import kernels as k
from assay.operators import grids as g

RNG = np.random.default_rng(11)
SHAPES = [(16, 16), (24, 16), (40, 32), (16, 16), (64, 64)]
GRIDS = [RNG.integers(0, 256, s).astype(float) for s in SHAPES] + [np.full((16, 16), 7.0)]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, int(a.shape[0]), int(a.shape[1]), a.ravel().tolist()) for i, a in enumerate(GRIDS)]
    df = spark.createDataFrame(rows, "id int, h int, w int, grid array<double>")
    return df.withColumns({c: df.grid for c in ("red", "green", "blue")})


def features(table, names, **opt):
    rows = g.grid_features(table, names, ["id"], **opt).orderBy("id").collect()
    return {n: [r[n] for r in rows] for n in names}


def reflect(i, n):
    return -i - 1 if i < 0 else 2 * n - 1 - i if i >= n else i


def sobel_loop(a):
    h, w = a.shape
    out = []
    for r in range(h):
        for c in range(w):
            px = lambda y, x: a[reflect(y, h), reflect(x, w)]
            gx = sum(m * (px(r + d, c + 1) - px(r + d, c - 1)) for d, m in ((-1, 1), (0, 2), (1, 1)))
            gy = sum(m * (px(r + 1, c + d) - px(r - 1, c + d)) for d, m in ((-1, 1), (0, 2), (1, 1)))
            out.append(math.hypot(gx, gy))
    return np.array(out)


def test_gradient(table):
    got = features(table, ["grad_mean", "sharp_edges"])
    for i, a in enumerate(GRIDS):
        m = sobel_loop(a)
        assert abs(got["grad_mean"][i] - m.mean()) < 1e-9 and got["sharp_edges"][i] == (m > 60).mean()


def test_flat_grid_is_flat(table):
    got = features(table, ["flatness", "noise_sigma", "grain", "unique_colors", "colorfulness", "sat_mean"])
    assert got["flatness"][5] == 1.0 and abs(got["noise_sigma"][5]) < 1e-9 and got["grain"][5] == 0.0
    assert got["unique_colors"][5] == 1 / 256 and got["colorfulness"][5] == 0.0 and got["sat_mean"] == [0.0] * 6


def test_block_phase_follows_the_block_definition(table):
    got = features(table, ["blockiness_phase"])["blockiness_phase"]
    for i, a in enumerate(GRIDS):
        vals = []
        for oy in range(8):
            for ox in range(8):
                s = a[oy:, ox:]
                s = s[: s.shape[0] // 8 * 8, : s.shape[1] // 8 * 8]
                b = s.reshape(s.shape[0] // 8, 8, s.shape[1] // 8, 8)
                dv, dh = np.abs(np.diff(b, axis=3)), np.abs(np.diff(b, axis=1))
                edge = (dv[..., 6].mean() + dh[:, 6].mean()) / 2
                vals.append(edge - (dv[..., :6].mean() + dh[:, :6].mean()) / 2)
        assert abs(got[i] - np.mean(vals)) < 1e-9


def test_small_grids_have_no_phase(spark):
    df = spark.createDataFrame([(1, 8, 8, [0.0] * 64)], "id int, h int, w int, grid array<double>")
    assert math.isnan(features(df, ["blockiness_phase"])["blockiness_phase"][0])


def test_noise_sigma_by_loops(table):
    got = features(table, ["noise_sigma"])["noise_sigma"]
    weights = np.array(k.gaussian_weights(1.0))
    for i, a in enumerate(GRIDS[:3]):
        h, w = a.shape
        rows = np.array([[sum(weights[d + 4] * a[r, reflect(c + d, w)] for d in range(-4, 5)) for c in range(w)] for r in range(h)])
        soft = np.array([[sum(weights[d + 4] * rows[reflect(r + d, h), c] for d in range(-4, 5)) for c in range(w)] for r in range(h)])
        res, th, tw = a - soft, h // 8, w // 8
        var = sorted(res[y * th : (y + 1) * th, x * tw : (x + 1) * tw].var() for y in range(8) for x in range(8))
        assert abs(got[i] - math.sqrt(np.mean(var[:6]))) < 1e-9


def test_hf_ratio_at_its_own_bands(table):
    got = features(table, ["hf_ratio"], low=(1, 16), high=(20, 30))["hf_ratio"]
    a = GRIDS[4]
    win = np.hanning(64)[:, None] * np.hanning(64)[None, :]
    ps = np.abs(np.fft.fftshift(np.fft.fft2((a - a.mean()) * win))) ** 2
    yy, xx = np.mgrid[-32:32, -32:32]
    ring = np.sqrt(xx**2 + yy**2).astype(int)
    radial = np.array([ps[ring == d].mean() for d in range(1, 46)])
    assert abs(got[4] - radial[20:30].mean() / (radial[1:16].mean() + 1e-9)) < 1e-9
    assert math.isnan(got[0])


def test_quality_lowers_the_loss(table):
    got = features(table, ["roundtrip_q55", "roundtrip_q75", "roundtrip_q95"])
    for i in range(5):
        assert got["roundtrip_q55"][i] > got["roundtrip_q75"][i] > got["roundtrip_q95"][i] > 0
    basis = k.dct_matrix()
    assert np.allclose(basis @ basis.T, np.eye(8))
    assert k.scaled_table(50) == list(k.LUMA_TABLE) and set(k.scaled_table(100)) == {1}


def test_runs_and_blocks_differ_only_beyond_one_block_column(table):
    got = features(table, ["block", "block_runs"])
    assert got["block"][0] != got["block_runs"][0]
    one = np.random.default_rng(1).random((1, 16, 8))
    assert np.allclose(k.hard_signals(one)[1], k.hard_signals(one, spatial=False)[1])


def test_color_stats_shape_and_histograms(table):
    for r in g.color_stats(table, ["id"]).collect():
        v = np.array(r["stats"])
        assert v.shape == (97,)
        assert np.allclose([v[9:17].sum(), v[17:25].sum(), v[25:33].sum(), v[33:].sum()], 1)
        assert abs(v[0] - GRIDS[r["id"]].mean()) < 1e-9


def test_views_keep_size_and_scale(table):
    for r in g.view(table, ["id"], "highpass").collect():
        v = np.array(r["grid"])
        assert len(v) == GRIDS[r["id"]].size and np.abs(v).max() <= 1
    low = {r["id"]: np.array(r["grid"]) for r in g.view(table, ["id"], "lowpass").collect()}
    # far from the border a constant stays constant
    assert np.allclose(k.lowpass(np.full((1, 40, 40), 3.0))[0, 10:30, 10:30], 3.0) and len(low) == 6


def test_any_side_and_unsound_planes(spark):
    """Sides are cut to whole blocks; rows with a missing, short or holed plane are left out instead of ending the job."""
    rng = np.random.default_rng(3)
    made = [(i, h, w, rng.uniform(0, 255, h * w).tolist()) for i, (h, w) in enumerate([(12, 12), (8, 8), (17, 30), (7, 40)])]
    made += [(90, 8, 8, None), (91, 8, 8, [1.0] * 63), (92, 8, 8, [None] + [1.0] * 63)]
    df = spark.createDataFrame(made, "id int, h int, w int, grid array<double>")
    got = features(df, ["ela_q90", "roundtrip_q55"])["ela_q90"]
    assert len(got) == 4 and math.isnan(got[3])
    cut = np.array(made[0][3]).reshape(12, 12)[:8, :8]
    assert abs(got[0] - k.block_loss(cut[None], 90)[0]) < 1e-9
    colour = df.withColumns({"red": F.col("grid"), "green": F.reverse("grid"), "blue": F.when(F.col("id") != 1, F.col("grid"))})
    assert {r["id"] for r in g.color_stats(colour, ["id"]).collect()} == {0, 2, 3}


def test_color_stats_by_loops():
    """Hue, saturation and moments of single cells from the textbook definitions."""
    rng = np.random.default_rng(5)
    rgb = rng.integers(0, 256, (3, 2, 6, 7)).astype(float)
    hue, sat = k.hue_saturation(rgb)
    for n in range(2):
        for y in range(6):
            for x in range(7):
                want = colorsys.rgb_to_hsv(*(rgb[:, n, y, x] / 255))
                assert abs(hue[n, y, x] - want[0]) < 1e-6 and abs(sat[n, y, x] - want[1]) < 1e-6
    stats = k.color_stats(rgb)
    flat = rgb[1, 1].ravel()
    assert abs(stats[1, 1] - flat.mean()) < 1e-9 and abs(stats[1, 4] - flat.std(ddof=1)) < 1e-9
    assert np.allclose(stats[:, 9:17].sum(1), 1) and stats.shape == (2, 97)
    assert np.isfinite(k.color_stats(np.full((3, 1, 1, 1), 9.0))).all()


def test_hash_noise_is_standard_normal():
    z = k.normal_noise(np.arange(50) * 77, 4000, 3)
    assert abs(z.mean()) < 0.01 and abs(z.std() - 1) < 0.01
    assert abs(np.corrcoef(z[0], z[1])[0, 1]) < 0.06
    assert np.array_equal(z[7], k.normal_noise(np.array([7 * 77]), 4000, 3)[0])


def test_crops(table):
    for r in g.crop_grid(table, 9).collect():
        a = GRIDS[r["id"]]
        h, w = a.shape
        top = {"top_left": 0, "top_right": 0, "bottom_left": h - 9, "bottom_right": h - 9, "centre": (h - 9) // 2}[r["crop"]]
        left = {"top_left": 0, "bottom_left": 0, "top_right": w - 9, "bottom_right": w - 9, "centre": (w - 9) // 2}[r["crop"]]
        assert np.array_equal(np.array(r["grid"]).reshape(9, 9), a[top : top + 9, left : left + 9])


def test_vector_order_and_extra_columns(table):
    from pyspark.sql import functions as F

    names = list(g.FEATURE_NAMES)
    df = g.feature_vector(table.withColumn("exif_present", F.lit(1.0)), names, ["id"], ["exif_present"])
    assert df.schema["features"].metadata["feature_names"] == names
    row = df.where("id = 2").first()["features"]
    single = features(table, names[:-1])
    assert row == [single[n][2] for n in names[:-1]] + [1.0]


@pytest.mark.parametrize("name", ["feat_blockiness_phase", "feat_hf_ratio", "feat_noise_sigma", "feat_blockiness_ratio", "feat_hard_signals", "near_dup_grids"])
def test_wide_grids_with_absent_bands_match_their_sql(spark, tmp_path, name):
    import __spark_entry__ as entry
    from tests.oracle import compare, connect

    # two whole grids, then ones with holes: each set of bands that can be there
    ids = [i for g in range(17) for i in range(4 * g, 4 * g + 4) if g < 2 or (g - 1) >> i % 4 & 1]
    rows = [(i, [float(v) for v in RNG.normal(size=64).clip(-1, 1)], i % 10) for i in ids]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/part")
    next((tmp_path / "part").glob("*.parquet")).rename(tmp_path / "embeddings.parquet")
    ok, note = compare(spark, connect(str(tmp_path)), name, entry.queries()[name], entry.oracle_sql()[name], str(tmp_path))
    assert ok, note
