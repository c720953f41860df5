"""Fits against closed forms and brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.operators import calibration as c


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(2)
    z = rng.normal(0, 2, 1500)
    y = (rng.random(1500) < 1 / (1 + np.exp(-z / 1.8))).astype(int)
    rows = [(i, int(a), float(1 / (1 + math.exp(-b)))) for i, (a, b) in enumerate(zip(y, z))]
    return spark.createDataFrame(rows, "id long, y int, p double"), y, z


def test_temperature_minimizes_log_loss(scored):
    df, y, z = scored
    t = c.fit_temperature(df)

    def loss(t):
        q = 1 / (1 + np.exp(-z / t))
        return -np.mean(y * np.log(q) + (1 - y) * np.log(1 - q))

    grid = np.linspace(1, 3, 2001)
    assert abs(t - grid[np.argmin([loss(g) for g in grid])]) < 2e-3


def test_isotonic_is_monotone_clipped_and_interpolated(spark):
    rows = [(0.1, 0), (0.2, 1), (0.3, 0), (0.4, 1), (0.4, 1), (0.6, 1)]
    model = c.fit_isotonic(spark.createDataFrame(rows, "p double, y int"))
    probe = spark.createDataFrame([(0.0,), (0.2,), (0.25,), (0.35,), (0.9,)], "p double")
    got = [r["p_cal"] for r in model.transform(probe).collect()]
    assert np.allclose(got, [0.0, 0.5, 0.5, 0.75, 1.0])


def test_calibration_tables(scored):
    df, y, _ = scored
    cv = c.calibration_cv(df).collect()
    assert {r["policy"] for r in cv} == {"identity", "temperature", "isotonic"} and len(cv) == 15
    assert sum(r["n"] for r in cv if r["policy"] == "isotonic") == len(y)
    final = {r["policy"]: r for r in c.calibration_final(df).collect()}
    assert final["isotonic"]["brier"] <= final["temperature"]["brier"] <= final["identity"]["brier"]
    assert not final["identity"]["small_sample"]


def blobs(spark, n=300, d=3):
    rng = np.random.default_rng(8)
    y = rng.integers(0, 2, n)
    x = rng.normal(0, [1, 5, 0.1], (n, d)) + y[:, None] * [1.0, 2.0, 0.05]
    rows = [(i, int(a), b.tolist()) for i, (a, b) in enumerate(zip(y, x))]
    return spark.createDataFrame(rows, "id long, y int, features array<double>"), x, y


def newton(x, y, reg):
    """L2 logistic fit with an unpenalized intercept."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w, pen = np.zeros(a.shape[1]), np.diag([reg] * x.shape[1] + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + pen, a.T @ (p - y) + pen @ w)
    return w


def test_logistic_matches_newton(spark):
    df, x, y = blobs(spark)
    weights, b = c.fit_logistic(df)
    assert np.allclose([*weights, b], newton(x, y, 1.0), atol=2e-3)


def test_baseline_exports_a_population_standardized_model(spark):
    df, x, y = blobs(spark)
    m = c.fit_logistic_baseline(df, ["a", "b", "c"]).first()
    assert np.allclose(m["mean"], x.mean(0)) and np.allclose(m["scale"], x.std(0))
    z = (x - x.mean(0)) / x.std(0)
    assert np.allclose([*m["coef"], m["intercept"]], newton(z, y, 1.0), atol=2e-3)
    assert 0.5 < m["train_auroc"] <= 1


def test_groups_never_cross_folds(spark):
    df, _, _ = blobs(spark)
    rows = df.withColumn("grp", F.floor(F.col("id") / 3)).withColumn("family", F.concat(F.lit("f"), F.col("id") % 3))
    oof = c.grouped_cv(rows, "grp")
    assert oof.count() == 300 and oof.where("p is null").count() == 0
    assert oof.groupBy("grp").agg(F.count_distinct("fold").alias("k")).where("k > 1").count() == 0
    out = {r["family"]: r for r in c.leave_one_family_out(rows, "family", ["f1", "f2"], 0.5).collect()}
    assert set(out) == {"f1", "f2"} and all(r["n"] == 100 and 0 <= r["recall"] <= 1 for r in out.values())


def test_meta_uses_the_whole_vector(spark):
    df, _, _ = blobs(spark)
    rows = df.withColumn("first", F.element_at("features", 3)).withColumn("g", F.lit("all"))
    out, weights, _ = c.meta_classifier(rows, rows, "features", "first", ["g"])
    r = out.first()
    assert len(weights) == 3 and r["auroc_meta"] > r["auroc_clean"]
