"""Metrics against numpy on tables with ties, single classes and edge scores."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.operators import bootstrap, metrics, ranks, reports, sampling
from assay.operators.common import group_key

EDGE = [0.0, 0.3, 0.35, 0.65, 1.0]


def frame(spark, groups):
    rows = [(g, i, int(y), float(p)) for g, pairs in groups.items() for i, (y, p) in enumerate(pairs)]
    return spark.createDataFrame(rows, "g string, id long, y int, p double")


def groups():
    rng = np.random.default_rng(3)
    n = 400
    saturated = np.where(rng.random(n) < 0.4, 1.0, np.round(rng.random(n), 3))
    return {
        "smooth": list(zip(rng.integers(0, 2, n), rng.random(n))),
        "hot tie": list(zip(rng.integers(0, 2, n), saturated)),
        "all tied": [(i % 2, 0.65) for i in range(30)],
        "edges": [(i % 2, EDGE[i % 5]) for i in range(25)],
        "tiny": [(1, 0.9), (0, 0.7), (1, 0.2)] * 3,
        "ten": [(1, 0.9), (0, 0.7)] * 5,
        "only ai": [(1, 0.7)] * 12,
        "only real": [(0, 0.2)] * 12,
        "near one": list(zip(rng.integers(0, 2, 50), 1 - rng.random(50) * 1e-9)),
    }


def reference(pairs):
    """Formulas recomputed with numpy, ties ordered by md5 of the id."""
    y, p = np.array([a for a, _ in pairs], float), np.array([b for _, b in pairs], float)
    tie = np.array([hashlib.md5(str(i).encode()).hexdigest() for i in range(len(y))])
    up, down = np.lexsort((tie, p)), np.lexsort((tie, -p))
    n_pos, n_neg = (y == 1).sum(), (y == 0).sum()
    hit = p >= 0.65
    out = {"n": len(y), "tp": (hit & (y == 1)).sum(), "fp": (hit & (y == 0)).sum()}
    out["ai_recall"] = out["tp"] / max(1, n_pos)
    out["real_recall"] = (~hit & (y == 0)).sum() / max(1, n_neg)
    out["brier"] = np.mean((p - y) ** 2)
    bins = np.clip(np.digitize(p, np.linspace(0, 1, 11)) - 1, 0, 9)
    gaps = [abs(p[bins == b].sum() - y[bins == b].sum()) for b in range(10)]
    out["ece10"] = sum(gaps) / len(y) if len(y) >= 10 else 0.0
    out["auroc"] = out["auprc"] = out["avg"] = out["balanced_accuracy"] = None
    cuts = dict.fromkeys(metrics.FPR_TARGETS)
    if n_pos and n_neg:
        out["balanced_accuracy"] = (out["ai_recall"] + out["real_recall"]) / 2
        rank = np.arange(1, len(y) + 1)
        out["auroc"] = (rank[y[up] == 1].sum() - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg)
        ys = y[down]
        out["auprc"] = (np.cumsum(ys) / rank)[ys == 1].sum() / n_pos
        wins = (p[y == 1][:, None] > p[y == 0]).sum() + 0.5 * (p[y == 1][:, None] == p[y == 0]).sum()
        out["avg"] = wins / (n_pos * n_neg)
        real = np.sort(p[y == 0])
        for t in cuts:
            cut = real[max(0, int(np.ceil((1 - t) * len(real))) - 1)]
            cuts[t] = ((p >= cut) & (y == 1)).sum() / n_pos
    return out, cuts


def same(a, b):
    return (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9)


def test_full_record_matches_numpy(spark):
    data = groups()
    df = frame(spark, data)
    full = {r["g"]: r for r in metrics.metrics_full(df, ["g"]).collect()}
    cells = {r["g"]: r for r in metrics.cell_metrics(df, ["g"]).collect()}
    assert set(full) == set(data)
    for g, pairs in data.items():
        want, cuts = reference(pairs)
        for k in ("n", "tp", "fp", "ai_recall", "real_recall", "balanced_accuracy", "brier", "ece10", "auroc", "auprc"):
            assert same(full[g][k], want[k]), (g, k)
        for k in ("n", "tp", "balanced_accuracy", "brier", "ece10"):
            assert same(cells[g][k], want[k]), (g, k)
        assert same(cells[g]["auroc_avg_rank"], want["avg"]), g
        for t, v in cuts.items():
            name = "ai_recall_at_fpr_" + str(t).replace(".", "_")
            assert same(full[g][name], v) and same(cells[g][name], v), (g, t)


def test_single_class_reads_zero_recall_and_null_balance(spark):
    r = metrics.rates(frame(spark, {"real": [(0, 0.9), (0, 0.1)]}), ["g"]).first()
    assert (r["ai_recall"], r["real_recall"], r["false_ai_rate"], r["balanced_accuracy"]) == (0.0, 0.5, 0.5, None)


def test_empty_input_gives_no_groups(spark):
    df = frame(spark, {"x": [(1, 0.5)]}).where("p > 1")
    assert metrics.metrics_full(df, ["g"]).count() == 0
    assert metrics.ece10(df, ["g"]).count() == 0


def test_edge_scores_fall_in_numpy_bins(spark):
    df = spark.createDataFrame([(p,) for p in EDGE + [0.1, 0.6, 0.7]], "p double")
    got = {r["p"]: r["b"] for r in df.select("p", metrics.ece_bin(F.col("p")).alias("b")).collect()}
    for p, b in got.items():
        assert b == np.clip(np.digitize(p, np.linspace(0, 1, 11)) - 1, 0, 9)
    assert got[0.3] == 2 and got[1.0] == 9


@pytest.mark.parametrize("n", [50, 200, 1000])
def test_recall_cut_at_float_sensitive_sizes(spark, n):
    rng = np.random.default_rng(n)
    pairs = list(zip([0] * n + [1] * n, rng.random(2 * n)))
    _, cuts = reference(pairs)
    row = metrics.recall_at_fpr(frame(spark, {"g": pairs}), ["g"]).first()
    for t, v in cuts.items():
        assert same(row["ai_recall_at_fpr_" + str(t).replace(".", "_")], v)


def test_ranks_do_not_depend_on_partitioning_or_order(spark):
    df = frame(spark, {"hot": groups()["hot tie"]})
    a = ranks.ordinal_ranks(df.repartition(7), ["g"]).orderBy("id").collect()
    b = ranks.ordinal_ranks(df.orderBy(F.desc("p")).coalesce(1), ["g"]).orderBy("id").collect()
    assert a == b
    assert sorted(r["rank_asc"] for r in a) == list(range(1, 401))
    assert sorted(r["rank_desc"] for r in a) == list(range(1, 401))


def test_auroc_is_invariant_under_monotone_maps(spark):
    df = frame(spark, {"g": groups()["smooth"]})
    a = metrics.auroc_avg_rank(df, ["g"]).first()["auroc"]
    b = metrics.auroc_avg_rank(df.withColumn("p", F.pow("p", 5)), ["g"]).first()["auroc"]
    assert same(a, b)


def test_auroc_agrees_with_the_ml_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    df = frame(spark, {"g": groups()["hot tie"]}).withColumn("label", F.col("y").cast("double"))
    ev = BinaryClassificationEvaluator(rawPredictionCol="p", numBins=0)
    assert abs(ev.evaluate(df) - metrics.auroc_avg_rank(df, ["g"]).first()["auroc"]) < 1e-9


def test_buckets_are_monotone(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.random(500), 10.0 ** -rng.uniform(0, 30, 200), 1 - 10.0 ** -rng.uniform(0, 15, 200), EDGE])
    df = spark.createDataFrame([(float(v), float(-v * 1e6)) for v in values], "p double, v double")
    rows = df.select("p", "v", ranks.score_bucket(F.col("p")).alias("a"), ranks.value_bucket(F.col("v")).alias("b")).collect()
    for col, bucket in (("p", "a"), ("v", "b")):
        ordered = sorted(rows, key=lambda r: r[col])
        assert all(x[bucket] <= y[bucket] for x, y in zip(ordered, ordered[1:]))


def test_latency_percentiles_pick_order_statistics(spark):
    rng = np.random.default_rng(5)
    data = {g: np.round(rng.normal(0, 50, n), 1) for g, n in (("a", 1), ("b", 2), ("c", 21), ("d", 400))}
    rows = [(g, float(v)) for g, vs in data.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, latency_ms double")
    for r in reports.latency_percentiles(df, ["g"]).collect():
        s = np.sort(data[r["g"]])
        n = len(s)
        assert (r["n"], r["p50"], r["p95"], r["max"]) == (n, s[n // 2], s[min(n - 1, int(n * 0.95))], s[-1])


def test_bootstrap_is_centred_and_covers(spark):
    data = {"g": groups()["smooth"]}
    df = frame(spark, data)
    ci = {r["metric"]: r for r in bootstrap.bootstrap_ci(df, ["g"], replicas=300).collect()}
    want, _ = reference(data["g"])
    for k in ("balanced_accuracy", "ai_recall", "brier"):
        assert abs(ci[k]["mean"] - want[k]) < 0.01
        assert ci[k]["lo"] < want[k] < ci[k]["hi"]
    y = np.array([a for a, _ in data["g"]])
    hit = np.array([b for _, b in data["g"]]) >= 0.65
    se = np.sqrt(want["ai_recall"] * (1 - want["ai_recall"]) / (y == 1).sum())
    assert 2.5 * se < ci["ai_recall"]["hi"] - ci["ai_recall"]["lo"] < 5.5 * se
    assert hit.any()


def test_bootstrap_weights_follow_poisson_at_every_size():
    """One rule for all cells: mean and variance are the cell's size, and the distribution stays within the stated error."""
    base = np.arange(400, dtype=np.int64) * 7919
    for n in (1, 64, 65, 10**6):
        w = bootstrap.poisson_weights(np.full(400, n), base, np.arange(500), 0).ravel()
        assert abs(w.mean() - n) < 5 * np.sqrt(n / w.size) + 0.006 and 0.9 * n < w.var() < 1.1 * n
    ones = bootstrap.poisson_weights(np.ones(400), base, np.arange(500), 0).ravel()
    cdf = np.cumsum([np.exp(-1.0) / float(np.prod(range(1, k + 1))) for k in range(5)])
    assert max(abs((ones <= k).mean() - cdf[k]) for k in range(5)) < 0.015
    assert not bootstrap.poisson_weights(np.zeros(3), base[:3], np.arange(9), 1).any()


def test_bootstrap_ranges_have_equal_depth_and_do_not_change_the_figures(spark, monkeypatch):
    """One suite has most rows, all of their scores distinct and within a hair of 0.98."""
    n = 30_000
    hot = spark.range(n).select(F.lit("hot").alias("g"), (F.col("id") % 3 == 0).cast("int").alias("y"), (0.98 + F.col("id") / 1e7).alias("p"))
    few = spark.range(40).select(F.lit("few").alias("g"), (F.col("id") % 2).cast("int").alias("y"), (F.col("id") / 40).alias("p"))
    df = hot.unionAll(few).withColumn("id", F.monotonically_increasing_id())
    cells = ranks.score_cells(df, ["g"]).select(group_key(["g"]), "p")
    monkeypatch.setattr(bootstrap, "RANGE_CELLS", 1000)
    sizes = {(r["_g"]["g"], r["_b"]): r for r in bootstrap.score_ranges(cells).groupBy("_g", "_b").agg(F.count("*").alias("k"), F.min("p").alias("lo"), F.max("p").alias("hi")).collect()}
    assert sizes["few", 0]["k"] == 40
    of_hot = sorted((b, r) for (g, b), r in sizes.items() if g == "hot")
    assert sum(r["k"] for _, r in of_hot) == n and len(of_hot) > 20 and max(r["k"] for _, r in of_hot) < 2000
    assert all(a["hi"] < b["lo"] for (_, a), (_, b) in zip(of_hot, of_hot[1:]))
    many = {(r["g"], r["metric"]): tuple(r)[2:] for r in bootstrap.bootstrap_ci(df, ["g"], replicas=20).collect()}
    monkeypatch.setattr(bootstrap, "RANGE_CELLS", 10**9)
    monkeypatch.setattr(bootstrap, "SMALL_RANGES", 1)
    one = {(r["g"], r["metric"]): tuple(r)[2:] for r in bootstrap.bootstrap_ci(df, ["g"], replicas=20).collect()}
    assert many.keys() == one.keys()
    for k in one:
        assert many[k] == pytest.approx(one[k], abs=1e-9), k


def test_bootstrap_sums_do_not_depend_on_blocks():
    rng = np.random.default_rng(1)
    cells = {"p": rng.random(300), "n_pos": rng.integers(0, 3, 300), "n_neg": rng.integers(0, 3, 300), "base": rng.integers(0, 2**32, 300)}
    whole, split = (bootstrap.replica_sums(cells, 0.65, 50, rows) for rows in (1024, 7))
    assert np.allclose(whole, split)


def test_unscored_rows_count_nowhere(spark):
    """All metric functions agree on a table with missing scores and classes."""
    rows = [(i, "g", i % 2, (i * 37 % 101) / 100) for i in range(60)]
    holes = [(i, g, None if i % 11 == 0 else y, None if i % 7 == 0 else p) for i, g, y, p in rows]
    schema = "id long, g string, y int, p double"
    whole = spark.createDataFrame([r for r in holes if r[2] is not None and r[3] is not None], schema)
    holed, n = spark.createDataFrame(holes, schema), sum(r[2] is not None and r[3] is not None for r in holes)
    reports_of = (
        metrics.rates, metrics.brier, metrics.ece10, metrics.reliability_table, metrics.point_metrics, metrics.cell_metrics,
        metrics.metrics_full, metrics.metrics_by_source, reports.suite_line, reports.shift_report, reports.abstention_report,
    )
    for report in reports_of:
        got, want = (
            sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in report(df, ["g"]).collect())
            for df in (holed, whole)
        )
        assert got == want, report.__name__
        if report is not metrics.reliability_table:
            assert report(holed, ["g"]).first()["n"] == n
    left_out = metrics.unscored(holed, ["g"]).first()
    assert (left_out["n_rows"], left_out["n_unscored"]) == (60, 60 - n)


def test_single_class_bootstrap_skips_null_metrics(spark):
    ci = {r["metric"]: r for r in bootstrap.bootstrap_ci(frame(spark, {"g": [(0, 0.2)] * 20}), ["g"], replicas=20).collect()}
    assert ci["balanced_accuracy"]["mean"] is None and ci["auroc"]["lo"] is None
    assert ci["real_recall"]["mean"] == 1.0


def test_sweep_matches_brute_force_and_prefers_the_largest_threshold(spark):
    data = groups()
    df = frame(spark, data)
    sweep = sampling.threshold_sweep(df, ["g"])
    grid = np.linspace(0, 1, 201)
    for r in sweep.collect():
        y, p = (np.array(x, float) for x in zip(*data[r["g"]]))
        t = r["i"] / 200
        assert r["t"] == grid[r["i"]] or abs(r["t"] - grid[r["i"]]) < 1e-15
        for cls, name in ((1, "recall"), (0, "fpr")):
            want = None if not (y == cls).any() else (p[y == cls] >= t).mean()
            assert same(r[name], want), (r["g"], t, name)
    pick = {r["g"]: r for r in sampling.sweep_pick(sweep, ["g"]).collect()}
    y, p = (np.array(x, float) for x in zip(*data["smooth"]))
    ok = [(np.mean(p[y == 1] >= t), t) for t in np.arange(201) / 200 if np.mean(p[y == 0] >= t) <= 0.03]
    assert (pick["smooth"]["recall"], pick["smooth"]["t"]) == max(ok)
    assert pick["only ai"]["t"] is None


def test_operating_point_matches_brute_force(spark):
    data = groups()
    got = {r["g"]: r for r in sampling.operating_point(frame(spark, data), ["g"]).collect()}
    for g, pairs in data.items():
        y, p = (np.array(x, float) for x in zip(*pairs))
        ok = []
        if (y == 0).any():
            for t in set(p):
                if (p[y == 0] < t).mean() >= 0.98:
                    ok.append(((p[y == 1] >= t).mean() if (y == 1).any() else 0.0, t))
        want = max(ok)[1] if ok else None
        assert got[g]["t"] == want, g


def test_abstention_edges_and_empty_band(spark):
    df = frame(spark, {"a": [(1, 0.65), (0, 0.35), (1, 0.5), (0, 0.9)], "b": [(1, 0.5), (0, 0.6)]})
    got = {r["g"]: r for r in reports.abstention_report(df, ["g"]).collect()}
    assert (got["a"]["n_decided"], got["a"]["abstain_rate"]) == (3, 0.25)
    assert abs(got["a"]["error_within_decided"] - 1 / 3) < 1e-12
    assert got["b"]["abstain_rate"] == 1.0 and got["b"]["error_within_decided"] is None


def test_abstention_gates(spark):
    rows = [("c", 1, 0.1, True)] * 9 + [("c", 1, 0.1, False)] + [("c", 1, 0.9, False)] * 30
    df = spark.createDataFrame(rows, "variant string, y int, p double, flag boolean")
    r = reports.abstention_gates(reports.abstention_cells(df, "variant")).first()
    assert r["wrong_abstained_share"] == 0.9 and r["gate_abstained"] and r["gate_decided"] and r["gate_rate"]


def test_degradation_arithmetic_and_gate(spark):
    rows = [("clean", 1, 0.9), ("clean", 0, 0.1), ("jpeg60", 1, 0.2), ("jpeg60", 0, 0.1)]
    rep = reports.degradation_report(spark.createDataFrame(rows, "variant string, y int, p double"))
    got = {r["variant"]: r for r in rep.collect()}
    assert got["clean"]["delta"] == 0 and got["jpeg60"]["delta"] == -0.5
    assert not reports.robustness_gate(rep).first()["passed"]
