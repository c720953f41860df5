"""Splits, caps, samples and dedup against plain Python, with hot groups."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from assay.operators import prompts, ranks, sampling


def order(seed, key):
    return (hashlib.md5(f"{seed}:{key}".encode()).hexdigest(), key)


def strata(sizes):
    return [(g, f"/d/{g}/{i}.jpg") for g, n in sizes.items() for i in range(n)]


SIZES = {"hot": 9000, "one": 1, "two": 2, "three": 3, "twelve": 12, "thirteen": 13}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(strata(SIZES), "source string, path string").repartition(6)


def by_group(df):
    out = defaultdict(dict)
    for r in df.collect():
        out[r["source"]][r["path"]] = r["split"]
    return out


def first(group, k, seed=0):
    paths = sorted((p for g, p in strata(SIZES) if g == group), key=lambda p: order(seed, p))
    return set(paths[:k])


def test_stratified_split_sizes_and_members(rows):
    got = by_group(sampling.split_stratified(rows, ["source"]))
    for g, n in SIZES.items():
        want = max(1, round(0.2 * n))
        dev = {p for p, s in got[g].items() if s == "dev"}
        assert len(got[g]) == n and dev == first(g, want), g


def test_floor_split(rows):
    got = by_group(sampling.split_stratified_floor(rows, ["source"]))
    for g, n in SIZES.items():
        assert {p for p, s in got[g].items() if s == "val"} == first(g, max(1, n // 5)), g


def test_fixed_split_is_disjoint_and_exact(rows):
    got = by_group(sampling.split_fixed(rows, ["source"], 5, 7))
    for g in SIZES:
        chosen = got[g]
        assert {p for p, s in chosen.items() if s == "eval"} == first(g, 5)
        assert set(chosen) == first(g, 12)


def test_sealed_rows_stay_sealed(rows):
    out = sampling.split_stratified(rows, ["source"], sealed=F.col("source") == "two")
    got = by_group(out)
    assert set(got["two"].values()) == {"sealed"}
    assert sum(len(v) for v in got.values()) == sum(SIZES.values())


def test_caps_zero_and_beyond_size(rows):
    out = sampling.cap_per_source(rows, ["source"], {"hot": 700, "one": 0, "two": 5}, default=None)
    counts = Counter(r["source"] for r in out.collect())
    assert counts == {"hot": 700, "two": 2, "three": 3, "twelve": 12, "thirteen": 13}
    assert {r["path"] for r in out.where("source = 'hot'").collect()} == first("hot", 700)


def test_balanced_epochs(spark):
    data = [("ai", f"a{i}") for i in range(30)] + [("real", f"r{i}") for i in range(100)]
    df = spark.createDataFrame(data, "label string, path string")
    rows = sampling.sample_balanced_epoch(df, 2).collect()
    per = Counter((r["epoch"], r["label"]) for r in rows)
    assert per == {(e, c): 30 for e in (0, 1) for c in ("ai", "real")}
    reals = [{r["path"] for r in rows if r["epoch"] == e and r["label"] == "real"} for e in (0, 1)]
    assert reals[0] != reals[1]
    assert sampling.sample_balanced_epoch(df.where("label = 'ai'"), 2).count() == 0


def test_epochs_equal_brute_force_and_write_no_multiples(spark, monkeypatch):
    classes = {"ai": 7000, "real": 3000}
    data = [(c, f"{c}{i}") for c, n in classes.items() for i in range(n)] + [("ai", None), (None, "x"), ("other", "y")]
    df = spark.createDataFrame(data, "label string, path string").repartition(6)
    written = []

    def count(table):
        table = kept(table)
        written.append(table.count())
        return table

    kept = sampling.materialize
    monkeypatch.setattr(sampling, "materialize", count)
    got = defaultdict(set)
    for r in sampling.sample_balanced_epoch(df, 20, cap=100, seed=3).collect():
        got[r["epoch"], r["label"]].add(r["path"])
    want = {}
    for e in range(20):
        for c, n in classes.items():
            paths = (f"{c}{i}" for i in range(n))
            want[e, c] = set(sorted(paths, key=lambda p: order(3, f"{e}/{p}"))[:100])
    assert got == want
    assert written[0] < 20 * 2 * 100 * 2  # of 200,000 pairs of a row and an epoch


def test_epochs_rise_until_whole(spark, monkeypatch):
    df = spark.createDataFrame([(c, f"{c}{i}") for c in ("ai", "real") for i in range(2000)], "label string, path string")
    want = {tuple(r) for r in sampling.sample_balanced_epoch(df, 5, cap=40).collect()}
    monkeypatch.setattr(sampling, "SPARE", -5.0)
    assert {tuple(r) for r in sampling.sample_balanced_epoch(df, 5, cap=40).collect()} == want and len(want) == 400


def test_sample_cases(spark):
    data = [("a", "ai"), ("a", "real"), ("b", "ai"), ("c", "real"), ("d", None)]
    df = spark.createDataFrame(data, "s string, label string")
    got = {r["s"]: r["sample_case"] for r in sampling.sample_case(df, ["s"]).collect()}
    assert got == {"a": "both", "b": "fake-only", "c": "real-only", "d": "label issue"}


def test_dedup_keeps_sealed_first_and_rows_without_hash(spark):
    data = [("h1", "/a", False), ("h1", "/b", True), ("h2", "/c", False), (None, "/d", False), ("", "/e", False), ("", "/f", False)]
    data += [("hot", f"/x{i:04d}", False) for i in range(2000)]
    df = spark.createDataFrame(data, "sha string, path string, sealed boolean").repartition(5)
    out = sampling.dedup_exact(df, "sha", [~F.col("sealed"), F.col("path")], ["path", "sealed"])
    assert {r["path"] for r in out.collect()} == {"/b", "/c", "/d", "/e", "/f", "/x0000"}


def test_dedup_prefix_looks_at_256_bytes(spark):
    data = [("p1", "x" * 256 + "a"), ("p2", "x" * 256 + "b"), ("p3", "x" * 255 + "y"), ("p4", "é" * 128 + "a"), ("p5", "é" * 128 + "b")]
    df = spark.createDataFrame(data, "path string, content string")
    out = sampling.dedup_prefix(df, "content", [F.col("path")], ["path"], confirm=False)
    assert {r["path"]: r["n_merged"] for r in out.collect()} == {"p1": 2, "p3": 1, "p4": 2}
    out = sampling.dedup_prefix(df.unionAll(df.where("path = 'p2'")), "content", [F.col("path")], ["path"])
    assert sorted((r["path"], r["n_merged"]) for r in out.collect()) == [(p, 1) for p, _ in data]


def test_indexes_are_dense(spark):
    keys = [3, 70000, 70001, 5, 200000, -9, 131072]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = {r["k"]: r["row_idx"] for r in ranks.row_index(df, "k").collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}
    sparse = [int(hashlib.sha256(str(i).encode()).hexdigest()[:16], 16) >> 2 for i in range(5000)]
    table = ranks.row_index(spark.createDataFrame([(k,) for k in sparse], "k long"), "k")
    assert {r["k"]: r["row_idx"] for r in table.collect()} == {k: i for i, k in enumerate(sorted(sparse))}
    hashed = sampling.hash_index(spark.range(500).withColumnRenamed("id", "k"), "k", 4).collect()
    want = sorted(range(500), key=lambda k: order(4, k))
    assert [r["k"] for r in sorted(hashed, key=lambda r: r["hash_idx"])] == want


@pytest.mark.parametrize("n,k,offset", [(300, 24, 0), (300, 24, 290), (10, 3, 2), (4, 9, 1)])
def test_systematic_sample(spark, n, k, offset):
    df = ranks.row_index(spark.range(n).withColumnRenamed("id", "key"), "key")
    got = sorted(r["key"] for r in sampling.sample_systematic(df, "row_idx", "n_rows", k, offset).collect())
    step = max(1, n // k)
    assert got == sorted({(offset + i * step) % n for i in range(min(k, n))})


def test_mining_order_limits_and_sealed(spark):
    data = [(f"r{i}", "real", "dev", i / 100) for i in range(100)] + [(f"a{i}", "ai", "dev", i / 100) for i in range(100)]
    data += [("s", "real", "sealed", 0.99)]
    df = spark.createDataFrame(data, "path string, label string, split string, p double")
    got = sampling.mine_hard(df, 3, 2).collect()
    assert {r["path"] for r in got} == {"r99", "r98", "r97", "a0", "a1"}
    assert sampling.mine_hard(df.where("p between 0.7 and 0.6")).count() == 0


def test_reason_rules_are_ordered(spark):
    data = [("x_pair.jpg", 1.0, 99.0), ("b.jpg", 1.0, 7.0), ("c.jpg", 27.0, 6.0), ("d.jpg", 7.9, 1.0), ("e.jpg", 8.0, 1.0), ("f.jpg", None, None)]
    df = spark.createDataFrame(data, "name string, lap double, block double")
    got = [r[0] for r in df.select(sampling.hard_reason(F.col("name"), F.col("lap"), F.col("block"))).collect()]
    assert got == ["matched_pair", "jpeg_artifact", "camera_noise", "generator", "review", "review"]


def test_hard_rows_are_capped_by_true_source_or_by_reason(spark):
    train = spark.createDataFrame([("ai", "s1", f"t{i}") for i in range(4)], "label string, source string, path string")
    hard = [("ai", "s1", f"h{i:02d}", "review") for i in range(20)] + [("ai", "s2", f"g{i}", "noise") for i in range(5)] + [("ai", "s1", "", "review")]
    hard = spark.createDataFrame(hard, "label string, source string, path string, reason string")
    out = sampling.append_hard_capped(train, hard, floor=3)
    assert Counter(r["source"] for r in out.collect()) == {"s1": 4, "hard:s1": 8, "hard:s2": 3}
    out = sampling.append_hard_capped(train, hard, floor=3, reason_rule=True)
    assert Counter(r["source"] for r in out.collect()) == {"s1": 4, "hard:review": 3, "hard:noise": 3}


def test_response_deltas(spark):
    data = [(1, "clean", 0.5), (1, "jpeg", 0.2), (1, "c0", 0.1), (1, "c1", 0.9), (1, "mid", 0.4)]
    df = spark.createDataFrame(data, "id int, variant string, p double")
    r = sampling.response_deltas(df, "id", ["jpeg"], ["c0", "c1", "mid"], "mid").first()
    assert abs(r["d_jpeg"] + 0.3) < 1e-12 and abs(r["max_crop_delta"] - 0.5) < 1e-12
    assert abs(r["crop_std"] - 0.32998316) < 1e-6


def test_prompts(spark):
    t = spark.createDataFrame([(1, "a {0} in {1}", [["cat", "dog"], ["x", "y", "z"]])], "template_id int, template string, slots array<array<string>>")
    out = [r["prompt"] for r in prompts.expand_templates(t, 60, 1).collect()]
    assert len(out) == 60 and set(out) == {f"a {a} in {b}" for a in ("cat", "dog") for b in "xyz"}
    df = spark.createDataFrame([(p,) for p in out], "prompt string")
    few = prompts.distinct_prompts(df, 4)
    assert few.count() == 4 and prompts.distinct_prompts(df, 99).count() == 6
    ids = sorted(r["id"] for r in prompts.assign_aspect_seed(few).collect())
    assert ids == [1, 2, 3, 4]


HTML = """<html><img src="a.jpg" width="64" height="64"><IMG height=200 width='63' src='b.png'>
<img src="data:abc" width="90" height="90"><img src="data:%s" width="90" height="90"/>
<img src="a.jpg" width=10 height=10><img alt="no source" width="99" height="99"><img data-src="lazy" src=c.webp width=100 height=70>""" % ("x" * 800)


def test_page_images(spark):
    df = spark.createDataFrame([(1, HTML)], "page_id int, html string")
    got = {r["src"][:8]: r["eligible"] for r in prompts.page_images(df).where("length(src) <> 8").collect()}
    assert got == {"a.jpg": True, "b.png": False, "data:xxx": True, "": False, "c.webp": True}
    short = prompts.page_images(df).where("src = 'data:abc'").first()
    assert short["eligible"] is False


@pytest.mark.parametrize("n,k,offset", [(300, 24, 0), (300, 24, 290), (10, 3, 2), (4, 9, 1), (9000, 7, 8999), (9000, 100, -3), (1, 1, 5)])
def test_rows_at_positions_rank_only_their_ranges(spark, monkeypatch, n, k, offset):
    keys = sorted({i * i * (-1) ** i for i in range(n)})  # dense about zero, sparse far out
    wanted = []

    def keep(table):
        table = kept(table)
        wanted.append(table.count())
        return table

    kept = ranks.materialize
    monkeypatch.setattr(ranks, "materialize", keep)
    df = spark.createDataFrame([(x,) for x in [*keys, None]], "key long").repartition(5)
    step = max(1, n // k)
    positions = {(offset + i * step) % n for i in range(min(k, n))}
    assert sorted(r["key"] for r in ranks.rows_at(df, "key", k, offset).collect()) == sorted(keys[p] for p in positions)
    assert wanted[0] <= k


def test_rows_at_of_an_empty_table(spark):
    assert ranks.rows_at(spark.range(0).withColumnRenamed("id", "key"), "key", 5).count() == 0
