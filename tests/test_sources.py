"""Scans, sinks, validation and joins on hand-made fixtures."""

import hashlib
import json
import struct
import zlib
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from assay.functions.provenance import classify_provenance
from assay.functions.scalars import badge_text, fit_side, image_eligible, product_state, source_of_path
from assay.operators import joins, quality
from assay.sources import scans, schemas, sinks


def png(side, shade=128):
    """A gray PNG of side x side."""
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", side, side, 8, 0, 0, 0, 0)
    lines = b"".join(b"\0" + bytes((shade + 3 * r + c) % 256 for c in range(side)) for r in range(side))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    files = {
        "picsum/a.png": png(16), "picsum/deep/b.PNG": png(8), "holdout2/ai/m1/c.jpg": png(2), "probe/real/d.jpg": png(3),
        "probe/real/skip.txt": b"no", "top.webp": b"xx", "picsum/broken.png": png(16)[:60],
    }
    for name, body in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)
    return root


def test_asset_tree_filters_extension_and_top_folder(spark, tree):
    got = {r["rel"] for r in scans.scan_asset_tree(spark, str(tree)).select("rel").collect()}
    assert got == {"picsum/a.png", "picsum/deep/b.PNG", "picsum/broken.png", "top.webp"}


def test_suites(spark, tree, tmp_path):
    (tmp_path / "m.csv").write_text("split,label,path\neval,ai,x/1.jpg\ntrain,ai,x/2.jpg\neval,real,\"x/3,4.jpg\"\n")
    got = scans.scan_suite_glob(spark, str(tree), "eval", str(tmp_path / "m.csv")).collect()
    assert {(r["path"], r["label"]) for r in got} == {("x/1.jpg", "ai"), ("x/3,4.jpg", "real")}
    assert [r["label"] for r in scans.scan_suite_glob(spark, str(tree), "holdout2").collect()] == ["ai"]
    assert [r["label"] for r in scans.scan_suite_glob(spark, str(tree), "probe_real").collect()] == ["real"]
    with pytest.raises(ValueError):
        scans.scan_suite_glob(spark, str(tree), "other")


def test_corrupt_and_tiny_images(spark, tree):
    listing = scans.scan_asset_tree(spark, str(tree), ("png",), ()).select("path", "length")
    readable = scans.scan_images(spark, str(tree)).select("path")
    got = {r["path"].split("/")[-1]: r["kind"] for r in quality.corrupt_or_tiny(listing, readable).collect()}
    assert got == {"a.png": "tiny", "b.PNG": "tiny", "broken.png": "corrupt"}


def test_images_become_luma_grids(spark, tree):
    row = scans.images_to_grids(scans.scan_images(spark, f"{tree}/picsum")).where("path like '%/a.png'").first()
    want = [float((128 + 3 * r + c) % 256) for r in range(16) for c in range(16)]
    assert (row["h"], row["w"]) == (16, 16) and row["grid"] == want and row["red"] == want


LABELS = {
    "label": ("string", ["AI", "real", None]), "target": ("int", [1, 0, None]), "ground_truth": ("boolean", [True, False, None]),
    "class": ("string", ["gen", "photo", "1"]), "is_fake": ("double", [1.0, 2.0, 0.0]), "fake": ("bigint", [1, 1, 0]),
}
WANT = {
    "label": ["ai", "real", "real"], "target": ["ai", "real", "real"], "ground_truth": ["ai", "real", "real"],
    "class": ["ai", "real", "ai"], "is_fake": ["ai", "real", "real"], "fake": ["ai", "ai", "real"],
}


def test_shards_of_every_label_layout(spark, tmp_path):
    for name, (kind, values) in LABELS.items():
        rows = [(bytearray([i]), v) for i, v in enumerate(values)]
        spark.createDataFrame(rows, f"image binary, `{name}` {kind}").write.parquet(f"{tmp_path}/{name}")
        got = scans.scan_parquet_flex(spark, [f"{tmp_path}/{name}"]).orderBy("content").collect()
        assert [r["label"] for r in got] == WANT[name], name


def test_shards_wrapped_missing_corrupt_and_unlabelled(spark, tmp_path):
    rows = [((bytearray(b"a"), "p"), "x"), (None, "y")]
    spark.createDataFrame(rows, "image_data struct<bytes:binary,path:string>, other string").write.parquet(f"{tmp_path}/s")
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_bytes(b"not parquet")
    paths = [f"{tmp_path}/s", f"{tmp_path}/none", f"{tmp_path}/bad"]
    got = scans.scan_parquet_flex(spark, paths).collect()
    assert [(bytes(r["content"]), r["label"]) for r in got] == [(b"a", None)]
    got = scans.scan_parquet_flex(spark, paths, "extract").collect()
    assert [r["label"] for r in got] == ["ai"]
    assert scans.scan_parquet_flex(spark, [f"{tmp_path}/none"]).count() == 0
    (row,) = scans.skipped_files(spark, paths).collect()
    assert row["path"] == f"{tmp_path}/bad/x.parquet" and row["length"] == 11 and row["reason"].startswith("unreadable")


def test_shards_of_mixed_layouts_in_one_folder(spark, tmp_path):
    root, want = tmp_path / "all [of] {them}", Counter()
    root.mkdir()
    for i, (name, (_, values)) in enumerate(LABELS.items()):
        kinds = {"boolean": pa.bool_(), "double": pa.float64(), "int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
        label = pa.array(values, kinds[LABELS[name][0]])
        content = pa.array([b"%d" % i] * len(values), pa.large_binary() if i % 2 else pa.binary())
        # more columns, other orders, and a nested content
        columns = {"note": pa.array([[1]] * len(values)), name: label, "image": content}
        if i == 2:
            columns["image"] = pa.array([{"path": "p", "bytes": b"2"}] * len(values))
        pq.write_table(pa.table(columns), root / f"{name}.parquet")
        want.update((b"%d" % i, v) for v in WANT[name])
    whole = (root / "label.parquet").read_bytes()
    (root / "cut.parquet").write_bytes(whole[:-9])
    pq.write_table(pa.table({"image": ["a"], "label": ["ai"]}), root / "text.parquet")
    pq.write_table(pa.table({"image": pa.array([], pa.binary())}), root / "norows.parquet")
    folder = str(tmp_path / "all*")
    got = Counter((bytes(r["content"]), r["label"]) for r in scans.scan_parquet_flex(spark, [folder]).collect())
    assert got == want
    skipped = {r["path"].split("/")[-1]: r["reason"].split(":")[0] for r in scans.skipped_files(spark, [folder]).collect()}
    assert skipped == {"cut.parquet": "unreadable", "text.parquet": "no bytes"}


def test_extract_variant_does_not_know_gen(spark, tmp_path):
    spark.createDataFrame([(bytearray(b"a"), "gen")], "bytes binary, class string").write.parquet(f"{tmp_path}/x")
    assert scans.scan_parquet_flex(spark, [f"{tmp_path}/x"], "extract").first()["label"] == "real"
    assert scans.scan_parquet_flex(spark, [f"{tmp_path}/x"]).first()["label"] == "ai"


def test_manifest_round_trip_writes_no_empty_split(spark, tmp_path):
    rows = [("train", "ai", 'a "quoted", name.jpg'), ("dev", "real", "b.jpg")]
    df = spark.createDataFrame(rows, schemas.DATASET_MANIFEST)
    sinks.write_manifests(df, f"{tmp_path}/m")
    assert {p.name for p in (tmp_path / "m").glob("split=*")} == {"split=train", "split=dev"}
    back = scans.scan_manifest(spark, f"{tmp_path}/m", "train").select("split", "label", "path").collect()
    assert [tuple(r) for r in back] == [rows[0]]


def appended(spark, path):
    return sorted((r["k"], r["v"]) for r in sinks.read_appended(spark, path).collect())


def test_resumable_append(spark, tmp_path):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(5)] + [(None, "none")], "k int, v string")
    for part in (df.where("k < 2"), df, df, df.limit(0)):
        sinks.append_resumable(part.where("k IS NOT NULL"), f"{tmp_path}/t", ["k"])
    assert appended(spark, f"{tmp_path}/t") == [(i, f"v{i}") for i in range(5)]
    for _ in range(2):
        sinks.append_resumable(df.unionAll(df), f"{tmp_path}/t", ["k"])
    assert len(sinks.read_appended(spark, f"{tmp_path}/t").collect()) == 6  # a null key is a key


def test_a_run_killed_before_its_commit_is_not_read_and_can_be_repeated(spark, tmp_path, monkeypatch):
    df, path = spark.createDataFrame([(i, f"v{i}") for i in range(8)], "k int, v string"), f"{tmp_path}/t"
    sinks.append_resumable(df.where("k < 3"), path, ["k"])
    commit = sinks._commit

    def killed(*args):
        raise KeyboardInterrupt

    monkeypatch.setattr(sinks, "_commit", killed)
    with pytest.raises(KeyboardInterrupt):
        sinks.append_resumable(df, path, ["k"])
    assert [k for k, _ in appended(spark, path)] == [0, 1, 2]
    monkeypatch.setattr(sinks, "_commit", commit)
    sinks.append_resumable(df, path, ["k"])
    assert [k for k, _ in appended(spark, path)] == list(range(8))


def test_two_runs_at_a_time_double_no_key(spark, tmp_path, monkeypatch):
    """The second run starts and ends between the write and the commit of the first."""
    df, path = spark.createDataFrame([(i, f"v{i}") for i in range(10)], "k int, v string"), f"{tmp_path}/t"
    sinks.append_resumable(df.where("k < 2"), path, ["k"])
    commit, other = sinks._commit, [lambda: sinks.append_resumable(df.where("k >= 1 AND k < 7"), path, ["k"])]

    def late(*args):
        if other:
            other.pop()()
        return commit(*args)

    monkeypatch.setattr(sinks, "_commit", late)
    sinks.append_resumable(df, path, ["k"])
    assert [k for k, _ in appended(spark, path)] == list(range(10))


def test_appends_from_threads(spark, tmp_path):
    df, path = spark.createDataFrame([(i, f"v{i}") for i in range(30)], "k int, v string"), f"{tmp_path}/t"
    with ThreadPoolExecutor(4) as pool:
        runs = [pool.submit(sinks.append_resumable, df.where(f"k >= {5 * i} AND k < {5 * i + 15}"), path, ["k"]) for i in range(4)]
        for run in runs:
            run.result()
    assert [k for k, _ in appended(spark, path)] == list(range(30))


def test_records_are_moved_and_never_replaced(spark, tmp_path):
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name in "abc":
        (tmp_path / name).write_text(name)
    a, b, c = (jvm.org.apache.hadoop.fs.Path(f"file:{tmp_path}/{name}") for name in "abc")
    sinks._move(jvm, conf, a, jvm.org.apache.hadoop.fs.Path(f"file:{tmp_path}/d"))
    assert (tmp_path / "d").read_text() == "a"
    with pytest.raises(FileExistsError):
        sinks._move(jvm, conf, b, c)
    assert (tmp_path / "c").read_text() == "c"


def test_rows_of_an_earlier_plain_folder_count(spark, tmp_path):
    df, path = spark.createDataFrame([(i, f"v{i}") for i in range(4)], "k int, v string"), f"{tmp_path}/t"
    df.where("k < 2").write.parquet(path)
    sinks.append_resumable(df, path, ["k"])
    assert [k for k, _ in appended(spark, path)] == list(range(4))
    with pytest.raises(ValueError):
        sinks.read_appended(spark, f"{tmp_path}/none")


def test_registries(spark, tmp_path):
    suites = {"a": {"role": "t", "size": {"ai": 2}, "files": ["x"], "ai_sources": "one, two"}, "b": {"ai_sources": ["m", "n"]}}
    (tmp_path / "r.json").write_text(json.dumps({"policy": {"threshold": 0.65}, "suites": suites}, indent=1))
    got = {r["suite"]: r for r in scans.registry_suites(scans.scan_benchmark_registry(spark, f"{tmp_path}/r.json")).collect()}
    assert got["a"]["ai_sources"] == ["one, two"] and got["b"]["ai_sources"] == ["m", "n"]
    assert got["a"]["threshold"] == 0.65 and got["a"]["size"] == {"ai": 2}
    df = spark.createDataFrame([("train",), ("train",), ("dev",)], "split string")
    sinks.write_registry(sinks.registry_row(df, "test"), f"{tmp_path}/reg")
    back = scans.registry_splits(scans.scan_forensic_registry(spark, f"{tmp_path}/reg"))
    assert {(r["split"], r["rows"]) for r in back.collect()} == {("train", 2), ("dev", 1)}
    moved = quality.split_reconcile(back, df.where("split = 'train'"))
    assert {(r["split"], r["matches"]) for r in moved.collect()} == {("train", True), ("dev", False)}


def test_bundle_audit_against_files(spark, tmp_path):
    folder = tmp_path / "models"
    folder.mkdir()
    bodies = {"good": b"1", "stale": b"2", "extra": b"3"}
    for name, body in bodies.items():
        (folder / name).write_bytes(body)
    sha = {n: hashlib.sha256(b).hexdigest() for n, b in bodies.items()}
    shape = ["N", 3, 384, 384]
    models = {
        "good": {"role": "x", "size_bytes": 1, "sha256": sha["good"], "input_shape": shape},
        "stale": {"role": "x", "size_bytes": 9, "sha256": sha["good"], "input_shape": shape},
        "short": {"role": "x", "size_bytes": 1, "sha256": "abc", "input_shape": ["N", 3, 256, 256]},
    }
    (tmp_path / "bundle.json").write_text(json.dumps({"models": models}))
    expected = spark.createDataFrame([("good",), ("stale",), ("short",), ("absent",)], "name string")
    out = joins.artifact_audit(
        expected, scans.scan_model_bundle(spark, f"{tmp_path}/bundle.json"), scans.hashed_files(spark, str(folder))
    )
    assert {tuple(r) for r in out.collect()} == {
        ("absent", "missing from manifest"), ("stale", "hash mismatch"), ("stale", "size mismatch"),
        ("short", "bad sha256"), ("short", "input shape"), ("extra", "not expected"),
    }


def test_path_list(spark, tmp_path):
    (tmp_path / "l.txt").write_text(" a \n\n  \nb\n")
    assert [r[0] for r in scans.scan_path_list(spark, f"{tmp_path}/l.txt").collect()] == ["a", "b"]


PATHS = {
    "data/eval/real/x.jpg": "real:eval", "real/x.jpg": "real:unknown", "a/ai/b/real/c": "real:b", "/ai/x": "ai:/",
    "q/w.jpg": "unknown",
}


def test_path_rules(spark):
    df = spark.createDataFrame([(p,) for p in PATHS], "path string")
    got = {r[0]: r[1] for r in df.select("path", source_of_path(F.col("path"))).collect()}
    assert got == PATHS


PROVENANCE = {
    "/r/holdout_oos/ai_mj2/1.jpg": ("mj2", "commercial_api", "ai"), "/r/holdout_oos/ai_sd_db/1.jpg": ("sd_db", "latent_diffusion", "ai"),
    "/r/train_extra/real_coco/1.jpg": ("real_coco", "camera_photo", "real"), "/r/train_extra/new/1.jpg": ("new", "unknown", "real"),
    "/r/xgen/train/1.jpg": ("xgen", "latent_diffusion", "ai"), "/r/train/ai/1.jpg": ("schnell", "latent_diffusion", "ai"),
    "/r/train/x.jpg": ("imagenette", "web_jpeg", "real"), "/r/cifake/ai/1.jpg": ("cifake_ai", "latent_diffusion", "ai"),
    "/r/cifake/real/1.jpg": ("cifake_real", "camera_photo", "real"), "/r/probe/ai/1.jpg": ("probe_ai", "latent_diffusion", "ai"),
    "/r/odd/1.jpg": ("odd", "unknown", "real"),
}


def test_provenance_rules(spark):
    df = spark.createDataFrame([(p,) for p in PROVENANCE], "path string")
    got = {r["path"]: (r["source"], r["family"], r["label"]) for r in classify_provenance(df, roots=["/z", "/r"]).collect()}
    assert got == PROVENANCE


def test_product_edges(spark):
    df = spark.createDataFrame([(0.3499,), (0.35,), (0.6499,), (0.65,), (0.005,), (None,)], "p double")
    got = [tuple(r) for r in df.select(product_state(F.col("p")), badge_text(F.col("p"))).collect()]
    assert got == [("real", "real 35%"), ("uncertain", "? 35%"), ("uncertain", "? 65%"), ("ai", "AI 65%"), ("real", "real 1%"), (None, None)]
    side = spark.createDataFrame([(1537, 1), (100, 50), (0, 0)], "w int, h int")
    assert [tuple(r) for r in side.select(*fit_side(F.col("w"), F.col("h"))).collect()] == [(768, 1), (100, 50), (1, 1)]
    img = spark.createDataFrame([("a", 64, 64), ("a", 63, 99), ("", 99, 99), (None, 99, 99)], "s string, w int, h int")
    assert [r[0] for r in img.select(image_eligible(F.col("s"), F.col("w"), F.col("h"))).collect()] == [True, False, False, False]


def test_passage_join_equals_brute_force(spark):
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    docs = [(i, " ".join(words[(i * k) % 6] for k in range(1, 12)) + f"! x{i}") for i in range(60)]
    docs += [(100 + i, "The Hot passage here, again") for i in range(300)]
    docs += [(900, "prefixhot passage herer"), (901, ""), (902, "ab-cd")]
    tags = [(1, "HOT passage here"), (2, "ta gamma de"), (3, "beta"), (4, "lon zeta alp"), (5, "t passage her"), (6, "b-c"), (7, "passage"),
            (8, "alpha beta gamma delta"), (9, ", again"), (10, " hot passage here,")]
    out = joins.sealed_passage_join(
        spark.createDataFrame(docs, "d int, t string"), spark.createDataFrame(tags, "k int, s string"), "d", "t", "k", "s"
    )
    want = {(d, k) for d, t in docs for k, s in tags if s.lower() in t.lower()}
    rows = [tuple(r) for r in out.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_globs(spark):
    paths = ["eval/a.jpg", "x/eval/b/c.jpg", "evaluation/a.jpg", "bench_pub/q/w.parquet", "m/n1.jpg", "m/k/n1.jpg"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {(r["path"], r["glob"]) for r in joins.glob_policy_join(df, ["eval", "bench_pub/**", "m/n?.jpg"]).collect()}
    assert got == {("eval/a.jpg", "eval"), ("x/eval/b/c.jpg", "eval"), ("bench_pub/q/w.parquet", "bench_pub/**"), ("m/n1.jpg", "m/n?.jpg")}


def test_validation_of_a_hot_path(spark):
    rows = [(i, "/same", "h", "train" if i % 2 else "dev") for i in range(500)] + [(900, "/a", "g", "dev"), (901, None, None, "dev")]
    df = spark.createDataFrame(rows, "k int, path string, sha256 string, split string")
    assert {r["k"] for r in quality.duplicate_path(df, "k").collect()} == set(range(1, 500))
    assert [tuple(r) for r in quality.duplicate_hash(df).collect()] == [("h", 500)]
    assert {(r["kind"], r["key"]) for r in quality.split_disjoint(df, ["path", "sha256"]).collect()} == {("path", "/same"), ("sha256", "h")}
    clean = df.where("k = 900")
    assert quality.verdict({"p": quality.duplicate_path(clean, "k")}, {"w": clean}).first()["verdict"] == "PASS"


def test_parity_counts_missing(spark):
    exp = spark.createDataFrame([("s", i, 0.5 + i / 10) for i in range(4)], "g string, id int, p double")
    obs = exp.select("id", "p")
    assert joins.score_parity(exp, obs, "id", ["g"]).first()["passed"]
    r = joins.score_parity(exp, obs.where("id > 0").withColumn("p", F.col("p") + 0.02), "id", ["g"]).first()
    assert r["missing"] == 1 and abs(r["mean_delta"] - 0.015) < 1e-12 and not r["passed"]
