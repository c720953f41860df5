"""Streams with duplicates, late events and restarts."""

import os
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from assay.streaming import page_stream as ps

T0 = datetime(2026, 1, 1)


class Feed:
    """A folder stream fed one file per step."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema = spark, str(path), schema
        os.makedirs(self.path, exist_ok=True)

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def read(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.path)


IMAGES = "session string, src string, width int, height int, ts timestamp"


def image(session, src, minute, size=100):
    return (session, src, size, size, T0 + timedelta(minutes=minute))


def test_dedup_within_the_watermark_and_late_rows(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", IMAGES)
    steps = [
        [image("s", "a", 0), image("s", "a", 1), image("s", "b", 1), image("t", "a", 1)],
        [image("s", "a", 5), image("s", "c", 100)],
        [image("s", "d", 101)],
        [image("s", "late", 2), image("s", "c", 101)],
    ]
    seen = []
    for rows in steps:
        feed.add(rows)
        out = ps.run_available(ps.stream_dedup_images(feed.read()), f"{tmp_path}/job")
        seen = sorted((r["session"], r["src"]) for r in spark.read.parquet(out).collect())
    assert seen == [("s", "a"), ("s", "b"), ("s", "c"), ("s", "d"), ("t", "a")]
    static = spark.createDataFrame([r for s in steps for r in s], IMAGES)
    assert ps.batch_dedup_images(static).count() == 6


def test_scoring_stream_skips_small_and_failed_images(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", IMAGES)
    feed.add([image("s", "ai", 0), image("s", "real", 0), image("s", "small", 0, 63), image("s", "fail", 0)])
    score = F.when(F.col("src") == "ai", 0.9).when(F.col("src") == "real", 0.1)
    out = ps.run_available(ps.score_state(feed.read(), score), f"{tmp_path}/job")
    got = {r["src"]: (r["state"], r["badge"]) for r in spark.read.parquet(out).collect()}
    assert got == {"ai": ("ai", "AI 90%"), "real": ("real", "real 10%"), "fail": (None, None)}


CALLS = "session string, ts timestamp, kind string, error string, latency_ms double"


def call(session, minute, latency=None, error=None):
    return (session, T0 + timedelta(minutes=minute), "error" if error else "response", error, latency)


def test_counters_survive_a_restart(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", CALLS)
    out = None
    for rows in ([call("s", 1, 5.0), call("s", 9, error="new")], [call("s", 3, error="old"), call("t", 4, 1.0)]):
        feed.add(rows)
        out = ps.run_available(ps.counters(feed.read(), ["session"]), f"{tmp_path}/job", "update")
    got = {r["session"]: r for r in ps.latest_per_key(spark.read.parquet(out), ["session"]).collect()}
    s = got["s"]
    assert (s["infer_calls"], s["infer_responses"], s["infer_errors"], s["last_error"]) == (3, 1, 2, "new")
    assert got["t"]["last_error"] is None


def test_ring_keeps_the_last_samples_and_equals_the_batch_twin(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [call("busy", int(m), float(rng.integers(1, 900))) for m in rng.permutation(130)] + [call("calm", 1, 7.0), call("calm", 2)]
    feed, schema = Feed(spark, tmp_path / "in", CALLS), ["session", "ts", "latency_ms"]
    for part in (rows[:40], rows[40:90], rows[90:]):
        feed.add([r for r in part if r])
        out = ps.run_available(ps.stream_last_samples(feed.read().select(*schema)), f"{tmp_path}/job", "update")
    got = {r["session"]: r for r in ps.latest_per_key(spark.read.parquet(out), ["session"]).collect()}
    twin = {r["session"]: r for r in ps.last_samples(spark.createDataFrame(rows, CALLS), ["session"], ["ts"]).collect()}
    for s in ("busy", "calm"):
        assert [got[s][k] for k in ("n", "p50", "p95", "max")] == [twin[s][k] for k in ("n", "p50", "p95", "max")]
    assert got["busy"]["n"] == 30 and got["calm"]["n"] == 1


def test_latency_windows_drop_late_rows(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", CALLS)
    out = None
    for rows in ([call("s", 1, 10.0), call("s", 2, 30.0)], [call("s", 60, 5.0)], [call("s", 3, 999.0), call("s", 61, 6.0)], [call("s", 200, 1.0)]):
        feed.add(rows)
        out = ps.run_available(ps.latency_window(feed.read(), ["session"]), f"{tmp_path}/job")
    got = {r["start"].minute + 60 * r["start"].hour: (r["n"], r["max"]) for r in spark.read.parquet(out).collect()}
    assert got[0] == (2, 30.0) and got[60] == (2, 6.0)


def test_latest_announcement(spark):
    rows = [("s", 1, "wasm"), ("s", 5, "gpu"), ("s", 3, "cpu"), ("t", 1, "wasm")]
    df = spark.createDataFrame(rows, "session string, ts int, ep string")
    got = {r["session"]: r["ep"] for r in ps.ready_state(df, ["ep"], ["ts"], ["session"]).collect()}
    assert got == {"s": "gpu", "t": "wasm"}


def test_parts_of_a_feed_are_dealt_to_equally_many_files(spark, tmp_path):
    rows = [image("s", f"{i:04d}" * 20, i % 300) for i in range(600)] + [image("s", "lone", 5000)]
    df = spark.createDataFrame(rows, IMAGES)
    feed = ps.ordered_feed(spark, df, "ts", 4, f"{tmp_path}/feed", file_bytes=10_000)
    files = [len(list((tmp_path / "feed" / f"{k:04d}").glob("*.parquet"))) for k in range(4)]
    assert files[0] > 4 and len(set(files)) == 1
    out = spark.read.parquet(ps.run_available(feed, f"{tmp_path}/job"))
    # a micro-batch is a part; empty ones may leave no folder of rows
    got = {(r.batch, r["count"]) for r in out.groupBy("batch").count().collect()}
    assert got == {(0, 600), (3, 1)}
