"""Session state over several batches: visits, restarts, expiry, and sketches against exact ranks."""

import numpy as np
from pyspark.sql import functions as F

from assay.streaming import page_stream as ps
from assay.streaming import sessions
from tests.test_streaming import CALLS, T0, Feed, call

HOUR = 3_600_000


def run(spark, feed, processor, path, delay="10 minutes"):
    """Processes what is there; the update rows so far, and the rows of state after the last batch."""
    with sessions.expiring_state(spark):
        rows = sessions.with_state(feed.read(), processor, delay)
        writer = rows.writeStream.outputMode("update").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{path}/out/batch={i}"))
        query = writer.trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint").start()
        query.awaitTermination()
    return spark.read.parquet(f"{path}/out"), query.recentProgress[-1].stateOperators[0].numRowsTotal


def visits_of(rows):
    got = ps.latest_per_key(rows, ["session", "started"]).collect()
    return {(r.session, int((r.started - T0).total_seconds() // 60)): (r.infer_calls, r.infer_errors, r.last_error, r.closed) for r in got}


def test_visits_close_and_their_state_goes(spark, tmp_path):
    feed, sizes = Feed(spark, tmp_path / "in", CALLS), []
    steps = [
        [call("a", 0, 5.0), call("a", 20, error="x"), call("b", 10, 1.0)] + [call(f"s{i}", 5, 1.0) for i in range(40)],
        [call("a", 50, error="y"), call("a", 45, error="late text")],  # out of order inside the delay
        [call("a", 400, 2.0)],  # everything older is over
        [call("a", 900, 2.0)],
    ]
    for rows in steps:
        feed.add(rows)
        out, size = run(spark, feed, sessions.Visits(HOUR), tmp_path / "job")
        sizes.append(size)
    got = visits_of(out)
    assert got[("a", 0)] == (4, 3, "y", True) and got[("b", 10)] == (1, 0, None, True)
    assert got[("a", 400)] == (1, 0, None, True) and got[("a", 900)] == (1, 0, None, False)
    assert all(got[(f"s{i}", 5)][3] for i in range(40))
    assert sizes[-1] < sizes[0] / 5  # only one open visit is left of 42


def test_visits_do_not_depend_on_batches(spark, tmp_path):
    rng = np.random.default_rng(6)
    minutes = np.sort(rng.integers(0, 5000, 300))
    rows = [call(f"s{rng.integers(0, 4)}", int(m), 1.0, "boom" if rng.random() < 0.3 else None) for m in minutes]
    rows += [(None, T0, "response", None, 1.0)]
    results = []
    for name, cuts in (("one", [300]), ("many", [60, 120, 200, 300])):
        feed, at = Feed(spark, tmp_path / name / "in", CALLS), 0
        for end in cuts:
            feed.add(rows[at:end] + rows[300:])
            at = end
            out, _ = run(spark, feed, sessions.Visits(HOUR), tmp_path / name / "job")
        results.append({k: v[:3] for k, v in visits_of(out).items()})
    twin = sessions.batch_visits(spark.createDataFrame(rows[:300], CALLS), "1 HOUR").collect()
    want = {(r.session, int((r.started - T0).total_seconds() // 60)): (r.infer_calls, r.infer_errors, r.last_error) for r in twin}
    assert results[0] == want and results[1] == want


def test_ready_state_is_forgotten(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", CALLS)
    for rows in ([call("a", 0, 1.0), call("a", 5, 2.0), call("b", 5, 3.0)], [call("a", 50, 9.0)], [call("c", 90, 1.0)], [call("c", 91, 1.0)]):
        feed.add(rows)
        out, size = run(spark, feed, sessions.Ready(HOUR), tmp_path / "job")
    got = {r.session: (r.latency_ms, r.live) for r in ps.latest_per_key(out, ["session"]).collect()}
    assert got == {"a": (9.0, True), "b": (3.0, False), "c": (1.0, True)}


def test_ring_starts_anew_after_the_gap(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", CALLS)
    for rows in ([call("a", i, 100.0 + i) for i in range(70)], [call("a", 200, 1.0), call("a", 201, 3.0)], [call("z", 600, 1.0)], [call("z", 601, 1.0)]):
        feed.add(rows)
        out, size = run(spark, feed, sessions.Ring(HOUR), tmp_path / "job")
    per_batch = {(r.session, r.batch): (r.n, r.max) for r in out.collect()}
    assert per_batch[("a", 0)] == (30, 169.0) and (2, 3.0) in per_batch.values()
    assert sum(1 for s, _ in per_batch if s == "a") == 2


def test_sketches_of_panes_merge_within_their_rank_error(spark):
    rng = np.random.default_rng(7)
    values = np.concatenate([rng.lognormal(3, 1, 60_000), np.full(20_000, 7.0)])
    minutes = rng.integers(0, 600, len(values))
    rows = spark.createDataFrame(list(zip(minutes.tolist(), values.tolist())), "m int, latency_ms double")
    rows = rows.select(F.timestamp_seconds(F.lit(1767225600) + F.col("m") * 60).alias("ts"), "latency_ms", F.lit("x").alias("k"))
    panes = ps.latency_panes(rows, ["k"], "1 hour").persist()
    windows = ps.sliding_latency(panes, ["k"], 3600, 3).collect()
    assert len(windows) == 12 and panes.count() == 10
    for w in windows:
        hour = int((w.start.timestamp() if w.start.tzinfo else (w.start - T0).total_seconds()) // 3600)
        mine = np.sort(values[(minutes >= hour * 60) & (minutes < hour * 60 + 180)])
        assert (w.n, w.max) == (len(mine), mine[-1])
        for q, got in ((0.5, w.p50), (0.95, w.p95)):
            low, high = np.searchsorted(mine, got, "left") / len(mine), np.searchsorted(mine, got, "right") / len(mine)
            assert low <= q + ps.RANK_ERROR and high >= q - ps.RANK_ERROR


def test_feed_has_one_batch_a_part_in_order(spark, tmp_path):
    rows = spark.createDataFrame([call("s", m, 1.0) for m in (50, 3, 99, 0, 20)] + [("s", None, "response", None, 1.0)], CALLS)
    out = ps.run_available(ps.ordered_feed(spark, rows, "ts", 4, f"{tmp_path}/feed"), f"{tmp_path}/job")
    got = {(r.batch, int((r.ts - T0).total_seconds() // 60)) for r in spark.read.parquet(out).collect()}
    assert got == {(0, 0), (0, 3), (0, 20), (2, 50), (3, 99)} or [m for _, m in sorted(got)] == [0, 3, 20, 50, 99]


def test_merged_batches_equal_the_visits_of_one_table(spark, tmp_path):
    """Panes, latest announcements and rings of several batches against a table at rest; no task calls Python per session."""
    rng = np.random.default_rng(8)
    minutes = np.sort(rng.integers(0, 5000, 400))
    rows = [call(f"s{rng.integers(0, 6)}", int(m), float(rng.integers(1, 99)), "boom" if rng.random() < 0.3 else None) for m in minutes]
    rows += [call("edge", m, 1.0) for m in (0, 60, 121)] + [call("none", 4999), (None, T0, "response", None, 1.0)]
    df = spark.createDataFrame(rows, CALLS)

    def parts(name, reduce):
        feed = ps.ordered_feed(spark, df, "ts", 3, f"{tmp_path}/{name}/feed", file_bytes=4000)
        out = ps.run_available(feed, f"{tmp_path}/{name}/job", reduce=reduce)
        return spark.read.parquet(out).drop("batch")

    panes = parts("panes", lambda b: sessions.batch_panes(b, HOUR))
    visits = sessions.pane_visits(panes, HOUR, "10 minutes")
    counters = ("session", "started", "ended", "infer_calls", "infer_responses", "infer_errors", "last_error")
    want = sessions.batch_visits(df.where("session IS NOT NULL"), "1 HOUR").select(*counters).collect()
    assert sorted(visits.select(*counters).collect()) == sorted(want)
    assert sorted((r.infer_calls, r.closed) for r in visits.where("session = 'edge'").collect()) == [(1, True), (2, True)]
    assert not visits.where("session = 'none'").first().closed
    assert "Python" not in visits._jdf.queryExecution().executedPlan().toString()
    latest = {r.session: r.live for r in sessions.latest_ready(parts("latest", sessions.batch_latest), HOUR, "10 minutes").collect()}
    assert latest["none"] and not latest["edge"] and len(latest) == 8
    ring = {r.session: (r.n, r.max) for r in sessions.ring_figures(parts("ring", sessions.recent_samples), HOUR).collect()}
    assert ring["edge"] == (1, 1.0) and "none" not in ring
    for s in ("s0", "s5"):
        mine = [(r[1], r[4]) for r in rows if r[0] == s and r[4] is not None]
        last = max(i for i in range(len(mine)) if i == 0 or (mine[i][0] - mine[i - 1][0]).total_seconds() > 3600)
        assert ring[s][0] == min(30, len(mine) - last)
