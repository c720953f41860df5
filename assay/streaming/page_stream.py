"""Streams of page images and inference telemetry, each with the batch twin used for checking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from assay.functions.scalars import badge_text, image_eligible, product_state
from assay.operators.sampling import dedup_exact

KEEP_SAMPLES = 50
SERVE_SAMPLES = 30


def stream_dedup_images(df: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each (session, src) once; state is dropped when the watermark passes."""
    return df.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["session", "src"])


def batch_dedup_images(df: DataFrame) -> DataFrame:
    """First event per (session, src)."""
    key = F.concat_ws("\u0001", "session", "src")
    keep = ["session", "src", "ts"]
    return dedup_exact(df.withColumn("_k", key), "_k", [F.col("ts")], keep).drop("_k")


def score_state(df: DataFrame, score: Column) -> DataFrame:
    """Eligible images with score, state and badge; a failed score (null) has neither. Stateless."""
    rows = df.where(image_eligible(F.col("src"), F.col("width"), F.col("height"))).withColumn("p", score)
    return rows.withColumn("state", product_state(F.col("p"))).withColumn("badge", badge_text(F.col("p")))


def start_scoring(
    df: DataFrame, score: Column, sink: Callable[[DataFrame, int], None], checkpoint: str, delay: str = "10 minutes", **trigger
) -> StreamingQuery:
    """Dedup, score and hand every micro-batch to ``sink``, which must be idempotent per batch id.

    ``trigger`` is passed on, such as ``processingTime="5 seconds"`` or ``availableNow=True``.
    """
    writer = score_state(stream_dedup_images(df, delay), score).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def counters(df: DataFrame, by: list[str]) -> DataFrame:
    """Running calls, responses, errors and the latest error text; update mode on a stream."""
    failed = F.col("kind") == "error"
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("infer_calls"),
        F.count_if(~failed).alias("infer_responses"),
        F.count_if(failed).alias("infer_errors"),
        F.max_by("error", F.when(failed, F.col("ts"))).alias("last_error"),
    )


def ready_state(df: DataFrame, fields: list[str], order: list[str], by: list[str]) -> DataFrame:
    """Latest announcement per session."""
    latest = F.max_by(F.struct(*fields), F.struct(*order))
    return df.groupBy(*by).agg(latest.alias("_r")).select(*by, *[F.col(f"_r.{f}").alias(f) for f in fields])


def latency_window(
    df: DataFrame, by: list[str], width: str = "10 minutes", slide: str | None = None, delay: str = "10 minutes"
) -> DataFrame:
    """Count, approximate p50/p95 and maximum per event-time window; late rows beyond the delay are dropped."""
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    rows = df.withWatermark("ts", delay).where(F.col("latency_ms").isNotNull())
    return rows.groupBy(span.alias("w"), *by).agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx("latency_ms", F.lit(0.5)).alias("p50"),
        F.percentile_approx("latency_ms", F.lit(0.95)).alias("p95"),
        F.max("latency_ms").alias("max"),
    ).select(*by, F.col("w.start").alias("start"), "n", "p50", "p95", "max")


def _picks(samples: Column) -> list[Column]:
    s = F.array_sort(samples)
    n = F.size(s)
    p95 = F.least(n - 1, F.floor(n * F.lit(0.95)).cast("int"))
    return [
        n.alias("n"),
        F.element_at(s, F.floor(n / 2).cast("int") + 1).alias("p50"),
        F.element_at(s, p95 + 1).alias("p95"),
        F.array_max(s).alias("max"),
    ]


def last_samples(df: DataFrame, by: list[str], order: list[str], k: int = SERVE_SAMPLES) -> DataFrame:
    """Percentiles of the last k samples per session (batch twin).

    A row number filtered by a small k makes Spark keep k rows per session and task before the shuffle,
    so a busy session does not meet in one task.
    """
    recent = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    rows = df.where(F.col("latency_ms").isNotNull()).withColumn("_r", F.row_number().over(recent)).where(F.col("_r") <= k)
    samples = rows.groupBy(*by).agg(F.collect_list("latency_ms").alias("_s"))
    return samples.select(*by, *_picks(F.col("_s")))


def stream_last_samples(df: DataFrame, keep: int = KEEP_SAMPLES, serve: int = SERVE_SAMPLES) -> DataFrame:
    """Exact ring buffer of the last ``keep`` samples per session by event time; serves the last ``serve``.

    Input columns: session string, ts timestamp, latency_ms double.
    """
    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ring = list(zip(*state.get)) if state.exists else []
        for b in batches:
            fresh = b.dropna(subset=["latency_ms"])
            micros = fresh["ts"].astype("datetime64[us]").astype("int64")
            ring = sorted(ring + list(zip(micros.tolist(), fresh["latency_ms"].tolist())))[-keep:]
        if not ring:
            return
        state.update(([t for t, _ in ring], [float(v) for _, v in ring]))
        s = sorted(v for _, v in ring[-serve:])
        n = len(s)
        yield pd.DataFrame(
            {"session": [key[0]], "n": [n], "p50": [s[n // 2]], "p95": [s[min(n - 1, int(n * 0.95))]], "max": [s[-1]]}
        )

    return df.groupBy("session").applyInPandasWithState(
        update,
        "session string, n int, p50 double, p95 double, max double",
        "ts array<bigint>, latency array<double>",
        "update",
        GroupStateTimeout.NoTimeout,
    )


KLL_K = 200
#: Normalized rank error of a sketch of this size, at 99 % confidence.
RANK_ERROR = 0.0165


def latency_panes(df: DataFrame, by: list[str], pane: str, delay: str = "10 minutes") -> DataFrame:
    """Per event-time pane: count, maximum and a mergeable quantile sketch of the latencies; late rows are dropped.

    The state of a pane is one sketch of bounded size, whatever the number of rows, combined before the shuffle.
    """
    rows = df.withWatermark("ts", delay).where(F.col("latency_ms").isNotNull())
    return rows.groupBy(F.window("ts", pane).alias("w"), *by).agg(
        F.count(F.lit(1)).alias("n"), F.max("latency_ms").alias("max"), F.kll_sketch_agg_double("latency_ms", KLL_K).alias("sketch")
    ).select(*by, F.col("w.start").alias("start"), "n", "max", "sketch")


def sliding_latency(panes: DataFrame, by: list[str], pane_seconds: int, per_window: int) -> DataFrame:
    """Windows of ``per_window`` panes that slide by one: n, max, and p50 and p95 from the merged sketches.

    Rows are not multiplied by the windows, only panes are. A window starts with every pane that it may hold.
    """
    steps = F.explode(F.sequence(F.lit(0), F.lit(per_window - 1)))
    begun = panes.withColumn("_k", steps).withColumn("start", F.timestamp_seconds(F.unix_seconds("start") - F.col("_k") * pane_seconds))
    merged = begun.groupBy(*by, "start").agg(F.sum("n").alias("n"), F.max("max").alias("max"), F.kll_merge_agg_double("sketch", KLL_K).alias("sketch"))
    at = lambda q: F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(f"p{int(q * 100)}")
    return merged.select(*by, "start", "n", "max", at(0.5), at(0.95))


def ordered_feed(spark, df: DataFrame, time: str, parts: int, path: str, file_bytes: int = 32 << 20) -> DataFrame:
    """A table as a file stream in the order of its event time, one micro-batch a part. Rows without a time are left out.

    Every part has the same number of files, so many that the largest part has about ``file_bytes`` of values in each;
    a part with too few rows for them gets empty ones. So a micro-batch is exactly a part, and no task reads a whole one.
    """
    micros = F.unix_micros(time)
    ends = df.agg(F.min(micros).alias("a"), F.max(micros).alias("b")).first()
    first, span = ends["a"] or 0, (ends["b"] or 0) - (ends["a"] or 0) + 1
    part = F.floor((micros - first) * parts / span)
    width = [F.coalesce(F.octet_length(c), F.lit(0)) if kind in ("string", "binary") else F.lit(8) for c, kind in df.dtypes]
    sizes = df.groupBy(part.alias("part")).agg(F.sum(sum(width[1:], width[0]).cast("long")).alias("size")).where("part IS NOT NULL")
    files = max(1, -(-(sizes.agg(F.max("size")).first()[0] or 0) // file_bytes))
    for k in range(parts):
        rows, folder = df.where(part == k), f"{path}/{k:04d}"
        rows = rows.repartition(files) if files > 1 else rows.coalesce(1)
        rows.write.option("maxRecordsPerFile", 0).parquet(folder)
        for _ in range(files - len(spark.read.schema(df.schema).parquet(folder).inputFiles())):
            spark.createDataFrame([], df.schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/*")


def run_available(df: DataFrame, path: str, mode: str = "append", reduce: Callable[[DataFrame], DataFrame] | None = None) -> str:
    """Process everything available, one folder per micro-batch, and return the output folder. ``reduce`` makes a batch smaller.

    A batch that is retried overwrites its own folder, so the output is exactly-once.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        (reduce(batch) if reduce else batch).write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")

    writer = df.writeStream.outputMode(mode).foreachBatch(save).trigger(availableNow=True)
    query = writer.option("checkpointLocation", f"{path}/checkpoint").start()
    query.awaitTermination()
    return f"{path}/out"


def latest_per_key(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Last version of every key in an update-mode output with its ``batch`` column."""
    values = [c for c in updates.columns if c not in (*keys, "batch")]
    newest = updates.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v"))
    return newest.select(*keys, "_v.*")
