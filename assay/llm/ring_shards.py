"""Shards by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assay.llm.tables import named, stored


def ring_shards(
    df: DataFrame,
    shards: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    virtual: int = 256,
    ticks: int = 16384,
    bucket_rows: int = 20000,
) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    Every shard has ``virtual`` nodes on a ring of ``ticks`` positions, and a document belongs to the first node
    clockwise from its own position. Loads are bounded to n / shards rows, with the remainder of that division in
    the lowest shards, so that the counts of two shards differ by one at most (law ``rows``). A full shard keeps
    the rows that come first by a second hash of the id; the others continue clockwise to the next shard that
    still has room. In every round at least one more shard fills up, which bounds the rounds by the shards.

    Slots number the rows of a shard without gaps, first come first. The size is the UTF-8 bytes of the text
    plus one. A null text counts as empty; rows without an id are left out; equal ids fall on the same position,
    and overflow like others. ``grown_shard`` is null, since under bounded loads other rows matter as well.

    All on DataFrame functions. Rows are ranked in buckets of about ``bucket_rows`` rows of one shard, whose counts
    give each bucket its offset: no window sees a whole shard. The ring is a table of ``ticks`` rows.
    """
    spark = df.sparkSession
    text = F.col("text").cast("binary")
    rows = named(df, id_col, text_col).select(
        "doc_id",
        (F.length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.pmod(F.xxhash64(F.lit("place"), "doc_id"), F.lit(ticks)).alias("tick"),
        F.xxhash64(F.lit("turn"), "doc_id").alias("turn"),
    )
    waiting = stored(rows)
    total = waiting.count()
    room = {s: total // shards + (s < total % shards) for s in range(shards)}
    load, placed, left = dict.fromkeys(range(shards), 0), [], total
    while left:
        active = [s for s in range(shards) if load[s] < room[s]]
        bits = min(30, max(4, math.ceil(math.log2(max(1, left / (len(active) * bucket_rows))))))
        here = waiting.join(F.broadcast(_ring(spark, active, virtual, ticks)), "tick")
        ranked = stored(_ranked(here, bits, load, room))
        came = {r["shard"]: r["n"] for r in ranked.groupBy("shard").agg(F.count("*").alias("n")).collect()}
        placed.append(ranked.filter("fits"))
        waiting = ranked.filter("NOT fits").select("doc_id", "size", "text_crc32", "tick", "turn")
        left = sum(max(0, load[s] + n - room[s]) for s, n in came.items())
        load = {s: min(room[s], load[s] + came.get(s, 0)) for s in load}
    empty = waiting.limit(0).select("*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    fields = ["doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot"]
    parts = [p.select(*fields, F.lit(None).cast("int").alias("grown_shard")) for p in placed or [empty]]
    return reduce(DataFrame.unionAll, parts)


def _ring(spark: SparkSession, active: list[int], virtual: int, ticks: int) -> DataFrame:
    """``tick, shard``: the shard of the first node of an active shard at or after each tick, round the ring."""
    node = F.col("id")
    nodes = spark.range(0, (max(active) + 1) * virtual, 1, 1).select(
        F.floor(node / virtual).cast("int").alias("shard"),
        F.pmod(F.xxhash64(F.lit("node"), F.floor(node / virtual), node % virtual), F.lit(ticks)).alias("tick"),
    )
    nodes = nodes.filter(F.col("shard").isin(active)).groupBy("tick").agg(F.min("shard").alias("own"))
    every = spark.range(0, ticks, 1, 1).withColumnRenamed("id", "tick").join(nodes, "tick", "left")
    back = Window.orderBy(F.col("tick").desc())
    around = Window.orderBy("tick").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first("own", ignorenulls=True).over(around)
    return every.select("tick", F.coalesce(F.last("own", ignorenulls=True).over(back), first).alias("shard"))


def _ranked(here: DataFrame, bits: int, load: dict[int, int], room: dict[int, int]) -> DataFrame:
    """Number the newcomers of each shard behind its load by their turn, and mark those that find room."""
    rows = here.withColumn("bucket", F.shiftrightunsigned("turn", 64 - bits))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")
    offsets = counts.select("shard", "bucket", before.alias("before"))
    order = Window.partitionBy("shard", "bucket").orderBy("turn", "doc_id", "text_crc32", "size")
    numbered = rows.withColumn("turn_no", F.row_number().over(order)).join(offsets, ["shard", "bucket"])
    slot = _per_shard(load) + F.col("before") + F.col("turn_no") - 1
    numbered = numbered.withColumn("slot", slot.cast("long"))
    fits = F.col("slot") < _per_shard(room)
    return numbered.select("doc_id", "size", "text_crc32", "tick", "turn", "shard", "slot", fits.alias("fits"))


def _per_shard(values: dict[int, int]) -> Column:
    table = F.array(*[F.lit(values[s]).cast("long") for s in sorted(values)])
    return F.element_at(table, F.col("shard") + 1)
