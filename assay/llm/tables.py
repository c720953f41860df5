"""What the corpus operators share: inputs, intermediate tables, Arrow batches and words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.llm.wordhash import BitFilter, segment_of
from assay.session import scratch_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared scratch folder: evaluated once, cut from their lineage, safe from lost executors."""
    path = scratch_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def named(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id and text alone, under fixed names, so that no other column of the input can clash.

    Rows without an id cannot be named in a result and take no part. A null text counts as empty.
    """
    kept = df.filter(F.col(f"`{id_col}`").isNotNull())
    return kept.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def ascii_lower(text: Column) -> Column:
    """Only A to Z become lower case."""
    return F.translate(text, UPPER, LOWER)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], splits: int) -> DataFrame:
    """Left join of rows that have a ``doc_id`` with one row per group, dealing the rows of a group to ``splits`` tasks.

    Each group goes out ``splits`` times, so that one group with a third of all rows is no single task's work. Groups
    of one row are best left out of ``groups`` before: their rows match nothing.
    """
    renamed = groups.select(*[F.col(k).alias(f"g_{k}") for k in keys], *[c for c in groups.columns if c not in keys])
    renamed = renamed.withColumn("g_part", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    dealt = rows.withColumn("part", F.pmod(F.hash("doc_id"), F.lit(splits)))
    on = [dealt[k] == renamed[f"g_{k}"] for k in keys] + [dealt["part"] == renamed["g_part"]]
    return dealt.join(renamed, on, "left").drop("part", "g_part", *[f"g_{k}" for k in keys])


def id_filter(ids: DataFrame, bits: int = 26, part_bits: int = 8) -> BitFilter:
    """A filter of fixed size that every ``doc_id`` of the table passes by its ``xxhash64``; few others do while it is not full."""
    key = F.xxhash64("doc_id")
    slots = ids.select(F.shiftrightunsigned(key, 64 - part_bits).cast("int").alias("part"), F.shiftrightunsigned(key, 64 - bits).alias("slot")).distinct()

    def mark(table: pa.Table) -> pa.Table:
        rest = table.column("slot").to_numpy().astype(np.uint64) & np.uint64((1 << (bits - part_bits)) - 1)
        segment = segment_of(rest, bits - part_bits, bits - part_bits)
        return pa.table({"part": table.column("part")[:1], "segment": pa.array([segment], pa.binary())})

    found = BitFilter(bits)
    for row in slots.groupBy("part").applyInArrow(mark, "part int, segment binary").toLocalIterator():
        found.put_part(row["part"], part_bits, row["segment"])
    return found


def only_ids(rows: DataFrame, ids: DataFrame, few: int = 200_000) -> DataFrame:
    """The rows of the given ``doc_id``s, and perhaps others, without shuffling the rows.

    Up to ``few`` ids are broadcast, counted before. Beyond, a filter of fixed size goes with the scan, which lets the
    rows of other ids pass too where it is crowded; callers join by id anyway.
    """
    if ids.count() <= few:
        return rows.join(F.broadcast(ids), "doc_id", "left_semi")
    wanted = rows.sparkSession.sparkContext.broadcast(id_filter(ids))
    kept = T.StructType([*rows.schema.fields, T.StructField("slot", T.LongType())])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column(batch.schema.get_field_index("slot")).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(wanted.value.passes(slot.view(np.uint64))))

    return rows.withColumn("slot", F.xxhash64("doc_id")).mapInArrow(pick, kept).drop("slot")


def split_by_ids(rows: DataFrame, ids: DataFrame, few: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """The rows in two parts: those of the given ``doc_id``s, and perhaps some of others, and the rest. No row is shuffled.

    ``ids`` is read more than once and should be stored; it has no repeated and no null id. Up to ``few`` ids are
    broadcast, counted before, and the first part is exact then. Beyond, a filter of fixed size goes with both scans.
    """
    if ids.count() <= few:
        sent = F.broadcast(ids.select("doc_id"))
        return rows.join(sent, "doc_id", "left_semi").select(*rows.columns), rows.join(sent, "doc_id", "left_anti").select(*rows.columns)
    wanted = rows.sparkSession.sparkContext.broadcast(id_filter(ids))

    @F.pandas_udf(T.BooleanType())
    def near(slot: pd.Series) -> pd.Series:
        return pd.Series(wanted.value.passes(slot.to_numpy().view(np.uint64)))

    passes = near(F.xxhash64("doc_id"))
    return rows.filter(passes), rows.filter(~passes)


def without_ids(rows: DataFrame, ids: DataFrame, few: int = 200_000) -> DataFrame:
    """The rows whose ``doc_id`` is not among the ids; rows without an id stay. Only rows that may go are shuffled."""
    gone = stored(ids.select("doc_id").filter("doc_id IS NOT NULL").distinct())
    some, rest = split_by_ids(rows, gone, few)
    if gone.count() <= few:
        return rest
    return rest.unionAll(some.join(gone, "doc_id", "left_anti").select(*rows.columns))


def columns_of(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def sliced(batch: pa.RecordBatch, *names: str, size: int = 512) -> Iterator[tuple]:
    """The rows of the named columns, made in slices, so that the values of a whole batch are never held at once."""
    for start in range(0, batch.num_rows, size):
        yield from zip(*columns_of(batch.slice(start, size), *names))


def peeked(batches: Iterator[pa.RecordBatch], field: str) -> tuple[pa.DataType, Iterator[pa.RecordBatch]]:
    """The Arrow type of a field, and the batches; no batch at all gives the null type."""
    first = next(batches, None)
    if first is None:
        return pa.null(), iter(())
    return first.schema.field(field).type, chain([first], batches)


def in_batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``size`` rows; long binary values and lists close a batch early."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += sum(len(v) for v in row if isinstance(v, (bytes, str, list)))
        if len(held) >= size or weight >= most_bytes:
            yield _batch(held, schema)
            held, weight = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
