"""Splitting rows by ids and dropping ids, by broadcast and by the filter, on rows without ids and repeated ones."""

import pytest
from pyspark.sql import functions as F

from assay.llm.tables import split_by_ids, stored, without_ids


@pytest.fixture(scope="module")
def rows(spark):
    made = spark.range(5000).select("id", F.when(F.col("id") % 10 > 0, F.col("id") % 4001).alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    return made.select("text", "doc_id", F.lit(1).alias("slot"), "id").repartition(4)


@pytest.mark.parametrize("few", [0, 200_000])
@pytest.mark.parametrize("gone", ["id % 3 = 0", "id < 0", "id >= 0"])
def test_ids_are_dropped_and_nothing_else(spark, rows, few, gone):
    ids = spark.range(-50, 5000).filter(gone).select(F.when(F.col("id") != 7, F.col("id")).alias("doc_id"), F.lit("x").alias("text"))
    dropped = {r["doc_id"] for r in ids.collect() if r["doc_id"] is not None}
    got = without_ids(rows, ids.unionAll(ids), few)
    assert got.columns == rows.columns
    want = sorted(r["id"] for r in rows.collect() if r["doc_id"] is None or r["doc_id"] not in dropped)
    assert sorted(r["id"] for r in got.collect()) == want
    assert without_ids(rows.limit(0), ids, few).count() == 0


@pytest.mark.parametrize("few", [0, 200_000])
def test_both_parts_are_all_rows(spark, rows, few):
    ids = stored(spark.range(0, 4000, 40).select(F.col("id").alias("doc_id")))
    some, rest = (part.collect() for part in split_by_ids(rows, ids, few))
    wanted = {r["doc_id"] for r in ids.collect()}
    assert sorted(r["id"] for r in some + rest) == list(range(5000))
    assert not any(r["doc_id"] in wanted for r in rest)
    assert len(some) < 2 * sum(r["doc_id"] in wanted for r in some) + 100


def test_batches_are_read_in_slices():
    import pyarrow as pa

    from assay.llm.tables import sliced

    batch = pa.RecordBatch.from_arrays([pa.array(range(1300)), pa.array([None if i % 3 else str(i) for i in range(1300)])], ["doc_id", "text"])
    assert list(sliced(batch, "text", "doc_id")) == [(None if i % 3 else str(i), i) for i in range(1300)]
    assert list(sliced(batch.slice(7, 1), "doc_id")) == [(7,)]
    assert list(sliced(batch.slice(0, 0), "doc_id")) == []
