"""Exact deduplication by distributed MSD radix partitioning.

Documents are split by their leading bytes, and every group that holds more than one document is split again by
the bytes that follow, until a group is a single document or its texts have ended. Texts are compared byte by
byte; no digest decides equality. A digit is a run of bytes that grows by a fixed factor from level to level, so
that texts of any length need only a few levels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.tables import join_groups, named, stored


def exact_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: int = 128, factor: int = 8, splits: int = 16
) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest id stays. A null text counts as empty, and all empty texts are one
    group. Rows without an id are left out. Rows that repeat an id and its text are one more copy each and get
    the same result; ids that come with different texts get one row for each. An empty table gives an empty result.

    ``first`` is the width of the first digit in bytes, ``factor`` its growth. Groups are counted with partial
    sums before the shuffle. Only groups of two or more go back to the documents, each ``splits`` times, so that
    the rows of one group are dealt to as many tasks; single documents match nothing and are finished.
    """
    level = named(df, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("rest"))
    level = level.withColumn("text_sha256", F.sha2("rest", 256))
    keys, width, done = ["digit"], first, []
    while True:
        split = stored(_split(level, keys, width, splits))
        done.append(split.filter("rest IS NULL").select("doc_id", "keep_id", "group_size", "text_sha256"))
        level = split.filter("rest IS NOT NULL").select("doc_id", "rest", "text_sha256", "path")
        if level.isEmpty():
            break
        keys, width = ["path", "digit"], width * factor
    result = done[0]
    for more in done[1:]:
        result = result.unionAll(more)
    kept = (F.col("doc_id") == F.col("keep_id")).alias("kept")
    return result.select("doc_id", "keep_id", "group_size", kept, "text_sha256")


def _split(level: DataFrame, keys: list[str], width: int, splits: int) -> DataFrame:
    """One level: finished rows have no ``rest``; the others carry the group they are in as ``path``."""
    rows = level.withColumn("digit", F.substring("rest", 1, width))
    groups = rows.groupBy(*keys).agg(F.count("*").alias("size"), F.max("doc_id").alias("last")).filter("size > 1")
    # With unique ids the largest id names a group. The hash only matters for ids that come with several texts.
    path = F.struct(F.col("last"), F.xxhash64(*keys).alias("bytes"))
    groups = groups.select(*keys, "size", "last", path.alias("next"))
    joined = join_groups(rows, groups, keys, splits)
    more = F.col("size").isNotNull() & (F.length("digit") == width)
    return joined.select(
        "doc_id",
        F.coalesce("last", "doc_id").alias("keep_id"),
        F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        "text_sha256",
        F.when(more, F.substring(F.col("rest"), width + 1, 2**31 - 1)).alias("rest"),
        F.when(more, F.col("next")).alias("path"),
    )
