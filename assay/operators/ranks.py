"""Exact ranks and cumulative counts without a global window.

Rows collapse to cells (one per group and value) with map-side combining, so any number of equal
scores costs one cell. Cells are split over fixed value buckets; only the bucket totals, at most half a
million per group and far fewer in practice, are summed in one window. Buckets get finer towards both
ends of [0, 1] because saturated models put most of their scores there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.hashing import hash_hex
from assay.operators.common import group_key, materialize

DEPTH = 60
SPLITS = 4096


def _log_bucket(m: Column) -> Column:
    """Non-decreasing integer in m >= 0: binary exponent times SPLITS plus a slice of the mantissa."""
    tiny = F.lit(2.0**-DEPTH)
    safe = F.least(F.greatest(m, tiny), F.lit(2.0**DEPTH))
    level = F.floor(F.log2(safe)).cast("int")
    slot = F.floor((safe / F.pow(F.lit(2.0), level) - 1) * SPLITS).cast("int")
    return (level + DEPTH) * SPLITS + F.least(F.greatest(slot, F.lit(0)), F.lit(SPLITS - 1))


def score_bucket(p: Column) -> Column:
    """Bucket of a probability, fine near 0 and near 1, non-decreasing in p."""
    top = 2 * (DEPTH + 1) * SPLITS
    return F.when(p < 0.5, _log_bucket(p)).otherwise(F.lit(2 * top) - _log_bucket(F.lit(1.0) - p))


def value_bucket(v: Column) -> Column:
    """Bucket of any finite number, non-decreasing in v."""
    return F.when(v < 0, -_log_bucket(-v) - 1).otherwise(_log_bucket(v))


def scored(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """The rows that count: those with a score and a class."""
    return df.where(F.col(p).isNotNull() & F.col(y).isNotNull())


def score_cells(df: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """(by, p, n, n_pos): everything the rank metrics need, in one combined shuffle. Rows without a score or a class are left out."""
    return scored(df, y, p).groupBy(*by, F.col(p).cast("double").alias("p")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("n_pos")
    )


def accumulate(
    cells: DataFrame,
    by: list[str],
    order: list[str],
    counts: list[str],
    bucket: Column | None = None,
    keep_bucket: bool = False,
) -> DataFrame:
    """Inclusive running sums ``cum_x`` and group totals ``all_x`` of each count, in ``order``.

    ``bucket`` must be non-decreasing in the leading order column. The cells are shuffled once, by group
    and bucket; window and join share that partitioning. With ``keep_bucket`` the output still carries
    it, as ``_g`` and ``_b``, for further windows.
    """
    bucket = score_bucket(F.col(order[0])) if bucket is None else bucket
    cells = cells.select(group_key(by), *[c for c in cells.columns if c not in by], bucket.alias("_b"))
    inner = Window.partitionBy("_g", "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_g")
    totals = cells.groupBy("_g", "_b").agg(*[F.sum(c).alias(c) for c in counts])
    offsets = totals.select(
        "_g",
        "_b",
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_off_{c}") for c in counts],
        *[F.sum(c).over(whole).alias(f"all_{c}") for c in counts],
    )
    local = cells.select("*", *[F.sum(c).over(inner).alias(f"_in_{c}") for c in counts])
    out = local.join(offsets, ["_g", "_b"])
    for c in counts:
        out = out.withColumn(f"cum_{c}", F.col(f"_off_{c}") + F.col(f"_in_{c}"))
    groups = [F.col(f"_g.`{b}`").alias(b) for b in by]
    if keep_bucket:
        groups += ["_g", "_b"]
    dropped = {"_g", "_b", *[f"_off_{c}" for c in counts], *[f"_in_{c}" for c in counts]}
    return out.select(*groups, *[c for c in out.columns if c not in dropped])


def cumulative_cells(df: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """Cells with cum_n, cum_n_pos, all_n, all_n_pos in ascending score order."""
    return accumulate(score_cells(df, by, y, p), by, ["p"], ["n", "n_pos"])


def ordinal_ranks(df: DataFrame, by: list[str], y: str = "y", p: str = "p", key: str = "id") -> DataFrame:
    """Row-level ordinal ranks of the scored rows, ties broken by md5(key).

    Adds ``rank_asc``, ``rank_desc`` and ``pos_desc`` (positives up to the row in descending order), the
    tie-inclusive counts ``le_n``, ``le_pos``, the tie sizes ``eq_n``, ``eq_pos`` and the group totals.
    Ties are split by the leading hash digits, so a score shared by a third of all rows is still
    ranked by many tasks; the row-level window never holds more than one such slice. The rows are
    shuffled once, for the ranks inside the slices; the join with the slice counts keeps that partitioning.
    """
    rows = scored(df, y, p).select(
        *by,
        F.col(key).alias("id"),
        F.col(y).cast("long").alias("y"),
        (F.col(p).cast("double") + 0.0).alias("p"),
    )
    rows = rows.withColumn("_h", hash_hex(F.col("id"))).withColumn("_s", F.substring("_h", 1, 3))
    # the score as text: floating keys are normalized in every grouping and join, which would break the
    # shared partitioning and shuffle the rows again
    rows = rows.withColumn("_k", F.struct(group_key(by), F.col("p").cast("string").alias("k")))
    slices = rows.groupBy("_k", "_s").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n_pos"), F.max("p").alias("p"))
    slices = slices.select("_k._g.*", "_k", "_s", "p", "n", "n_pos") if by else slices
    run = accumulate(slices, by, ["p", "_s"], ["n", "n_pos"], keep_bucket=True)
    same = Window.partitionBy("_g", "_b", "_k")
    lower = same.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    run = run.select(
        "_k",
        "_s",
        "all_n",
        "all_n_pos",
        F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("_tie_n"),
        F.coalesce(F.sum("n_pos").over(lower), F.lit(0)).alias("_tie_pos"),
        F.max("cum_n").over(same).alias("le_n"),
        F.max("cum_n_pos").over(same).alias("le_pos"),
        F.sum("n").over(same).alias("eq_n"),
        F.sum("n_pos").over(same).alias("eq_pos"),
    )
    inside = Window.partitionBy("_k", "_s").orderBy("_h", "id")
    local = rows.select(
        "*",
        F.row_number().over(inside).alias("_rn"),
        F.sum("y").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("_rpos"),
    )
    out = local.join(run, ["_k", "_s"])
    return out.select(
        *by,
        "id",
        "y",
        "p",
        "all_n",
        "all_n_pos",
        "le_n",
        "le_pos",
        "eq_n",
        "eq_pos",
        (F.col("le_n") - F.col("eq_n") + F.col("_tie_n") + F.col("_rn")).alias("rank_asc"),
        (F.col("all_n") - F.col("le_n") + F.col("_tie_n") + F.col("_rn")).alias("rank_desc"),
        (F.col("all_n_pos") - F.col("le_pos") + F.col("_tie_pos") + F.col("_rpos")).alias("pos_desc"),
    )


def order_statistics(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Cells (by, value, n) with cum_n and all_n: pick zero-based index k as the first cell with cum_n > k."""
    cells = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return accumulate(cells, by, ["v"], ["n"], value_bucket(F.col("v")))


def _key_ranges(df: DataFrame, key: str, width: int) -> tuple[DataFrame, DataFrame]:
    """The rows with their range ``_a, _b`` of an integer key, and per range its rows ``_n`` and those before it.

    Two levels: value buckets, of which there are a bounded number however sparse the keys, and in each of them runs
    of ``width`` consecutive values, which bound a window however dense the keys.
    """
    rows = df.withColumn("_a", value_bucket(F.col(key) / 65536.0)).withColumn("_b", F.floor(F.col(key) / width))
    fine = rows.groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("_n"))
    first = Window.orderBy("_a").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    coarse = fine.groupBy("_a").agg(F.sum("_n").alias("_n")).select(
        "_a", F.coalesce(F.sum("_n").over(first), F.lit(0)).alias("_before"), F.sum("_n").over(every).alias("n_rows")
    )
    lower = Window.partitionBy("_a").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    lower = F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_lower")
    offsets = fine.select("_a", "_b", "_n", lower).join(coarse, "_a")
    return rows, offsets.select("_a", "_b", "_n", (F.col("_before") + F.col("_lower")).alias("_start"), "n_rows")


def _ranked_in_ranges(rows: DataFrame, offsets: DataFrame, key: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("_a", "_b").orderBy(key)) - 1
    out = rows.withColumn("_place", place).join(offsets.drop("_n"), ["_a", "_b"])
    return out.withColumn("row_idx", F.col("_start") + F.col("_place")).drop("_a", "_b", "_place", "_start")


def row_index(df: DataFrame, key: str, width: int = 65536) -> DataFrame:
    """Zero-based ``row_idx`` in ascending order of an integer key, and the row count ``n_rows``."""
    return _ranked_in_ranges(*_key_ranges(df, key, width), key)


def rows_at(df: DataFrame, key: str, k: int, offset: int = 0, width: int = 1024) -> DataFrame:
    """The rows at positions (offset + i * (n // k)) mod n, i < k, in ascending order of an integer key.

    The rows of each key range are counted first; only ranges that hold a wanted position, at most ``k`` of them, are
    read again and ranked. With fewer than k rows every row is taken. Rows without a key take no part; rows that share a
    key stand in no particular order.
    """
    rows, offsets = _key_ranges(df.where(F.col(key).isNotNull()), key, width)
    n, size = F.col("n_rows"), F.col("_n")
    step = F.greatest(F.lit(1), F.floor(n / k))
    back = F.pmod(F.col("_start") - F.lit(offset), n)
    turn = F.ceil(back / step)
    # wanted rows lie at whole steps behind the offset; a range that passes the offset holds the first of them
    holds = ((turn < k) & (turn * step - back < size)) | (back + size > n)
    wanted = materialize(offsets.where(holds))
    found = _ranked_in_ranges(rows.join(wanted.select("_a", "_b"), ["_a", "_b"], "left_semi"), wanted, key)
    back = F.pmod(F.col("row_idx") - F.lit(offset), n)
    return found.where((back % step == 0) & (back / step < k)).drop("row_idx", "n_rows")
