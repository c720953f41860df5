"""Small helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.session import scratch_dir


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` that also matches null keys. For one overall group join on a constant column."""
    if not keys:
        raise ValueError("at least one key is needed")
    renamed = right.select(*[F.col(k).alias(f"__{k}") if k in keys else F.col(k) for k in right.columns])
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__{k}"]) for k in keys])
    out = left.join(renamed, cond, how)
    return out.drop(*[f"__{k}" for k in keys]) if how not in ("left_anti", "left_semi") else out


def ratio(num: Column, den: Column) -> Column:
    """Rate with an empty denominator counted as one, so that it reads 0.0."""
    return num / F.greatest(F.lit(1), den)


def bounded_rows(df: DataFrame, limit: int) -> list:
    """Rows of a table that must be small; fails instead of truncating when it is not."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"table has more than {limit} rows; it is not a bounded dimension")
    return rows


def group_key(by: list[str]) -> Column:
    """The group columns as one struct ``_g``.

    Structs compare null fields as equal, so joins on ``_g`` keep null groups with a plain equality, which
    unlike a null-safe comparison reuses an existing partitioning by the group.
    """
    return F.struct(*[F.col(b).alias(b) for b in by] or [F.lit(0).alias("_0")]).alias("_g")


def materialize(df: DataFrame) -> DataFrame:
    """Write a small derived table to the shared scratch folder and read it back.

    Its true size is then known before the plan is made, so that Spark broadcasts it if it is under the
    broadcast threshold and the large side of a join is not shuffled for it. Lineage is cut as well.
    """
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
