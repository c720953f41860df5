"""Registration of queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without ``sql`` only its rows are checked."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column, since float sums depend on the partitioning.

    Adding zero turns -0.0 into 0.0.
    """
    kinds = dict(df.dtypes)
    return df.select(
        *[
            (F.round(F.col(c), digits) + 0.0).alias(c) if kinds[c] in ("double", "float") else F.col(c)
            for c in df.columns
        ]
    )


def r(expr: str, digits: int = 6) -> str:
    """The same rounding in SQL."""
    return f"(round({expr}, {digits}) + 0.0)"
