"""Helpers for array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind an intermediate value once; without it the optimizer may re-evaluate it per array element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)
