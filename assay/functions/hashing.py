"""Deterministic pseudo-randomness from md5: the same draw on every engine, partitioning and retry."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(part) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))


def hash_hex(*parts) -> Column:
    """md5 of the parts joined by ':'; sorting by it is a seeded shuffle."""
    return F.md5(F.concat_ws(":", *[_text(p) for p in parts]))


def unit_hash(*parts) -> Column:
    """Uniform number in [0, 1) with 32 bits."""
    head = F.substring(hash_hex(*parts), 1, 8)
    return F.conv(head, 16, 10).cast("double") / F.lit(4294967296.0)


def pick_index(size, *parts) -> Column:
    """Zero-based uniform index below ``size``."""
    return F.floor(unit_hash(*parts) * size).cast("int")


def normal_hash(*parts) -> Column:
    """Standard normal draw (Box-Muller on two unit hashes)."""
    u1 = F.lit(1.0) - unit_hash(*parts, "r")
    u2 = unit_hash(*parts, "t")
    return F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(2 * math.pi) * u2)
