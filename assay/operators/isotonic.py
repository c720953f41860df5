"""Isotonic regression over score cells as distributed pooling of adjacent violators.

Cells are dealt to ranges of the score and pooled inside each range. Pooling may be done in any order, so the blocks that
are left are dealt to ranges anew, with other borders, until no two neighbours violate the order. A range never holds
more than ``cap`` blocks, and blocks become few quickly, so there are two or three rounds; a fit that keeps all of its
cells apart ends after the first. Many fits are pooled in the same rounds. Blocks and knots stay tables.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.operators.common import materialize
from assay.operators.ranks import score_bucket

CAP = 50_000
_BLOCKS = "fit int, range long, k int, lo double, hi double, n long, s long"


def _pooled(key: tuple, table: pa.Table) -> pa.Table:
    """Blocks of one range: neighbours whose means do not rise are united; exact, on whole numbers."""
    rows = table.sort_by("lo")
    out: list[list] = []
    for lo, hi, n, s in zip(*[rows.column(c).to_pylist() for c in ("lo", "hi", "n", "s")]):
        while out and out[-1][3] * n >= s * out[-1][2]:
            last = out.pop()
            lo, n, s = last[0], n + last[2], s + last[3]
        out.append([lo, hi, n, s])
    lo, hi, n, s = zip(*out)
    size = len(out)
    made = [[key[0].as_py()] * size, [key[1].as_py()] * size, range(size), lo, hi, n, s]
    types = (pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
    names = ("fit", "range", "k", "lo", "hi", "n", "s")
    return pa.table({c: pa.array(v, t) for c, v, t in zip(names, made, types)})


def pool(cells: DataFrame, cap: int = CAP) -> DataFrame:
    """Blocks ``fit, lo, hi, n, s`` of the isotonic fits over ``fit, p, n, s`` (rows and positives of a score)."""
    ranges = max(1, -(-cells.count() // cap))
    dealt = cells.select("fit", F.col("p").alias("lo"), F.col("p").alias("hi"), "n", "s").repartitionByRange(ranges, "fit", "lo")
    dealt = dealt.withColumn("range", F.spark_partition_id().cast("long"))
    blocks = materialize(dealt.groupBy("fit", "range").applyInArrow(_pooled, _BLOCKS))
    shift = 0
    while True:
        block = F.struct("n", "s")
        edges = blocks.groupBy("fit", "range").agg(
            F.count(F.lit(1)).alias("m"), F.min_by(block, "k").alias("first"), F.max_by(block, "k").alias("last")
        )  # one row a range
        order = Window.partitionBy("fit").orderBy("range")
        after = F.lead("first").over(order)
        wide = lambda a, b: a.cast("decimal(19,0)") * b.cast("decimal(19,0)")
        broken = wide(F.col("last.s"), after["n"]) >= wide(after["s"], F.col("last.n"))
        before = F.coalesce(F.sum("m").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        edges = materialize(edges.select("fit", "range", before.alias("before"), broken.alias("broken")))
        if edges.where("broken").isEmpty():
            return blocks.drop("range", "k")
        place = F.floor((F.col("before") + F.col("k") + shift) / cap)
        dealt = blocks.join(edges.drop("broken"), ["fit", "range"]).select("fit", "lo", "hi", "n", "s", place.alias("range"))
        blocks = materialize(dealt.groupBy("fit", "range").applyInArrow(_pooled, _BLOCKS))
        shift = cap // 2 - shift


def knots_of(blocks: DataFrame) -> DataFrame:
    """``fit, boundary, prediction``: both ends of each block."""
    ends = F.explode(F.array_distinct(F.array("lo", "hi"))).alias("boundary")
    return blocks.select("fit", ends, (F.col("s") / F.col("n")).alias("prediction"))


def interpolate(points: DataFrame, knots: DataFrame) -> DataFrame:
    """Adds ``p_cal`` to distinct ``fit, p``: linear between the knots on both sides, the nearest knot outside.

    Points and knots meet in fixed value buckets; the last knot before and the first one after a bucket come from one row
    a bucket. So neither side is broadcast, and the windows hold single buckets.
    """
    knot = F.struct(F.col("boundary").alias("x"), F.col("prediction").alias("v"))
    ours = knots.select("fit", F.col("boundary").alias("p"), knot.alias("knot"), F.lit(None).cast("boolean").alias("asked"))
    kind = ours.schema["knot"].dataType.simpleString()
    asked = points.select("fit", F.col("p").cast("double").alias("p"), F.lit(None).cast(kind).alias("knot"), F.lit(True).alias("asked"))
    rows = ours.unionByName(asked).withColumn("bucket", score_bucket(F.col("p")))
    ends = rows.groupBy("fit", "bucket").agg(F.min("knot").alias("first"), F.max("knot").alias("last"))
    order = Window.partitionBy("fit").orderBy("bucket")
    left = F.last("last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    # what follows is what precedes in descending order: a frame that ends at the last row is summed anew for every row
    back = Window.partitionBy("fit").orderBy(F.desc("bucket"))
    right = F.last("first", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select("fit", "bucket", left.alias("far_left"), right.alias("far_right"))
    inside = Window.partitionBy("fit", "bucket").orderBy("p")
    below = F.last("knot", ignorenulls=True).over(inside.rangeBetween(Window.unboundedPreceding, 0))
    falling = Window.partitionBy("fit", "bucket").orderBy(F.desc("p"))
    above = F.last("knot", ignorenulls=True).over(falling.rangeBetween(Window.unboundedPreceding, 0))
    near = rows.select("fit", "bucket", "p", "asked", below.alias("near_left"), above.alias("near_right")).where("asked")
    both = near.join(ends, ["fit", "bucket"]).select(
        "fit", "p", F.coalesce("near_left", "far_left").alias("a"), F.coalesce("near_right", "far_right").alias("b")
    )
    a, b = F.col("a"), F.col("b")
    slope = (F.col("p") - a["x"]) / (b["x"] - a["x"])
    between = F.when(b["x"] > a["x"], a["v"] + (b["v"] - a["v"]) * slope).otherwise(a["v"])
    return both.select("fit", "p", F.coalesce(between, a["v"], b["v"]).alias("p_cal"))


@dataclass
class Isotonic:
    """A single fit: ``knots`` is the table ``boundary, prediction``."""

    knots: DataFrame

    def transform(self, df: DataFrame, p: str = "p") -> DataFrame:
        """Adds ``p_cal``; rows without a score have none. Each distinct score is looked up once."""
        points = df.where(F.col(p).isNotNull()).select(F.lit(0).alias("fit"), F.col(p).cast("double").alias("p")).distinct()
        # as text: floating keys are normalized in joins
        found = interpolate(points, self.knots.withColumn("fit", F.lit(0))).select(F.col("p").cast("string").alias("_k"), "p_cal")
        keyed = df.withColumn("_k", (F.col(p).cast("double") + 0.0).cast("string"))
        return keyed.join(found, "_k", "left").drop("_k")


def training_cells(df: DataFrame, folds: int, fold: Column, y: str = "y", p: str = "p") -> tuple[DataFrame, DataFrame]:
    """``(held, train)`` cells ``fit, p, n, s`` of all folds from one aggregate of the rows.

    Each score is one row with the counts of every fold; a training set is the total minus its fold. Fit ``folds`` trains
    on everything. Rows without a score or a class take no part.
    """
    rows = df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    rows = rows.select((F.col(p).cast("double") + 0.0).alias("p"), F.col(y).cast("long").alias("y"), fold.alias("fold"))
    counts = [F.count_if(F.col("fold") == k).alias(f"n{k}") for k in range(folds)]
    sums = [F.sum(F.when(F.col("fold") == k, F.col("y")).otherwise(0)).alias(f"s{k}") for k in range(folds)]
    wide = materialize(rows.groupBy("p").agg(*counts, *sums))
    cell = lambda k, n, s: F.struct(F.lit(k).alias("fit"), n.alias("n"), s.alias("s"))
    n, s = [F.col(f"n{k}") for k in range(folds)], [F.col(f"s{k}") for k in range(folds)]
    all_n, all_s = sum(n[1:], n[0]), sum(s[1:], s[0])
    out = []
    for cells in (
        [cell(k, n[k], s[k]) for k in range(folds)],
        [*[cell(k, all_n - n[k], all_s - s[k]) for k in range(folds)], cell(folds, all_n, all_s)],
    ):
        out.append(wide.select("p", F.inline(F.array(*cells))).where("n > 0").select("fit", "p", "n", "s"))
    return out[0], out[1]
