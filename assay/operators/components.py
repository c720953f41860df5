"""Connected components of rows that share keys, and splits that keep components whole."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.hashing import hash_hex
from assay.operators.common import bounded_rows, materialize

SLICE_DIGITS = 3


def keyed_edges(df: DataFrame, key: str, groups: list[str]) -> DataFrame:
    """``(id, kind, value)`` of every row and each of its group keys; null and empty keys link nothing."""
    pairs = F.array(*[F.struct(F.lit(g).alias("kind"), F.col(g).cast("string").alias("value")) for g in groups])
    rows = df.select(F.col(key).alias("id"), F.inline(pairs))
    return rows.where(F.coalesce(F.col("value") != "", F.lit(False)) & F.col("id").isNotNull()).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(id, root)`` of all ids of ``(id, kind, value)``: ids that share a value of a kind, directly or not, share the root.

    Edges stay bipartite: a key that a third of all rows share costs one edge a row and one combined minimum, never a
    pair. In each round every id hooks to the smallest id among its keys, the trees are flattened, and edges are
    rewritten to roots, which merges the rows of a hub into one. The number of roots at least halves where any are left.
    """
    left = materialize(edges.select("id", F.struct("kind", "value").alias("k")))
    roots = materialize(left.select("id", F.col("id").alias("root")).distinct())
    while True:
        least = left.groupBy("k").agg(F.min("id").alias("m"), F.max("id").alias("most")).where("m < most").drop("most")
        open_edges = materialize(left.join(least, "k"))
        if open_edges.isEmpty():
            return roots
        tree = materialize(open_edges.groupBy("id").agg(F.min("m").alias("up")))
        while True:
            above = tree.select(F.col("id").alias("up"), F.col("up").alias("next"))
            higher = tree.join(above, "up").select("id", F.col("next").alias("up"), (F.col("next") < F.col("up")).alias("moved"))
            tree = materialize(higher)
            if tree.where("moved").isEmpty():
                break
            tree = tree.drop("moved")
        tree = tree.select("id", "up")
        moved = tree.select(F.col("id").alias("root"), "up")
        roots = materialize(roots.join(moved, "root", "left").select("id", F.coalesce("up", "root").alias("root")))
        left = materialize(open_edges.select("id", "k").join(tree, "id").select(F.col("up").alias("id"), "k").distinct())


def with_component(df: DataFrame, key: str, groups: list[str]) -> DataFrame:
    """The rows with ``component``; a row that shares nothing is its own."""
    found = components(keyed_edges(df, key, groups)).select(F.col("id").alias("_id"), "root")
    return df.join(found, F.col(key) == F.col("_id"), "left").withColumn("component", F.coalesce("root", key)).drop("_id", "root")


def split_components(
    df: DataFrame, component: str, shares: dict[str, float], stratum: Column, seed=0, large: float = 0.001
) -> DataFrame:
    """``(component, split)``: whole components dealt so that every stratum is shared out.

    Components of at least ``large`` of all rows, ``1 / large`` of them at most, are dealt one by one, the largest first,
    each to the split that then misses most rows. The others are laid out in hash order within the stratum of most of
    their rows, and the splits take what they still miss as stretches of that order. A split of ``k`` misses or exceeds
    its share of all rows by less than the largest component plus ``k`` small ones for each stratum.
    """
    names = list(shares)
    rows = df.select(F.col(component).alias("component"), stratum.cast("string").alias("stratum"))
    sizes = rows.groupBy("component", "stratum").agg(F.count(F.lit(1)).alias("n"))
    whole = sizes.groupBy("component").agg(F.sum("n").alias("size"), F.max_by("stratum", F.struct("n", "stratum")).alias("stratum"))
    whole = materialize(whole)
    total = whole.agg(F.sum("size")).first()[0] or 0
    least = max(2, int(total * large))
    missing = {s: shares[s] * total for s in names}
    dealt = []
    giants = bounded_rows(whole.where(F.col("size") >= least), int(1 / large) + 1)
    queue = [(-missing[s], i, s) for i, s in enumerate(names)]
    heapq.heapify(queue)
    for r in sorted(giants, key=lambda r: (-r["size"], str(r["component"]))):
        need, i, s = heapq.heappop(queue)
        dealt.append((r["component"], s))
        missing[s] = -need - r["size"]
        heapq.heappush(queue, (-missing[s], i, s))
    wanted = {s: max(0.0, v) for s, v in missing.items()}
    scale = sum(wanted.values()) or 1.0

    small = whole.where(F.col("size") < least).withColumn("h", hash_hex(seed, F.col("component")))
    small = small.withColumn("slice", F.substring("h", 1, SLICE_DIGITS))
    slices = small.groupBy("stratum", "slice").agg(F.sum("size").alias("m"))
    before = Window.partitionBy("stratum").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select(
        F.coalesce("stratum", F.lit("")).alias("_s"), F.col("stratum").isNull().alias("_n"), F.col("slice").alias("_slice"),
        F.coalesce(F.sum("m").over(before), F.lit(0)).alias("offset"), F.sum("m").over(Window.partitionBy("stratum")).alias("all"),
    )
    inner = Window.partitionBy("stratum", "slice").orderBy("h", "component").rowsBetween(Window.unboundedPreceding, 0)
    local = small.withColumn("upto", F.sum("size").over(inner))
    same = (F.coalesce("stratum", F.lit("")) == F.col("_s")) & (F.col("stratum").isNull() == F.col("_n")) & (F.col("slice") == F.col("_slice"))
    placed = local.join(offsets, same).withColumn("mid", (F.col("offset") + F.col("upto") - F.col("size") / 2) / F.col("all"))
    chosen = _stretch(F.col("mid"), [(s, wanted[s] / scale) for s in names])
    out = placed.select("component", chosen.alias("split"))
    if not dealt:
        return out
    kind = whole.schema["component"].dataType.simpleString()
    return out.unionByName(df.sparkSession.createDataFrame(dealt, f"component {kind}, split string"))


def _stretch(at: Column, parts: list[tuple[str, float]]) -> Column:
    """The name of the stretch of [0, 1] that holds a place."""
    ends = [sum(w for _, w in parts[: k + 1]) for k in range(len(parts))]
    out = F.lit(parts[-1][0])
    for (name, _), end in reversed(list(zip(parts, ends))[:-1]):
        out = F.when(at < end, F.lit(name)).otherwise(out)
    return out
