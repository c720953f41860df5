"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.tables import stored


def components(links: DataFrame) -> DataFrame | None:
    """``id, root`` of every linked id, with the smallest id of its component; None if there is no link.

    ``links`` has ``a`` and ``b``. Every id hooks to its smallest neighbour, trees are flattened by pointer jumping,
    and the links between different trees are contracted, until none is left. Minima are combined before the shuffle.
    """
    edges = stored(links.select("a", "b").filter("a <> b").distinct())
    roots = None
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        tree = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("root")))
        while True:
            above = tree.select(F.col("id").alias("root"), F.col("root").alias("next"))
            tree = stored(tree.join(above, "root").select("id", F.col("next").alias("root"), (F.col("next") < F.col("root")).alias("moved")))
            if tree.filter("moved").isEmpty():
                break
            tree = tree.drop("moved")
        tree = tree.select("id", "root")
        if roots is None:
            roots = tree
        else:
            higher = tree.select(F.col("id").alias("root"), F.col("root").alias("next"))
            roots = roots.join(higher, "root", "left").select("id", F.coalesce("next", "root").alias("root"))
        edges = stored(contracted(edges, tree))
    return None if roots is None else stored(roots)


def contracted(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Links between different roots, each once, smaller root first. Ids without a root stand for themselves."""
    a, b = (roots.select(F.col("id").alias(c), F.col("root").alias(f"r{c}")) for c in ("a", "b"))
    joined = edges.join(a, "a", "left").join(b, "b", "left")
    ra, rb = F.coalesce("ra", "a"), F.coalesce("rb", "b")
    return joined.filter(ra != rb).select(F.least(ra, rb).alias("a"), F.greatest(ra, rb).alias("b")).distinct()
