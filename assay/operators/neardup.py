"""Perceptual signatures of whole grids, and all near duplicates within a Hamming radius.

A grid of any size is resampled by area to 32 x 32; the bits say which cells lie above the mean. Two signatures within
radius r agree in at least 16 - r of their 16 words, so they share one of the r + 1 rarest words of either (prefix
filter). Equal signatures are one row, and common words come last in the prefix, so neither copies nor flat pictures
make pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.kernels import area_resample
from assay.operators.common import materialize
from assay.operators.components import components
from assay.operators.grids import grid_job

SIDE, WORDS = 32, 16
TILE = 4096


def signatures(df: DataFrame, keep: list[str], side: int = SIDE) -> DataFrame:
    """(keep, signature array<long>): 1024 bits in row-major order, the first bit the highest of its word."""
    def kernel(stacks: dict[str, np.ndarray], hashes: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
        g = area_resample(stacks["grid"], side, side)
        # whole grids are compared with their own mean; sums of equal cells must not differ in the last bit
        bits = (np.round(g, 9) > np.round(g.mean((1, 2), keepdims=True), 9)).reshape(len(g), -1)
        yield {"signature": np.packbits(bits, axis=1).view(">i8").astype(np.int64)}

    return grid_job(df, ["grid"], keep, kernel, "signature array<bigint>")


def equal_groups(df: DataFrame, key: str) -> DataFrame:
    """(signature, n, first_key) of signatures that several rows share."""
    return df.groupBy("signature").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_key")).where("n > 1")


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a[:, None, :] ^ b[None, :, :]).sum(2, dtype=np.int32)


def _links(left: np.ndarray, right: np.ndarray, lids: np.ndarray, rids: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links within the radius, at most one for each union of local classes; what they connect is complete."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for at in range(0, len(left), 256):
        near = np.argwhere(_distances(left[at : at + 256], right) <= radius)
        for i, j in zip(lids[at + near[:, 0]].tolist(), rids[near[:, 1]].tolist()):
            a, b = find(i), find(j)
            if a != b:
                up[max(a, b)] = min(a, b)
                out.append((i, j))
    return out


def near_links(distinct: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """Links ``(a, b)`` between ``(id, signature)`` of distinct signatures: enough to connect all pairs within the radius.

    A word that more than ``tile`` signatures still share in their prefixes is compared in tiles of that size, so a task
    holds two tiles and returns fewer links than rows.
    """
    if not 0 <= radius < WORDS:
        raise ValueError("radius must be below the number of words")
    tokens = distinct.select("id", "signature", F.posexplode("signature").alias("at", "word"))
    common = materialize(tokens.groupBy("at", "word").agg(F.count(F.lit(1)).alias("f")).where("f > 1"))
    rare = Window.partitionBy("id").orderBy(F.coalesce("f", F.lit(1)), "at")
    ranked = tokens.select("id", "at", "word").join(common, ["at", "word"], "left").withColumn("r", F.row_number().over(rare))
    prefix = ranked.where((F.col("r") <= radius + 1) & F.col("f").isNotNull()).select("id", "at", "word")
    sizes = prefix.groupBy("at", "word").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"), F.count(F.lit(1)).alias("c")).where("c > 1")
    mine = prefix.join(sizes.drop("c"), ["at", "word"]).withColumn("t", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    held = mine.join(distinct, "id")
    # each tile goes to the tasks of all unordered tile pairs that it is in
    tasks = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.struct(F.least("t", o).alias("x"), F.greatest("t", o).alias("y")))
    spread = held.select("at", "word", "t", "id", "signature", F.inline(tasks))

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        t = table.column("t").to_numpy()
        sig = table.column("signature").combine_chunks().flatten().to_numpy().reshape(-1, WORDS).view(np.uint64)
        ids = table.column("id").to_numpy()
        x, y = t == key[2].as_py(), t == key[3].as_py()
        found = _links(sig[x], sig[y], ids[x], ids[y], radius)
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return spread.groupBy("at", "word", "x", "y").applyInArrow(compare, "a long, b long")


def near_classes(df: DataFrame, key: str, radius: int = 15, tile: int = TILE) -> DataFrame:
    """``(key, class_id, n_class)`` of all rows with a ``signature``: rows linked within the radius share the smallest key."""
    rows = materialize(df.select(F.col(key).cast("long").alias("id"), "signature"))
    groups = materialize(rows.groupBy("signature").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    links = materialize(near_links(groups.select("id", "signature"), radius, tile))
    # a link is a key that its two ends share
    name = F.concat_ws(":", F.least("a", "b"), F.greatest("a", "b"))
    edges = links.select(F.explode(F.array("a", "b")).alias("id"), F.lit("near").alias("kind"), name.alias("value")).distinct()
    roots = components(edges)
    named = groups.join(roots, "id", "left").select("signature", F.coalesce("root", "id").alias("class_id"), "n")
    sizes = named.groupBy("class_id").agg(F.sum("n").alias("n_class"))
    return rows.join(named.drop("n"), "signature").join(sizes, "class_id").select(F.col("id").alias(key), "class_id", "n_class")
