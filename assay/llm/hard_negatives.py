"""Hard negatives by the threshold algorithm over sorted lists, one list a dimension.

Candidates are dealt to blocks; a block sorts its rows once for each dimension. An anchor goes down every list from the
end that its sign prefers, in steps that double. Each row met is scored at once from its whole vector (random access);
the products of the anchor with the last values met bound all rows not yet met. An anchor leaves a block as soon as that
bound is strictly below what its windows still need, so ties are complete and the smaller ids can win them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.llm.tables import stored

STEP = 32


def quantized(vectors: pa.ChunkedArray, scale: int, width: int = 0) -> np.ndarray:
    """``floor(scale * x)`` of a column of vectors as a matrix of whole numbers; missing components are 0.

    Doubles where all inner products of such rows are exact in them, Python integers otherwise.
    """
    lists = vectors.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = max([width, *sizes])
    with np.errstate(over="ignore"):
        scaled = np.floor(flat * scale)
    if not np.all(np.isfinite(scaled)) or np.max(np.abs(scaled), initial=0) ** 2 * max(1, width) >= 2**52:
        scaled = np.array([int(s) if np.isfinite(s) else int(x) * scale for s, x in zip(scaled, flat)], object)
    if len(sizes) and np.all(sizes == width):
        return scaled.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), scaled.dtype)
    out[np.arange(width) < sizes[:, None]] = scaled
    return out


class SortedLists:
    """The rows of a block, and for each dimension their order by its value."""

    def __init__(self, rows: np.ndarray):
        self.rows, self.order = rows, np.argsort(rows, axis=0, kind="stable").astype(np.int32)

    def descend(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int | float | None]]:
        """Rows newly met, their scores, and a bound on the score of every row not met; None when all are met."""
        n, (up, down) = len(self.rows), (np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0))
        met, depth, step = np.zeros(n, bool), 0, STEP
        while depth < n and (len(up) or len(down)):
            end = min(n, depth + step)
            fresh = np.zeros(n, bool)
            fresh[self.order[n - end : n - depth][:, up]] = True
            fresh[self.order[depth:end][:, down]] = True
            fresh &= ~met
            met |= fresh
            new = np.flatnonzero(fresh)
            bound = anchor[up] @ self.rows[self.order[n - end, up], up] + anchor[down] @ self.rows[self.order[end - 1, down], down]
            if met.all():
                break
            yield new, self.rows[new] @ anchor, bound
            depth, step = end, 2 * step
        else:
            new = np.flatnonzero(~met)
        yield new, self.rows[new] @ anchor, None


def _best(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> list[int]:
    """Places of the ``k`` first by score downward and id upward."""
    if len(scores) > k:
        least = scores[np.argpartition(scores, len(scores) - k)[len(scores) - k]] if scores.dtype != object else sorted(scores)[-k]
        among = np.flatnonzero(scores >= least)
    else:
        among = np.arange(len(scores))
    return sorted(among.tolist(), key=lambda i: (-scores[i], ids[rows[i]]))[:k]


def first_in(lists: SortedLists, anchor: np.ndarray, allowed: np.ndarray, ids: np.ndarray, windows: list[tuple], k: int) -> list[list[tuple]]:
    """For each window ``(low, high)`` of scores its first ``k`` allowed rows as ``(row, score)``; an end may be None."""
    rows, scores = np.zeros(0, np.int64), np.zeros(0, lists.rows.dtype)
    inside = lambda s, w: (w[0] is None or s >= w[0]) & (w[1] is None or s <= w[1]) if w[0] is not None or w[1] is not None else np.ones(len(s), bool)
    for new, got, bound in lists.descend(anchor):
        keep = allowed[new]
        rows, scores = np.concatenate([rows, new[keep]]), np.concatenate([scores, got[keep]])
        if bound is None:
            break
        open_windows = False
        for w in windows:
            if (w[0] is not None and (bound < w[0] or w[1] < w[0])):
                continue
            held = scores[inside(scores, w).astype(bool)]
            if len(held) < k or not bound < (np.partition(held, len(held) - k)[len(held) - k] if held.dtype != object else sorted(held)[-k]):
                open_windows = True
                break
        if not open_windows:
            break
    out = []
    for w in windows:
        at = np.flatnonzero(inside(scores, w).astype(bool))
        out.append([(int(rows[at[i]]), int(scores[at[i]])) for i in _best(rows[at], scores[at], ids, k)])
    return out


def _dealt(rows: DataFrame, per_block: int, key: list[str]) -> DataFrame:
    """Rows with ``block``; a key of n rows has about n / per_block blocks, whatever its size."""
    sizes = rows.groupBy(*key).agg(F.ceil(F.count("*") / per_block).alias("blocks"))
    return rows.join(sizes, key).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")))


def hard_negatives(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    every: int = 100, scale: int = 256, n_positives: int = 5, n_negatives: int = 10,
    low: int = 30, high: int = 90, block_rows: int = 16384, anchor_rows: int = 1024,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of every anchor.

    Components become ``floor(scale * x)``; a score is the whole-number inner product with the anchor. Higher scores come
    first, ties by smaller id. Anchors are the rows whose id is divisible by ``every``; their positives are the first
    ``n_positives`` other rows of their label; for each, the first ``n_negatives`` rows of other labels with
    ``low * positive <= 100 * negative <= high * positive`` are returned. An anchor without positives, or a positive
    without such rows, has no row in the result.

    Rows without id, label or vector, or with a component that is null or not finite, take no part. A vector shorter than
    another counts as filled up with zeros. Every row counts for itself: rows that repeat an id are other rows, as
    anchors too. An empty table gives an empty result. Scores beyond a long fail rather than wrap.

    Anchors, one row in ``every``, meet all rows in blocks: tasks of ``anchor_rows`` by ``block_rows`` (both hold on
    average). A task returns at most ``n_positives``, or ``n_positives * n_negatives``, rows for each anchor.
    """
    vec = F.col(f"`{vector_col}`")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull() & vec.isNotNull()
    picked = df.filter(whole).filter(fine).select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"), vec.alias("vec")
    )
    rows = stored(picked.withColumn("row", F.monotonically_increasing_id()))
    anchors = rows.filter(F.col("id") % every == 0).select(*[F.col(c).alias(c) for c in rows.columns])

    own = _dealt(rows, block_rows, ["label"])
    spans = own.select("label", "blocks").distinct()
    keyed = _dealt(anchors, anchor_rows, ["label"]).withColumnsRenamed({"block": "part", "blocks": "parts"})
    to_own = keyed.join(spans, "label").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    from_own = own.join(keyed.select("label", "parts").distinct(), "label").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    task = ["label", "part", "block"]

    def positives(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for i, anchor, lists, names, ids in _blocks(left, right, scale):
            allowed = names != left.column("row")[i].as_py()
            (best,) = first_in(lists, anchor, allowed, ids, [(None, None)], n_positives)
            out += [(left.column("row")[i].as_py(), int(names[r]), int(ids[r]), s) for r, s in best]
        return _table(out, ("anchor", "other", "id", "score"))

    found = to_own.select(*task, "row", "vec").groupBy(*task).cogroup(from_own.select(*task, "row", "id", "vec").groupBy(*task))
    found = found.applyInArrow(positives, "anchor long, other long, id long, score long")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id", "other")
    firsts = stored(found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= n_positives))
    wanted = firsts.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("nth", "score"))).alias("positives"))

    n_blocks = max(1, -(-rows.count() // block_rows))
    n_parts = max(1, -(-anchors.count() // anchor_rows))
    all_blocks, all_parts = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (n_blocks, n_parts))
    asking = anchors.join(wanted, anchors["row"] == wanted["anchor"]).withColumn("part", F.pmod(F.xxhash64("row"), F.lit(n_parts)))
    asking = asking.withColumn("block", all_blocks).select("part", "block", "row", "label", "vec", "positives")
    asked = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int")).withColumn("part", all_parts)
    asking, asked = asking.withColumn("part", F.col("part").cast("int")), asked.select("part", "block", "id", "row", "label", "vec")

    def negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        out, labels = [], right.column("label").to_numpy(zero_copy_only=False) if right.num_rows else None
        for i, anchor, lists, names, ids in _blocks(left, right, scale):
            wished = left.column("positives")[i].as_py()
            windows = [(-(-low * p["score"] // 100), high * p["score"] // 100) for p in wished]
            best = first_in(lists, anchor, labels != left.column("label")[i].as_py(), ids, windows, n_negatives)
            a = left.column("row")[i].as_py()
            out += [(a, p["nth"], int(ids[r]), s) for p, got in zip(wished, best) for r, s in got]
        return _table(out, ("anchor", "nth", "negative_id", "negative_score"))

    got = asking.groupBy("part", "block").cogroup(asked.groupBy("part", "block")).applyInArrow(negatives, "anchor long, nth long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor", "nth").orderBy(F.desc("negative_score"), "negative_id")
    ranked = got.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n_negatives)
    named = firsts.withColumn("nth", F.col("nth").cast("long")).withColumnsRenamed({"id": "positive_id", "score": "positive_score"}).drop("other")
    ids = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    out = ranked.join(named, ["anchor", "nth"]).join(ids, "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _blocks(left: pa.Table, right: pa.Table, scale: int):
    """Each anchor of a task with the sorted lists of its block; nothing if either side has no row."""
    if not left.num_rows or not right.num_rows:
        return
    width = max(max(np.diff(t.column("vec").combine_chunks().offsets.to_numpy()), default=0) for t in (left, right))
    anchors, rows = quantized(left.column("vec"), scale, width), quantized(right.column("vec"), scale, width)
    limit = max(np.max(np.abs(anchors), initial=0), np.max(np.abs(rows), initial=0))
    if object in (anchors.dtype, rows.dtype) or int(limit) ** 2 * max(1, width) >= 2**52:
        exact = np.frompyfunc(int, 1, 1)
        anchors, rows = exact(anchors).astype(object), exact(rows).astype(object)
    lists = SortedLists(rows)
    names, ids = right.column("row").to_numpy(), right.column("id").to_numpy()
    for i in range(left.num_rows):
        yield i, anchors[i], lists, names, ids


def _table(rows: list[tuple], names: tuple) -> pa.Table:
    columns = zip(*rows) if rows else [[]] * len(names)
    return pa.table({n: pa.array(list(c), pa.int64()) for n, c in zip(names, columns)})
