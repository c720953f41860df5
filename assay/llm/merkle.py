"""A Merkle manifest of a document table: one tree a language, one tree over their roots, kept as postorder logs.

A builder takes an aligned run of ``2**BITS`` leaves and appends nodes as they are completed: a leaf, then every parent
that it closes. Runs are aligned, so a run is a whole subtree and its log needs no other run; the roots of the runs are
the leaves of the next level of builders. The place of any node in such a log follows from the sizes of the subtrees
before it (:func:`place`), so a proof reads its siblings by position, without searching and without child pointers.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.llm.tables import stored

BITS = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: One step of a path: which side the sibling is on, and its digest. A lone node has no sibling.
LONE, LEFT, RIGHT, STEP = b"\0", b"\1", b"\2", 33
_LEVEL = "tree string, chunk long, n long, log binary, top binary"


def node(*children: bytes) -> bytes:
    """SHA-256 over the children's digests as lowercase hex text."""
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def height_of(n: int) -> int:
    """Levels above the leaves until one node remains."""
    return (n - 1).bit_length()


def place(height: int, index: int, n: int) -> int:
    """Position in the log of ``n`` leaves of the node ``index`` (from 0) on a level.

    A node over complete leaves comes right after its last leaf ``e`` and the lower parents that ``e`` closes; before
    leaf ``e`` lie ``2e - popcount(e)`` nodes. Nodes at the ragged right edge are completed last, from the lowest up.
    """
    if (index + 1) << height <= n:
        last = ((index + 1) << height) - 1
        return 2 * last - last.bit_count() + height
    return 2 * n - n.bit_count() + sum(1 for h in range(1, height) if n % (1 << h))


def append_nodes(leaves: list[bytes], height: int) -> list[bytes]:
    """All nodes up to the given height in the order of their completion; the last one is the root."""
    log, waiting, n = [], {}, len(leaves)
    for i, made in enumerate(leaves):
        log.append(made)
        h = 0
        while i >> h & 1:
            made = node(waiting[h], made)
            log.append(made)
            h += 1
        waiting[h] = made
    edge = None
    for h in range(height):
        if n % (1 << (h + 1)) == 0:
            continue
        odd = n >> h & 1
        edge = node(*([waiting[h]] if odd else []), *([edge] if edge is not None else []))
        log.append(edge)
    return log


def path_in(log: bytes, i: int, n: int, height: int) -> bytes:
    """The steps from leaf ``i`` to the root of a log, each sibling read at its closed-form position."""
    steps = []
    for h in range(height):
        other = (i >> h) ^ 1
        if other << h < n:
            at = 32 * place(h, other, n)
            steps.append((LEFT if i >> h & 1 else RIGHT) + log[at : at + 32])
        else:
            steps.append(LONE + bytes(32))
    return b"".join(steps)


def folded(leaf: bytes, path: bytes) -> bytes:
    for at in range(0, len(path), STEP):
        side, other = path[at : at + 1], path[at + 1 : at + STEP]
        leaf = node(leaf) if side == LONE else node(other, leaf) if side == LEFT else node(leaf, other)
    return leaf


def siblings(path: bytes) -> bytes:
    """The digests of a path without the lone steps, in order."""
    return b"".join(path[at + 1 : at + STEP] for at in range(0, len(path), STEP) if path[at : at + 1] != LONE)


def indexed(rows: DataFrame, order: list[str], per_range: int = 100_000) -> DataFrame:
    """Rows with ``idx`` (from 0, in the given order, nulls first) and ``n`` in each ``tree``.

    Rows are dealt to ranges of the order and stored with their range; counts per range give the offsets. Neither a tree
    nor a repeated id meets in one task: the last order column should tell rows apart.
    """
    n_ranges = max(1, -(-rows.count() // per_range))
    ranged = stored(rows.repartitionByRange(n_ranges, "tree", *order).withColumn("range", F.spark_partition_id()))
    counts = ranged.groupBy("tree", "range").agg(F.count("*").alias("c"))
    before = Window.partitionBy("tree").orderBy("range")
    counts = counts.select(
        "tree", "range", F.sum("c").over(before).alias("upto"), "c", F.sum("c").over(Window.partitionBy("tree")).alias("n")
    )
    offsets = counts.select("tree", "range", (F.col("upto") - F.col("c")).alias("start"), "n")
    inside = Window.partitionBy("tree", "range").orderBy(*order)
    numbered = ranged.withColumn("r", F.row_number().over(inside))
    return numbered.join(offsets, ["tree", "range"]).withColumn("idx", F.col("start") + F.col("r") - 1).drop("r", "start", "range")


def build_levels(nodes: DataFrame, bits: int = BITS) -> list[DataFrame]:
    """The logs over ``(tree, idx, n, digest)``: a table a level, one row for each aligned run.

    A level has ``2**-bits`` of the rows of the one below, so there are two or three; every table is stored.
    """
    size = 1 << bits

    def build(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.sort_by("idx")
        n = rows.column("n")[0].as_py()
        leaves = rows.column("digest").to_pylist()
        log = append_nodes(leaves, bits if n > size else height_of(n))
        out = [[key[0].as_py()], [key[1].as_py()], [n], [b"".join(log)], [log[-1]]]
        return pa.table({c: pa.array(v, t) for c, v, t in zip(("tree", "chunk", "n", "log", "top"), out, types)})

    types = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels = []
    while True:
        chunked = nodes.withColumn("chunk", F.shiftright("idx", bits)).select("tree", "chunk", "idx", "n", "digest")
        levels.append(stored(chunked.groupBy("tree", "chunk").applyInArrow(build, _LEVEL)))
        if most <= size:
            return levels
        most = -(-most // size)
        upper = levels[-1].filter(F.col("n") > size)
        nodes = upper.select("tree", F.col("chunk").alias("idx"), F.ceil(F.col("n") / size).alias("n"), F.col("top").alias("digest"))


def tops(levels: list[DataFrame], bits: int = BITS) -> DataFrame:
    """One row a tree: its root."""
    ended = [lv.filter(F.col("n") <= 1 << bits).select("tree", F.col("top").alias("root")) for lv in levels]
    return reduce(DataFrame.unionAll, ended)


def run_paths(levels: list[DataFrame], above: DataFrame, bits: int = BITS) -> DataFrame:
    """The runs of the lowest level, each with the path from its root upward.

    ``above`` has a row a tree: ``root`` and ``path``, what follows after the tree's own root. Paths go down level by
    level: each log gives the steps of its leaves, which are the roots of the runs below.
    """
    size = 1 << bits

    def descend(batches):
        for batch in batches:
            out = {c: [] for c in ("tree", "chunk", "root", "path")}
            for tree, chunk, n, log, root, path in zip(*[batch.column(c).to_pylist() for c in ("tree", "chunk", "n", "log", "root", "path")]):
                m, height = min(size, n - (chunk << bits)), bits if n > size else height_of(n)
                out["tree"] += [tree] * m
                out["chunk"] += range(chunk << bits, (chunk << bits) + m)
                out["root"] += [root] * m
                out["path"] += [path_in(log, i, m, height) + path for i in range(m)]
            types = (pa.string(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))

    below = None
    for level in reversed(levels):
        ended = level.filter(F.col("n") <= size).join(above, "tree")
        here = ended.select("tree", "chunk", "n", "log", "root", "path")
        if below is not None:
            inner = level.filter(F.col("n") > size).join(below, ["tree", "chunk"])
            here = here.unionAll(inner.select("tree", "chunk", "n", "log", "root", "path"))
        below = here.mapInArrow(descend, "tree string, chunk long, root binary, path binary") if level is not levels[0] else here
    return below


def leaf_digest(values: dict[str, Column]) -> Column:
    """SHA-256 of the fields: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    parts = []
    for value in values.values():
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


@dataclass
class Manifest:
    """``logs`` and ``lang_logs`` hold all nodes by level, ``root`` is the digest of the table, ``leaves`` its indexed rows."""

    leaves: DataFrame
    logs: list[DataFrame]
    lang_logs: list[DataFrame]
    root: bytes | None
    lang_entries: DataFrame
    bits: int

    def verify(self) -> DataFrame:
        """One row a document: leaf, roots, the siblings of its proof, and what the claimed row folds to."""
        none = self.lang_logs[0].sparkSession.createDataFrame([("all", self.root, b"")], "tree string, root binary, path binary")
        langs = run_paths(self.lang_logs, none.limit(1 if self.root else 0), self.bits)
        above = self._leaf_paths(langs)
        return self._proved(run_paths(self.logs, above, self.bits))

    def _leaf_paths(self, langs: DataFrame) -> DataFrame:
        """Of each language: its root and the path from there to the root of all."""
        bits, size = self.bits, 1 << self.bits

        def spread(left: pa.Table, right: pa.Table) -> pa.Table:
            run = right.to_pylist()[0]
            m, height = min(size, run["n"] - (run["chunk"] << bits)), bits if run["n"] > size else height_of(run["n"])
            paths = [path_in(run["log"], i - (run["chunk"] << bits), m, height) + run["path"] for i in left.column("idx").to_pylist()]
            return pa.table({"tree": left.column("lang_tree"), "root": left.column("digest"), "path": pa.array(paths, pa.binary())})

        entries = self.lang_entries.select("tree", F.shiftright("idx", bits).alias("chunk"), "idx", "lang_tree", "digest")
        return entries.groupBy("tree", "chunk").cogroup(langs.groupBy("tree", "chunk")).applyInArrow(spread, "tree string, root binary, path binary")

    def _proved(self, runs: DataFrame) -> DataFrame:
        bits, size, total = self.bits, 1 << self.bits, self.root
        fields = "doc_id long, leaf binary, subroot binary, root binary, proof binary, folded_root binary"

        def prove(left: pa.Table, right: pa.Table) -> pa.Table:
            run = right.to_pylist()[0]
            first = run["chunk"] << bits
            m, height = min(size, run["n"] - first), bits if run["n"] > size else height_of(run["n"])
            proofs, roots = [], []
            for i, leaf, claimed in zip(*[left.column(c).to_pylist() for c in ("idx", "digest", "claimed")]):
                path = path_in(run["log"], i - first, m, height) + run["path"]
                proofs.append(siblings(path))
                roots.append(folded(leaf if claimed is None else claimed, path))
            fixed = [pa.array([v] * len(roots), pa.binary()) for v in (run["root"], total)]
            made = [left.column("doc_id"), left.column("digest"), *fixed, pa.array(proofs, pa.binary()), pa.array(roots, pa.binary())]
            return pa.table(dict(zip(("doc_id", "leaf", "subroot", "root", "proof", "folded_root"), made)))

        rows = self.leaves.select("tree", F.shiftright("idx", bits).alias("chunk"), "idx", "doc_id", "digest", "claimed")
        proved = rows.groupBy("tree", "chunk").cogroup(runs.groupBy("tree", "chunk")).applyInArrow(prove, fields)
        return proved.withColumn("verified", F.col("folded_root") == F.col("root"))

def build_manifest(docs: DataFrame, claimed: dict[str, Column] | None = None, bits: int = BITS) -> Manifest:
    """The manifest of a document table, with what its rows are ``claimed`` to hold when they are verified.

    ``claimed`` replaces fields by expressions over the columns of the table; a row that they leave as it is costs
    no second hash. A null in any field, the id included, is a value of its own, so every row is a leaf. Rows of one
    language stand in the order of ids, nulls first; rows that share an id in the order of their digests; repeated rows
    are leaves of their own. Columns other than the five fields are not read. An empty table has no root and no rows.
    """
    plain = {c: F.col(f"`{c}`") for c in FIELDS}
    changed = plain | (claimed or {})
    same = reduce(Column.__and__, [plain[c].cast("string").eqNullSafe(changed[c].cast("string")) for c in FIELDS if c in (claimed or {})], F.lit(True))
    tree = F.coalesce(F.concat(F.lit("1"), plain["lang"].cast("string")), F.lit("0"))  # null first, then bytewise
    leaves = docs.select(
        tree.alias("tree"),
        plain["doc_id"].cast("long").alias("doc_id"),
        leaf_digest(plain).alias("digest"),
        F.when(~same, leaf_digest(changed)).alias("claimed"),
        F.monotonically_increasing_id().alias("row"),
    )
    numbered = stored(indexed(stored(leaves), ["doc_id", "digest", "row"]))
    logs = build_levels(numbered, bits)
    langs = tops(logs, bits).select(F.lit("all").alias("tree"), F.col("tree").alias("lang_tree"), F.col("root").alias("digest"))
    entries = stored(indexed(langs, ["lang_tree"]))
    lang_logs = build_levels(entries, bits)
    top = tops(lang_logs, bits).first()
    return Manifest(numbered, logs, lang_logs, bytes(top["root"]) if top else None, entries, bits)
