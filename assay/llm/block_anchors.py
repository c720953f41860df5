"""Substring deduplication on fixed-block anchors.

Every document is cut into non-overlapping blocks of half a window. Any window of 2b - 1 words holds one whole block
of b words, so a window that occurs twice has a block that some rolling run of b words elsewhere equals. Blocks are
indexed and probed with every rolling run; the windows round the blocks that were hit are then matched by a
pair of hashes of all their words, which extends the hits to the maximal exact repeats.

Runs of words travel as packed hashes. Blocks of documents ("flushes") ask the index about their distinct hashes and
get the repeated ones back, so that a passage shared by a third of all documents is one entry per flush.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.llm.tables import columns_of, in_batches, named, peeked, shuffle_width, stored
from assay.llm.wordhash import BitFilter, by_part, packed, part_bits, rest_of, rolled, segment_of, unpacked, word_hashes

REST = 30  # bits of a run's hash that travel beside its part; what collides is only a needless candidate
TWICE = 0xFFFFFFFF
SECOND, EXTRA = 0x5851F42D4C957F2D, 2  # seed of the second hash of a window, and the bytes of it that travel


class _Flush:
    """Documents taken together: the hashes of all their words and each word's place in its document."""

    def __init__(self, docs: list[tuple]):
        self.docs = docs
        sizes = np.array([len(d[3]) for d in docs], np.int64)
        self.hash = np.concatenate([d[3] for d in docs])
        self.start = np.cumsum(sizes) - sizes
        at = np.arange(len(self.hash))
        self.offset = at - np.repeat(self.start, sizes)
        self.left = np.repeat(self.start + sizes, sizes) - at
        self.size = np.repeat(sizes, sizes)


def _flushes(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[_Flush]:
    held, weight = [], 0
    for batch in batches:
        for doc, text in zip(*columns_of(batch, "doc_id", "text")):
            data = text.encode("utf-8", "replace")
            words = word_hashes(data)
            held.append((doc, text, data, words))
            weight += len(words) + 8
            if weight >= most:
                yield _Flush(held)
                held, weight = [], 0
    if held:
        yield _Flush(held)


def _distinct(keys: np.ndarray, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts keys, or pairs of keys, where each distinct one begins, and how often it occurs."""
    order = np.argsort(keys, kind="stable") if more is None else np.lexsort((more, keys))
    other = np.ones(len(keys), bool)
    other[1:] = np.diff(keys[order]) != 0
    if more is not None:
        other[1:] |= np.diff(more[order]) != 0
    first = np.flatnonzero(other)
    return order, first, np.diff(np.append(first, len(keys)))


def _repeated_blocks(rows: DataFrame, window: int, block: int, most: int, bits: int, filter_bits: int) -> BitFilter:
    """A filter that every block passes whose words also start anywhere else."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("runs", pa.binary())])

        def runs():
            for flush in _flushes(batches, most):
                there = (flush.left >= block) & (flush.size >= window)
                keys, anchor = rolled(flush.hash, block)[there], (flush.offset % block == 0)[there]
                order, first, count = _distinct(keys)
                keys = keys[order[first]]
                anchor = np.maximum.reduceat(anchor[order].astype(np.uint64), first) if len(first) else np.zeros(0, np.uint64)
                entry = rest_of(keys, bits, REST) << np.uint64(2) | anchor << np.uint64(1) | (count > 1).astype(np.uint64)
                for part, own in by_part(keys, bits):
                    yield part, packed(entry[own], 4)

        yield from in_batches(runs(), schema)

    def match(table: pa.Table) -> pa.Table:
        entry = np.sort(np.concatenate([unpacked(b.as_py(), 4) for b in table.column("runs")]))
        rest = entry >> np.uint64(2)
        first = np.flatnonzero(np.concatenate([[True], rest[1:] != rest[:-1]]))
        count = np.diff(np.append(first, len(rest))) + np.maximum.reduceat(entry & np.uint64(1), first).astype(np.int64)
        hit = (count > 1) & (np.maximum.reduceat(entry >> np.uint64(1) & np.uint64(1), first) == 1)
        segment = segment_of(rest[first[hit]], REST, filter_bits - bits)
        return pa.table({"part": table.column("part")[:1], "segment": pa.array([segment], pa.binary())})

    asked = rows.mapInArrow(probe, "part int, runs binary")
    found = BitFilter(filter_bits)
    for row in asked.groupBy("part").applyInArrow(match, "part int, segment binary").toLocalIterator():
        found.put_part(row["part"], bits, row["segment"])
    return found


def _windows(rows: DataFrame, hit: BitFilter, window: int, block: int, most: int, bits: int) -> DataFrame:
    """Three kinds of rows: finished documents; documents with windows to look up; the packed hashes of a flush to a part."""
    shared = rows.sparkSession.sparkContext.broadcast(hit)
    kind = T.StructType([
        T.StructField("flush", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("asked", T.BinaryType()), rows.schema["doc_id"],
        T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("first", T.IntegerType()),
        T.StructField("places", T.BinaryType()), T.StructField("known", T.BinaryType()), T.StructField("kept_sha256", T.StringType()),
    ])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, task = shared.value, TaskContext.get().partitionId()
        doc_type, batches = peeked(batches, "doc_id")
        schema = pa.schema([
            ("flush", pa.string()), ("part", pa.int32()), ("asked", pa.binary()), ("doc_id", doc_type), ("text", pa.string()), ("n_words", pa.int64()),
            ("first", pa.int32()), ("places", pa.binary()), ("known", pa.binary()), ("kept_sha256", pa.string()),
        ])

        def found():
            for number, flush in enumerate(_flushes(batches, most)):
                name = f"{task}-{number}"
                anchored = np.flatnonzero((flush.offset % block == 0) & (flush.left >= block) & (flush.size >= window))
                marked = np.zeros(len(flush.hash) + block, bool)
                marked[anchored] = blocks.passes(rolled(flush.hash, block)[anchored])
                places = np.flatnonzero(flush.left >= window)
                places = places[marked[places + -flush.offset[places] % block]]
                keys, more = (rolled(flush.hash, window, seed)[places] for seed in (0, SECOND))
                more &= np.uint64((1 << 8 * EXTRA) - 1)
                order, first, count = _distinct(keys, more)
                known = np.zeros(len(places), bool)
                known[order] = np.repeat(count > 1, count)
                ref = np.where(count > 1, TWICE, order[first]).astype("<u4")
                keys, more = keys[order[first]], more[order[first]]
                for part, own in by_part(keys, bits):
                    asked = packed(keys[own], 7) + packed(more[own], EXTRA) + ref[own].tobytes()
                    yield name, part, asked, None, None, None, None, None, None, None
                ends = np.searchsorted(places, np.append(flush.start, len(flush.hash)))
                for i, (doc, text, data, words) in enumerate(flush.docs):
                    a, b = ends[i], ends[i + 1]
                    if a == b:
                        kept = hashlib.sha256(b" ".join(data.split())).hexdigest()
                        yield None, None, None, doc, None, len(words), None, None, None, kept
                    else:
                        at = (places[a:b] - flush.start[i]).astype("<u4").tobytes()
                        yield name, None, None, doc, text, len(words), int(a), at, np.packbits(known[a:b]).tobytes(), None

        yield from in_batches(found(), schema)

    return rows.mapInArrow(look, kind)


def _answers(asked: DataFrame) -> DataFrame:
    """``flush, refs``: for each flush the windows it asked about that also start in another flush."""

    def match(table: pa.Table) -> pa.Table:
        blobs = [b.as_py() for b in table.column("asked")]
        sizes = np.array([len(b) // (11 + EXTRA) for b in blobs])
        keys = np.concatenate([unpacked(b[: 7 * n], 7) for b, n in zip(blobs, sizes)])
        more = np.concatenate([unpacked(b[7 * n : (7 + EXTRA) * n], EXTRA) for b, n in zip(blobs, sizes)])
        refs = np.concatenate([np.frombuffer(b[(7 + EXTRA) * n :], "<u4") for b, n in zip(blobs, sizes)])
        order, first, count = _distinct(keys, more)
        often = count + np.maximum.reduceat((refs[order] == TWICE).astype(np.int64), first) > 1
        repeated = np.zeros(len(keys), bool)
        repeated[order] = np.repeat(often, count)
        repeated &= refs != TWICE
        ends = np.cumsum(sizes)
        answers = [refs[e - n : e][repeated[e - n : e]].tobytes() for n, e in zip(sizes, ends)]
        return pa.table({"flush": table.column("flush"), "refs": pa.array(answers, pa.binary())}).filter(pa.array([bool(a) for a in answers]))

    return asked.groupBy("part").applyInArrow(match, "flush string, refs binary")


def _cut(docs: DataFrame, answers: DataFrame, window: int) -> DataFrame:
    """``doc_id, n_words, n_removed, spans, kept_sha256`` of the documents with windows to look up."""
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    kind = T.StructType([
        docs.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("spans", span), T.StructField("kept_sha256", T.StringType()),
    ])

    def cut(asking: pa.Table, answered: pa.Table) -> pa.Table:
        spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        schema = pa.schema([("doc_id", asking.schema.field("doc_id").type), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", spans_type), ("kept_sha256", pa.string())])
        refs = np.concatenate([np.zeros(0, "<u4"), *[np.frombuffer(r.as_py(), "<u4") for r in answered.column("refs")]])
        refs.sort()
        out = []
        for doc in asking.to_pylist():
            places = np.frombuffer(doc["places"], "<u4")
            hit = np.unpackbits(np.frombuffer(doc["known"], np.uint8), count=len(places)).astype(bool)
            a, b = np.searchsorted(refs, [doc["first"], doc["first"] + len(places)])
            hit[refs[a:b].astype(np.int64) - doc["first"]] = True
            starts = places[hit].astype(np.int64)
            own = doc["text"].encode("utf-8", "replace").split()
            gone = np.zeros(len(own) + 1, np.int64)
            np.add.at(gone, starts, 1)
            np.add.at(gone, starts + window, -1)
            gone = np.cumsum(gone[:-1]) > 0
            edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
            kept = b" ".join([w for w, g in zip(own, gone.tolist()) if not g])
            spans = [{"start": int(s), "end": int(e)} for s, e in zip(edges[::2], edges[1::2])]
            out.append((doc["doc_id"], len(own), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
        return pa.Table.from_batches(in_batches(out, schema), schema)

    return docs.groupBy("flush").cogroup(answers.groupBy("flush")).applyInArrow(cut, kind)


def drop_repeats(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, flush_words: int = 1 << 19, filter_bits: int = 27
) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, spans, kept_sha256``.

    Words are runs of characters other than ASCII white space, unchanged. A word is removed if it lies in a window of
    ``window`` words whose sequence also starts anywhere else, in the same document or another one. ``spans`` are
    the removed words as [start, end) and ``kept_sha256`` digests the kept ones, joined by one space. Null and empty
    texts have no words; documents shorter than a window lose none. Rows without an id are left out; a row that repeats
    another one is a repeat like any other, so that both lose all their windows.

    Two windows are equal if two independent hashes of their words are, 64 and 16 bits. ``flush_words`` bounds what a task holds, or one
    document if that is longer. The filter of repeated blocks has 2**``filter_bits`` bits at any input size: if it fills
    up, more windows are looked up, with the same result.
    """
    rows, block = named(df, id_col, text_col), (window + 1) // 2
    bits = min(filter_bits - 3, part_bits(shuffle_width(df.sparkSession)))
    hit = _repeated_blocks(rows, window, block, flush_words, bits, filter_bits)
    looked = stored(_windows(rows, hit, window, block, flush_words, bits))
    asked = looked.filter("part IS NOT NULL").select("part", "flush", "asked")
    docs = looked.filter("first IS NOT NULL").select("flush", "doc_id", "text", "first", "places", "known")
    cut = _cut(docs, _answers(asked), window)
    whole = looked.filter("kept_sha256 IS NOT NULL")
    none = F.array().cast(cut.schema["spans"].dataType).alias("spans")
    whole = whole.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), none, "kept_sha256")
    return whole.unionAll(cut)
