"""Benchmark decontamination with a distributed positional inverted index over the training texts.

The terms of all test windows are counted over the corpus. Each window is searched by its rarest terms: their
postings (term, document, positions) are stored, lists are intersected after adjusting for the offsets in the window,
and what is left is compared with the words of the document. Phrase matches are exact; ``proximity`` finds all terms
of a query within a span of words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.llm.tables import ascii_lower, columns_of, in_batches, named, sliced, split_by_ids, stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The same on the UTF-8 bytes of a lower-cased text.
_WORD_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str) -> list[bytes]:
    return _WORD_BYTES.findall(text.encode("utf-8", "replace").lower())


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def item_windows(items: DataFrame, size: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item, window``: every run of ``size`` words of an item, or all its words if it has fewer, but not none."""
    rows = items.filter(F.col(f"`{id_col}`").isNotNull())
    rows = rows.select(F.col(f"`{id_col}`").cast("string").alias("item"), words(F.col(f"`{text_col}`")).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - F.lit(size - 1)))
    rows = rows.filter(F.size("w") > 0).select("item", "w", F.explode(starts).alias("at"))
    return rows.select("item", F.array_join(F.slice("w", F.col("at"), size), " ").alias("window")).distinct()


def _blocks(terms: DataFrame, block_terms: int) -> Iterator[frozenset[bytes]]:
    """Distinct terms in blocks of about ``block_terms``; only one block is on the driver at a time."""
    blocks = max(1, -(-terms.count() // block_terms))
    for b in range(blocks):
        part = terms.filter(F.pmod(F.xxhash64("term"), F.lit(blocks)) == b)
        yield frozenset(r["term"].encode() for r in part.toLocalIterator())


def term_counts(rows: DataFrame, terms: DataFrame, block_terms: int) -> DataFrame:
    """``term, n``: occurrences in all texts of each term that occurs."""
    context, out = rows.sparkSession.sparkContext, None
    for block in _blocks(terms, block_terms):
        wanted = context.broadcast(block)

        def count(batches: Iterator[pa.RecordBatch], wanted=wanted) -> Iterator[pa.RecordBatch]:
            schema = pa.schema([("term", pa.string()), ("n", pa.int64())])
            for batch in batches:
                found: Counter = Counter()
                for (text,) in sliced(batch, "text"):
                    found.update(words_of(text))
                yield from in_batches(((t.decode(), found[t]) for t in wanted.value & found.keys()), schema)

        counts = rows.select("text").mapInArrow(count, "term string, n bigint")
        counts = counts.groupBy("term").agg(F.sum("n").alias("n"))
        out = counts if out is None else out.unionAll(counts)
    return stored(out)


def postings(rows: DataFrame, terms: DataFrame, block_terms: int = 200_000) -> DataFrame:
    """The index as a stored table: ``term, doc_id, positions`` of the given terms in all texts."""
    context, out = rows.sparkSession.sparkContext, None
    fields = [T.StructField("term", T.StringType()), rows.schema["doc_id"]]
    kind = T.StructType([*fields, T.StructField("positions", T.ArrayType(T.IntegerType()))])
    for block in _blocks(terms, block_terms):
        wanted = context.broadcast(block)

        def post(batches: Iterator[pa.RecordBatch], wanted=wanted) -> Iterator[pa.RecordBatch]:
            block = wanted.value

            def found(ids, texts):
                for doc, text in zip(ids, texts):
                    own = words_of(text)
                    here = block.intersection(own)
                    if here:
                        at: dict[bytes, list[int]] = {t: [] for t in here}
                        for i, w in enumerate(own):
                            if w in here:
                                at[w].append(i)
                        yield from ((t.decode(), doc, p) for t, p in at.items())

            for batch in batches:
                schema = pa.schema([("term", pa.string()), batch.schema.field("doc_id"), ("positions", pa.list_(pa.int32()))])
                yield from in_batches(found(*columns_of(batch, "doc_id", "text")), schema)

        lists = rows.mapInArrow(post, kind)
        out = lists if out is None else out.unionAll(lists)
    return stored(out)


def _anchors(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Each window with its two rarest places: terms ``a, b``, their offsets, and the words between them."""
    terms = windows.select("window", F.posexplode(F.split("window", " ")).alias("at", "term"))
    order = Window.partitionBy("window").orderBy("n", "at")
    ranked = terms.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("k", F.row_number().over(order))
    picked = ranked.groupBy("window").agg(
        F.min("n").alias("rarest"),
        F.max(F.when(F.col("k") == 1, F.struct("term", "at"))).alias("a"),
        F.max(F.when(F.col("k") == 2, F.struct("term", "at"))).alias("b"),
    )
    picked = picked.filter("rarest > 0")  # a window with a term that never occurs is nowhere
    return picked.select(
        "window", F.col("a.term").alias("a"), F.col("a.at").alias("offset"), F.col("b.term").alias("b"),
        (F.col("b.at") - F.col("a.at")).alias("apart"),
    )


def candidates(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """``doc_id, at, window``: where the two rarest terms of a window stand at their distance."""
    pairs = anchors.select("a", "b", "apart").distinct()
    first = index.select(F.col("term").alias("a"), "doc_id", F.col("positions").alias("p"))
    other = index.select(F.col("term").alias("b"), "doc_id", F.col("positions").alias("q"))
    near = pairs.filter("b IS NOT NULL").join(first, "a").join(other, ["b", "doc_id"])
    both = F.array_intersect(F.transform("p", lambda x: x + F.col("apart")), F.col("q"))
    near = near.select("doc_id", "a", "b", "apart", F.explode(both).alias("q")).withColumn("p", F.col("q") - F.col("apart"))
    found = near.join(anchors, ["a", "b", "apart"]).select("doc_id", (F.col("p") - F.col("offset")).alias("at"), "window")
    alone = anchors.filter("b IS NULL").select("a", "window").join(first, "a")
    found = found.unionAll(alone.select("doc_id", F.explode("p").alias("at"), "window"))
    return found.filter("at >= 0")


def decontaminate(
    df: DataFrame,
    items: DataFrame,
    size: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_terms: int = 200_000,
) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    A document word is hit if it lies in any occurrence of a window of ``size`` consecutive words of an item; an
    item of fewer words is one window. ``n_items`` counts the items with such windows, and their ids, as sorted text
    joined by commas, give ``items_sha256``. A null text has no words; items without words, id or text have no window.
    Rows of documents without an id are left out; each row that repeats an id is judged by its own text.

    The terms of the items are sent to the scans in blocks of about ``block_terms``; everything else is joined. The
    occurrences of one document are gathered in one row, which is bounded by its length.
    """
    rows = named(df, id_col, text_col)
    item_rows = stored(item_windows(items, size, item_id, item_text))
    windows = item_rows.select("window").distinct()
    terms = windows.select(F.explode(F.split("window", " ")).alias("term")).distinct()
    anchors = stored(_anchors(windows, term_counts(rows, terms, block_terms)))
    keys = anchors.select(F.explode(F.array("a", "b")).alias("term")).filter("term IS NOT NULL").distinct()
    found = candidates(postings(rows, keys, block_terms), anchors)
    found = stored(found.groupBy("doc_id").agg(F.collect_list(F.struct("at", "window")).alias("found")))
    # only texts with candidates are shuffled to them
    some, rest = split_by_ids(rows, found)
    some, rest = some.join(found, "doc_id", "left"), rest.withColumn("found", F.lit(None).cast(found.schema["found"].dataType))
    judged = stored(_verify(some.unionByName(rest)).withColumn("row", F.monotonically_increasing_id()))
    hits = judged.select("row", F.explode("windows").alias("window")).join(item_rows, "window")
    hits = hits.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    own = F.coalesce("items", F.array().cast("array<string>"))
    return judged.join(hits, "row", "left").select(
        "doc_id", "n_words", "n_hit", F.size(own).cast("long").alias("n_items"),
        F.sha2(F.array_join(own, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def _verify(rows: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, windows``: the candidates of each text that are its words indeed."""
    fields = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("windows", T.ArrayType(T.StringType()))]
    kind = T.StructType([rows.schema["doc_id"], *[T.StructField(n, t) for n, t in fields]])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judge(ids, texts, found):
            for doc, text, places in zip(ids, texts, found):
                own = words_of(text)
                hit, seen, end = 0, set(), 0
                for place in sorted(places or (), key=lambda p: p["at"]):
                    window, at = place["window"].encode().split(b" "), place["at"]
                    if own[at : at + len(window)] == window:
                        seen.add(place["window"])
                        hit += max(0, at + len(window) - max(end, at))
                        end = max(end, at + len(window))
                yield doc, len(own), hit, sorted(seen)

        for batch in batches:
            schema = pa.schema([batch.schema.field("doc_id"), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("windows", pa.list_(pa.string()))])
            yield from in_batches(judge(*columns_of(batch, "doc_id", "text", "found")), schema)

    return rows.select("doc_id", "text", "found").mapInArrow(verify, kind)


def proximity(index: DataFrame, queries: DataFrame, span: int) -> DataFrame:
    """``query, doc_id, at, width``: documents with all terms of a query within ``span`` words, at their tightest place.

    ``queries`` has ``query`` and ``terms``, an array of words; ``index`` must hold them. Every term of a query has to
    occur; null and empty arrays match nothing. The rarest lists meet first: a document stays only if all lists have it.
    """
    wanted = queries.select("query", F.array_distinct("terms").alias("terms")).filter(F.size("terms") > 0)
    wanted = wanted.select("query", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    met = wanted.join(index, "term").groupBy("query", "n", "doc_id").agg(F.collect_list("positions").alias("lists"))
    met = met.filter(F.size("lists") == F.col("n"))
    marked = F.flatten(F.transform("lists", lambda p, i: F.transform(p, lambda x: F.struct(x.alias("at"), i.alias("list")))))
    kind = T.StructType([met.schema["query"], met.schema["doc_id"], T.StructField("at", T.IntegerType()), T.StructField("width", T.IntegerType())])

    def tightest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judge(queries, docs, counts, places):
            for query, doc, n, marks in zip(queries, docs, counts, places):
                last: dict[int, int] = {}
                best = None
                for mark in marks:
                    last[mark["list"]] = mark["at"]
                    if len(last) == n:
                        low = min(last.values())
                        best = min(best or (span + 1, 0), (mark["at"] - low + 1, low))
                if best and best[0] <= span:
                    yield query, doc, best[1], best[0]

        for batch in batches:
            schema = pa.schema([batch.schema.field("query"), batch.schema.field("doc_id"), ("at", pa.int32()), ("width", pa.int32())])
            yield from in_batches(judge(*columns_of(batch, "query", "doc_id", "n", "marks")), schema)

    return met.select("query", "doc_id", "n", F.array_sort(marked).alias("marks")).mapInArrow(tightest, kind)
