"""Jaccard self-join of documents on word shingles, exact, with connected components.

Documents with equal shingle sets are one class, and only class representatives are joined. Two linked sets share
one of the rarest shingles of each (prefix filter), and the places of the first one they share leave room for enough
others (positional filter); rows of a shingle are a set's id, size and place, and those without a partner of fitting
size are dropped in the scan of the shingle. Hashed bitmap signatures bound the overlap of the pairs by their bit counts,
short ones and then such as grow with the set, and what passes is decided by the intersection of the sorted arrays.
Since the result is components, links inside a component are not all made: every set is first compared with the likeliest
leader it shares shingles with, then components that share crowded shingles with random leaders, round by round, and
from then on only pairs of sets in different components are candidates.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.llm.components import components
from assay.llm.tables import columns_of, in_batches, join_groups, named, only_ids, sliced, stored, without_ids
from assay.llm.wordhash import mixed, rolled, word_hashes

WORDS = 5
LONGS = 16  # of the bitmap: 1024 bits
BITMAP = [f"bits{i}" for i in range(LONGS)]


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of all runs of five words, or of all words if there are fewer."""
    h = word_hashes(text.encode("utf-8", "replace"), lower=True)
    if not len(h):
        return np.zeros(0, np.int64)
    width = min(WORDS, len(h))
    runs = rolled(h, width)[: len(h) - width + 1] if width == WORDS else mixed(rolled(h, width)[:1] + np.uint64(width))
    runs = np.sort(runs.view(np.int64))
    return runs[np.concatenate([[True], runs[1:] != runs[:-1]])]


def prefix_size(n: int) -> int:
    return n - -(-4 * n // 5) + 1


def _scan(rows: DataFrame, usual: int) -> DataFrame:
    """Two kinds of rows: ``doc_id, n, set_key`` and the bitmap of every document; ``token, n`` of tokens that many of a batch have."""
    bits = [T.StructField(b, T.LongType()) for b in BITMAP]
    kind = T.StructType([rows.schema["doc_id"], T.StructField("n", T.LongType()), T.StructField("set_key", T.BinaryType()), T.StructField("token", T.LongType()), *bits])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([batch.schema.field("doc_id"), ("n", pa.int64()), ("set_key", pa.binary()), ("token", pa.int64()), *[(b, pa.int64()) for b in BITMAP]])

            def both(docs):
                held, weight = [], 0
                for doc, text in docs:
                    s = shingles(text)
                    marks = np.zeros(LONGS * 64, np.uint8)
                    marks[s & (LONGS * 64 - 1)] = 1
                    yield doc, len(s), xxhash.xxh3_128_digest(s.tobytes()), None, *np.packbits(marks).view(np.int64).tolist()
                    held.append(s)
                    weight += len(s)
                    if weight > 3_000_000:
                        yield from frequent(held)
                        held, weight = [], 0
                yield from frequent(held)

            def frequent(held):
                if held:
                    least = max(3, len(held) // usual)
                    token = np.concatenate(held)
                    held.clear()
                    token.sort()  # in place: the arrays of a batch are what a worker's memory goes to
                    token = token[: len(token) - least + 1][token[least - 1 :] == token[: len(token) - least + 1]] if len(token) >= least else token[:0]
                    token, n = np.unique(token, return_counts=True)
                    yield from ((None, int(c) + least - 1, None, int(t), *[None] * LONGS) for t, c in zip(token, n))

            yield from in_batches(both(sliced(batch, "doc_id", "text")), schema)

    return rows.mapInArrow(scan, kind)


def _ranked(common: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` tokens and their counts, rarest first. Counts fall into eighths of an octave; whole ones are taken."""
    size = F.floor(F.log2("c") * 8).cast("int").alias("size")
    cut, total = 1 << 30, 0
    for row in common.groupBy(size).agg(F.count("*").alias("n")).orderBy(F.desc("size")).collect():  # some hundred sizes
        total += row["n"]
        if total > most:
            break
        cut = row["size"]
    kept = common.filter(size >= cut).toArrow()
    token, c = (kept.column(x).to_numpy().astype(np.int64) for x in ("token", "c"))
    order = np.lexsort((token, c))
    return token[order], c[order]


def _prefixes(rows: DataFrame, common: np.ndarray) -> DataFrame:
    """``doc_id, n, tokens``: the size of each set and its rarest tokens in order. ``common`` lists frequent tokens, rarest first."""
    order = np.argsort(common, kind="stable")
    table = rows.sparkSession.sparkContext.broadcast((common[order], order))
    kind = T.StructType([rows.schema["doc_id"], T.StructField("n", T.IntegerType()), T.StructField("tokens", T.ArrayType(T.LongType()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, rank = table.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            for start in range(0, batch.num_rows, 1024):
                sizes, cuts = zip(*(one_cut(t, tokens, rank) for t in texts.slice(start, 1024).to_pylist()))
                ends = np.cumsum([0, *map(len, cuts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(cuts)))
                ids = batch.column(batch.schema.get_field_index("doc_id")).slice(start, 1024)
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int32()), lists], ["doc_id", "n", "tokens"])

    def one_cut(text: str, tokens: np.ndarray, rank: np.ndarray) -> tuple[int, np.ndarray]:
        s = shingles(text)
        n = len(s)
        keep = prefix_size(n) if n else 0
        if len(tokens) and len(s):
            at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
            often = tokens[at] == s
            rare = s[~often]
            s = np.concatenate([rare, s[often][np.argsort(rank[at[often]])]]) if len(rare) < keep else rare
        return n, s[:keep]

    return rows.mapInArrow(cut, kind)


def _formed(rows: DataFrame, ids: DataFrame, form: Callable[[np.ndarray], bytes]) -> DataFrame:
    """``doc_id, form`` of the given documents, and perhaps of others."""
    kind = T.StructType([rows.schema["doc_id"], T.StructField("form", T.BinaryType())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([batch.schema.field("doc_id"), ("form", pa.binary())])
            yield from in_batches(((doc, form(shingles(text))) for doc, text in sliced(batch, "doc_id", "text")), schema)

    return only_ids(rows, ids).mapInArrow(make, kind)


def sketch(s: np.ndarray) -> bytes:
    """The size of a set, and a bitmap of four to eight bits an element, in which each sets the bit that its lowest bits tell."""
    bits = 1 << min(20, max(9, (4 * len(s) - 1).bit_length()))
    marks = np.zeros(bits, np.uint8)
    marks[s & (bits - 1)] = 1
    return len(s).to_bytes(8, "little") + np.packbits(marks, bitorder="little").tobytes()


def sketches_fit(one: bytes, two: bytes) -> bool:
    """Whether sets may link: bits that differ are a lower bound of the elements that differ. The longer bitmap is folded."""
    sizes = int.from_bytes(one[:8], "little") + int.from_bytes(two[:8], "little")
    x, y = (np.frombuffer(b, np.uint8, offset=8) for b in (one, two))
    width = min(len(x), len(y))
    x, y = (np.bitwise_or.reduce(b.reshape(-1, width), axis=0) for b in (x, y))
    return 9 * int.from_bytes((x ^ y).tobytes(), "little").bit_count() <= sizes


def sets_link(one: bytes, two: bytes) -> bool:
    """The exact decision, by intersection of the sorted arrays."""
    one, two = np.frombuffer(one, np.int64), np.frombuffer(two, np.int64)
    at = np.minimum(np.searchsorted(one, two), len(one) - 1)
    shared = int((one[at] == two).sum())
    return 100 * shared >= 80 * (len(one) + len(two) - shared)


def _sizes_fit(n: Column, m: Column) -> Column:
    return F.least(n, m) * 5 >= F.greatest(n, m) * 4


def _differ(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in BITMAP), F.lit(0))


def _bits_fit(a: str, b: str) -> Column:
    """Bits that differ are a lower bound of the elements that differ; J >= 0.8 needs 9 times those at most the sizes."""
    return _differ(a, b) * 9 <= F.col(f"{a}.n") + F.col(f"{b}.n")


def _passing(pairs: DataFrame, rows: DataFrame, form: Callable[[np.ndarray], bytes], test: Callable[[bytes, bytes], bool]) -> DataFrame:
    """The pairs that pass a test on the forms of their sets. ``pairs`` is read more than once and should be stored."""
    forms = _formed(rows, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), form)
    a, b = (forms.select(F.col("doc_id").alias(c), F.col("form").alias(f"s{c}")) for c in ("a", "b"))
    full = pairs.join(b, "b").join(a, "a").select(*pairs.columns, "sa", "sb")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [test(one, two) for one, two in sliced(batch, "sa", "sb")]
            yield batch.select(pairs_columns).filter(pa.array(keep, pa.bool_()))

    pairs_columns = pairs.columns
    return stored(full.mapInArrow(decide, pairs.schema))


def _linked(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that link."""
    return _passing(pairs.select("a", "b"), rows, np.ndarray.tobytes, sets_link)


def shingle_join(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", usual: int = 4000, most_common: int = 1_000_000, block: int = 1000, splits: int = 16,
    tile: int = 8000, turns: int = 2, crowd: int = 32,
) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``.

    Shingles are runs of five words of the text with A to Z in lower case, held as 64-bit hashes; fewer words are one
    shingle. Documents link if 100 * intersection >= 80 * union. ``component_id`` is the smallest id reachable by
    links. Null or empty texts have no shingles and link with nothing. Rows without an id are left out; rows that
    repeat an id with its text get the same result each.

    Tokens that one in ``usual`` documents of some batch has are ranked by their count over all batches, and the
    ``most_common`` of them at most go last in every prefix; this only sets the order in which sets are compared, and
    any order gives the same links. Sets of one token beyond ``block`` are dealt to parts of that size to find leads, and
    beyond ``tile`` to tiles where they are compared; a set goes to each tile of its token. Before that, at most ``turns``
    rounds compare components with random leads in tokens of more than ``crowd`` sets; they only save comparisons. In the
    tiles of such tokens the bitmaps are compared inside the join.
    """
    rows = named(df, id_col, text_col)
    scan = stored(_scan(rows, usual))
    docs = scan.filter("token IS NULL").drop("token")
    common = scan.filter("token IS NOT NULL").groupBy("token").agg(F.sum("n").alias("c"))
    common = _ranked(common, most_common)
    classes = docs.filter("n > 0").groupBy("set_key", "n").agg(F.min("doc_id").alias("first"), F.count("*").alias("c")).filter("c > 1")
    own = stored(join_groups(docs, classes.select("set_key", "n", "first"), ["set_key", "n"], splits))
    own = own.withColumn("class", F.coalesce("first", "doc_id"))
    light = own.filter("doc_id = class").select(F.col("doc_id").alias("id"), F.struct("n", *BITMAP).alias("s")).dropDuplicates(["id"])

    singles = without_ids(rows, own.filter("doc_id <> class"))
    tokens = _prefixes(singles, common[0]).select(F.col("doc_id").alias("id"), "n", F.posexplode("tokens").alias("pos", "token"))
    hot = [(int(t), math.ceil(c / block)) for t, c in zip(*common) if c > block]
    if hot:
        schema = "token bigint, parts int"
        known = df.sparkSession.createDataFrame(hot, schema)
        tokens = tokens.join(F.broadcast(known), "token", "left")  # at most ``most_common`` rows
    else:
        tokens = tokens.withColumn("parts", F.lit(None).cast("int"))
    tokens = tokens.withColumn("part", F.coalesce(F.pmod(F.hash("id"), F.col("parts")), F.lit(0)))
    group = Window.partitionBy("token", "part")
    by_size = group.orderBy("n")
    met = tokens.withColumn("above", F.lead("n").over(by_size)).withColumn("below", F.lag("n").over(by_size)).withColumn("lead", F.min("id").over(group))
    # a row has a partner of its token only if the next larger or the next smaller set is one by size and place
    larger = F.col("above").isNotNull() & _sizes_fit(F.col("n"), F.col("above")) & _room("n", "pos", "above")
    smaller = F.col("below").isNotNull() & _sizes_fit(F.col("n"), F.col("below"))
    met = stored(met.filter(F.col("parts").isNotNull() | larger | smaller).select("token", "id", "n", "pos", "lead"))

    # of the leads that a set met, the one with which it shares most tokens
    likely = met.filter("id <> lead").groupBy(F.col("lead").alias("a"), F.col("id").alias("b")).agg(F.count("*").alias("c"))
    likely = likely.groupBy("b").agg(F.max_by("a", F.struct("c", "a")).alias("a"))
    likely = _with_bitmaps(likely, light).filter(_sizes_fit(F.col("sa.n"), F.col("sb.n")) & _bits_fit("sa", "sb"))
    roots = components(_linked(stored(likely.select("a", "b")), rows))

    # components still apart inside a token are compared by random leads until nothing new links, and only then set by set
    for turn in range(turns):
        tried = stored(_drawn_pairs(met.select("token", "id"), light, roots, block, turn, crowd))
        if tried.isEmpty():
            break
        found = _linked(tried, rows)
        if found.isEmpty():
            break
        roots = _grown(roots, found)
    pairs = stored(_cross_pairs(met.drop("lead"), light, roots, tile, crowd))
    if not pairs.isEmpty():
        pairs = _passing(pairs, rows, sketch, sketches_fit)
    if not pairs.isEmpty():
        best = _open(pairs, roots).groupBy("ra", "rb").agg(F.min_by(F.struct("a", "b"), F.col("differ") / F.col("sizes")).alias("p"))
        roots = _grown(roots, _linked(stored(best.select("p.a", "p.b")), rows))
        left = stored(_open(pairs, roots).select("a", "b"))
        if not left.isEmpty():
            roots = _grown(roots, _linked(left, rows))
    out = own
    if roots is not None:
        grown = roots.select(F.col("id").alias("class"), "root")
        out = own.join(grown, "class", "left")
    else:
        out = own.withColumn("root", F.col("class"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "class").alias("component_id"))


def _rooted(table: DataFrame, roots: DataFrame | None, ids: list[str]) -> DataFrame:
    """Adds ``r<id>``: the root of each id column, or the id itself."""
    for c in ids:
        if roots is None:
            table = table.withColumn(f"r{c}", F.col(c))
        else:
            table = table.join(roots.select(F.col("id").alias(c), F.col("root").alias(f"r{c}")), c, "left")
            table = table.withColumn(f"r{c}", F.coalesce(f"r{c}", c))
    return table


def _grown(roots: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """The roots after more links: only the roots of the linked ids are joined anew."""
    more = components(_rooted(links, roots, ["a", "b"]).select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    if roots is None or more is None:
        return roots if more is None else more
    higher = more.select(F.col("id").alias("root"), F.col("root").alias("next"))
    moved = roots.join(higher, "root", "left").select("id", F.coalesce("next", "root").alias("root"))
    return stored(moved.unionAll(more.join(roots.select("id"), "id", "left_anti").select("id", "root")))


def _open(pairs: DataFrame, roots: DataFrame | None) -> DataFrame:
    return _rooted(pairs, roots, ["a", "b"]).filter("ra <> rb")


def _with_bitmaps(pairs: DataFrame, light: DataFrame) -> DataFrame:
    a, b = (light.select(F.col("id").alias(c), F.col("s").alias(f"s{c}")) for c in ("a", "b"))
    return pairs.join(a, "a").join(b, "b")


def _room(n: str, pos: str, m: str) -> Column:
    """Whether a set of size n that shares no token before the place ``pos`` can share enough with one of size m: 4 (n + m) / 9."""
    return (F.col(n) - F.col(pos)) * 9 >= (F.col(n) + F.col(m)) * 4


def _apart(met: DataFrame, roots: DataFrame | None, least: int = 1) -> DataFrame:
    """Sets with their roots and the number of sets of the token, of tokens of more than ``least`` sets and one component."""
    rooted = _rooted(met, roots, ["id"])
    spread = rooted.groupBy("token").agg(F.min("rid").alias("low"), F.max("rid").alias("high"), F.count("*").alias("c"))
    spread = spread.filter((F.col("low") != F.col("high")) & (F.col("c") > least)).select("token", "c")
    return rooted.join(spread, "token")


def _drawn_pairs(met: DataFrame, light: DataFrame, roots: DataFrame | None, block: int, turn: int, crowd: int) -> DataFrame:
    """``a, b``: for every component the likeliest link to another one, among one random lead a crowded token and part.

    Each set meets as many leads as it has tokens, other ones in every turn. A lead is a combined minimum and its group
    a part of about ``block`` sets, so that rows grow with the sets and not with their pairs.
    """
    members = _apart(met, roots, crowd).join(light, "id")
    parts = F.ceil(F.col("c") / block).cast("int")
    members = members.withColumn("part", F.pmod(F.xxhash64("id", F.lit(turn)), parts))
    lead = F.min(F.struct(F.xxhash64("id", "token", F.lit(turn)).alias("draw"), F.col("id").alias("a"), F.col("rid").alias("ra"), F.col("s").alias("sa")))
    met = members.withColumn("lead", lead.over(Window.partitionBy("token", "part")))
    met = met.filter("rid <> lead.ra").select(F.col("lead.a").alias("a"), "lead.ra", "lead.sa", F.col("id").alias("b"), F.col("rid").alias("rb"), F.col("s").alias("sb"))
    sizes = F.col("sa.n") + F.col("sb.n")
    near = met.filter(_sizes_fit(F.col("sa.n"), F.col("sb.n")) & _bits_fit("sa", "sb"))
    near = near.select("a", "b", F.least("ra", "rb").alias("ra"), F.greatest("ra", "rb").alias("rb"), (_differ("sa", "sb") / sizes).alias("far"))
    best = near.groupBy("ra", "rb").agg(F.min(F.struct("far", "a", "b")).alias("p"))
    each = best.select(F.explode(F.array("ra", "rb")).alias("root"), "p").groupBy("root").agg(F.min("p").alias("p"))
    return each.select("p.a", "p.b").distinct()


def _meeting(members: DataFrame, bitmaps: bool) -> DataFrame:
    """Pairs of sets in different components, once for every token that they share and fit in by size and place."""
    held = lambda c: [F.col("s").alias(f"s{c}")] if bitmaps else []
    one = members.select(
        "token", F.col("id").alias("a"), F.col("rid").alias("ra"), F.col("n").alias("na"), F.col("pos").alias("pa"),
        F.pmod(F.hash("id"), F.col("blocks")).alias("part"), *held("a"),
    )
    two = members.select(
        "token", F.col("id").alias("b"), F.col("rid").alias("rb"), F.col("n").alias("nb"), F.col("pos").alias("pb"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), *held("b"),
    )
    na, nb = F.col("na"), F.col("nb")
    smaller = (na < nb) | ((na == nb) & (F.col("a") < F.col("b")))
    # judged inside the join, so that only pairs that may link come out of a tile; the first token that a linked pair shares passes
    apart = smaller & (F.col("ra") != F.col("rb")) & _sizes_fit(na, nb) & _room("na", "pa", "nb") & _room("nb", "pb", "na")
    return one.join(two, ["token", "part"]).filter(apart & _bits_fit("sa", "sb") if bitmaps else apart)


def _cross_pairs(met: DataFrame, light: DataFrame, roots: DataFrame | None, tile: int, crowd: int = 32) -> DataFrame:
    """``a, b, differ, sizes``: pairs of sets in different components that share a token, fit in size and place, and pass the bitmaps.

    Rows of tokens of more than ``crowd`` sets carry their bitmaps into the join, and pairs that fail them are never rows:
    most sets of a large group that link with none of it are told apart there. Other tokens have few pairs, whose bitmaps are fetched.
    """
    members = stored(_apart(met, roots).withColumn("blocks", F.ceil(F.col("c") / tile).cast("int")))
    few = _with_bitmaps(_meeting(members.filter(F.col("c") <= crowd), False).select("a", "b").distinct(), light).filter(_bits_fit("sa", "sb"))
    many = _meeting(members.filter(F.col("c") > crowd).join(light, "id"), True)
    ends = ["a", "b", _differ("sa", "sb").alias("differ"), (F.col("sa.n") + F.col("sb.n")).alias("sizes")]
    return few.select(*ends).unionAll(many.select(*ends)).distinct()
