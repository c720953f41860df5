"""Katz backoff language model: Good-Turing discounted counts with exactly normalised backoff weights.

    P(w)     = d(c) c(w) / N, and what the discounts leave is the probability of the unknown word
    P(w | v) = d(c) c(v, w) / c(v)   for stored pairs, else   weight(v) P(w)

Every pair has its own Good-Turing factor, those seen once too. The weight of a context gives what its pairs leave to
the words that it has no pair with, divided by their unigram probability, so that every distribution sums to one.
Evaluated in logarithms, the recursion is a sum over lookups: each word contributes log P(w) and, as a context,
log weight(v), and each stored pair the difference to that. All tables are keyed by hashes of words and pairs.

A pair that occurs in one place of all texts needs no row: where a training text holds it, it was learnt there and
nowhere else, so its probability d(1) / c(v) is known from the context alone, and a held-out text cannot ask for it. A
filter tells the others, which are counted and looked up; a pair that passes it by chance is counted and found as well.

In tables of pairs a word is a code: its place among the common words, which tasks have at hand with their P(w), and else
its hash. Pairs of common words are short rows then, and find P(w) without a join.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.llm.tables import in_batches, named, peeked, shuffle_width, sliced, stored
from assay.llm.wordhash import ROLL, BitFilter, by_part, mixed, packed, part_bits, rest_of, segment_of, unpacked, word_hashes

BEGIN, END = 0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179  # the hashes of the text's two ends
MOST_DISCOUNTED = 5
REST = 22  # bits of a pair's hash that travel beside its part and its two marks when pairs are looked for that occur twice
AGAIN, ASKED = 1, 2  # marks: learnt more than once here; occurs in a held-out text


def held_out_column(doc_id: Column, folds: int = 5, fold: int = 1) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == fold


def pair_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mixed(v * np.uint64(ROLL) + w)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _coded(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places of words among the sorted known hashes; other words keep their hash."""
    if not len(known):
        return hashes
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, at, hashes)


def _is_place(code: np.ndarray | Column, known: int):
    return (code >= 0) & (code < known)


class _Flush:
    """Documents taken together, as contexts, words and the number of the document of each word; and who is held out."""

    def __init__(self, docs: list[tuple]):
        self.docs = docs
        words, contexts = [], []
        for _, _, h, _ in docs:
            words += [h, _END]
            contexts += [_BEGIN, h]
        self.word = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.context = np.concatenate(contexts) if contexts else np.zeros(0, np.uint64)
        self.doc = np.repeat(np.arange(len(docs)), [len(d[2]) + 1 for d in docs])
        self.held = np.array([d[3] for d in docs], bool)[self.doc]


_BEGIN, _END = np.array([BEGIN], np.uint64), np.array([END], np.uint64)


def _flushes(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[_Flush]:
    held, weight = [], 0
    for batch in batches:
        for doc, text, out in sliced(batch, "doc_id", "text", "held"):
            data = text.encode("utf-8", "replace")
            own = word_hashes(data, lower=True)
            held.append((doc, zlib.crc32(data), own, out))
            weight += len(own) + 8
            if weight >= most:
                yield _Flush(held)
                held, weight = [], 0
    if held:
        yield _Flush(held)


@dataclass
class Discounts:
    """Good-Turing factors of the counts 1 to 5 and the mass that is left."""

    factor: list[float]

    @classmethod
    def of(cls, n: dict[int, int], stored_from: int = 1) -> Discounts:
        """``n`` has the number of entries of each count. Where the counts of counts give no factor in (0, 1], it is 1."""
        k, factor = MOST_DISCOUNTED, []
        top = (k + 1) * n.get(k + 1, 0) / n[1] if n.get(1) else 1.0
        for r in range(1, k + 1):
            seen = n.get(r, 0)
            d = ((r + 1) * n.get(r + 1, 0) / (r * seen) - top) / (1 - top) if seen and top < 1 else 1.0
            factor.append(0.0 if r < stored_from else d if 0 < d <= 1 else 1.0)
        return cls(factor)

    def discounted(self, c: Column) -> Column:
        table = F.array(*[F.lit(float(f)) for f in self.factor])
        return c * F.when(c <= MOST_DISCOUNTED, F.element_at(table, F.least(c, F.lit(MOST_DISCOUNTED)).cast("int"))).otherwise(1.0)


@dataclass
class Katz:
    """A trained model. ``values`` has ``key, known, base, score``: what a word or a pair adds to that of an unknown word.

    Its ``word`` and ``context`` are what a word loses as either half of a pair that has no row, which gains ``single``;
    that is None where such pairs are not in the model.
    """

    values: DataFrame
    pairs: BitFilter
    tokens: int
    distinct: int
    unknown_base: float
    unknown_score: float
    begin_score: float
    begin_context: float
    single: float | None


def _word_counts(train: DataFrame, most: int) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for flush in _flushes(batches, most):
            w, c = np.unique(flush.word, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(_signed(w)), pa.array(c.astype(np.int64))], ["w", "c"])

    return stored(train.mapInArrow(count, "w bigint, c bigint").groupBy("w").agg(F.sum("c").alias("c")))


def _twice(rows: DataFrame, most: int, bits: int, filter_bits: int) -> BitFilter:
    """A filter that all pairs pass which are learnt at least twice, or learnt and asked for by a held-out text."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for flush in _flushes(batches, most):
                every = pair_keys(flush.context, flush.word)
                for out in (False, True):
                    keys, count = np.unique(every[flush.held == out], return_counts=True)
                    mark = np.where(out, ASKED, np.where(count > 1, AGAIN, 0)).astype(np.uint64)
                    entry = rest_of(keys, bits, REST) << np.uint64(2) | mark
                    for part, own in by_part(keys, bits):
                        yield part, packed(entry[own], 3)

        yield from in_batches(rows(), pa.schema([("part", pa.int32()), ("pairs", pa.binary())]))

    def match(table: pa.Table) -> pa.Table:
        entry = np.sort(np.concatenate([unpacked(b.as_py(), 3) for b in table.column("pairs")]))
        rest, mark = entry >> np.uint64(2), entry & np.uint64(3)
        first = np.flatnonzero(np.concatenate([[True], rest[1:] != rest[:-1]]))
        learnt = np.add.reduceat(np.where(mark == ASKED, 0, 1 + mark.astype(np.int64)), first)
        asked = np.maximum.reduceat(mark, first) == ASKED
        segment = segment_of(rest[first[(learnt > 1) | (learnt > 0) & asked]], REST, filter_bits - bits)
        return pa.table({"part": table.column("part")[:1], "segment": pa.array([segment], pa.binary())})

    found = BitFilter(filter_bits)
    asked = rows.mapInArrow(ask, "part int, pairs binary")
    for row in asked.groupBy("part").applyInArrow(match, "part int, segment binary").toLocalIterator():
        found.put_part(row["part"], bits, row["segment"])
    return found


def _pair_counts(train: DataFrame, twice: BitFilter, table: Broadcast, rest_p: float | None, most: int) -> DataFrame:
    """``v, w, c`` of the pairs that pass, or whose P(w) is not at hand; the others as ``v, null, c, p``: their number and sum of P(w).

    Words are codes. ``rest_p`` is P(w) of all words that are not common, where they share one.
    """
    shared = train.sparkSession.sparkContext.broadcast(twice)
    names = ["v", "w", "c", "p"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        likely, (known, known_p) = shared.value, table.value

        def counted(v: np.ndarray, w: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v), pa.array(w), pa.array(c.astype(np.int64)), pa.nulls(len(c), pa.float64())], names)

        for flush in _flushes(batches, most):
            keys = pair_keys(flush.context, flush.word)
            word = _coded(_signed(flush.word), known)
            context = np.where(flush.context == _BEGIN, _signed(_BEGIN), np.roll(word, 1))
            here = _is_place(word, len(known))
            short = here & _is_place(context, len(known))
            alone = ~likely.passes(keys) & (here | (rest_p is not None))
            pair, c = np.unique(context[short & ~alone] << 32 | word[short & ~alone], return_counts=True)
            yield counted(pair >> 32, pair & 0xFFFFFFFF, c)
            at = np.flatnonzero(~short & ~alone)
            _, first, c = np.unique(keys[at], return_index=True, return_counts=True)
            yield counted(context[at[first]], word[at[first]], c)
            p = np.full(len(keys), rest_p or 0.0)
            p[here] = known_p[word[here]]
            v, which, c = np.unique(context[alone], return_inverse=True, return_counts=True)
            p = np.bincount(which, p[alone], len(v)) if len(v) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.nulls(len(v), pa.int64()), pa.array(c.astype(np.int64)), pa.array(p)], names)

    counts = train.mapInArrow(count, "v bigint, w bigint, c bigint, p double").groupBy("v", "w")
    return stored(counts.agg(F.sum("c").alias("c"), F.sum("p").alias("p")))


def _counts_of_counts(counts: DataFrame) -> dict[int, int]:
    small = counts.filter(F.col("c") <= MOST_DISCOUNTED + 1).groupBy("c").agg(F.count("*").alias("n"))
    return {r["c"]: r["n"] for r in small.collect()}


def train_katz(rows: DataFrame, flush_words: int = 1 << 19, filter_bits: int = 27, pairs_from: int = 1, common_words: int = 1_000_000) -> Katz:
    """Learn from all rows of ``doc_id, text, held`` that are not held out; the held-out ones are those that it can score besides.

    Pairs are in the model that occur ``pairs_from`` times, 1 or 2; the others count towards c(v) alone.
    """
    train = rows.filter("NOT held")
    bits = min(filter_bits - 3, part_bits(shuffle_width(train.sparkSession)))
    words = _word_counts(train, flush_words)
    total = words.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.max(F.when(F.col("w") == _signed(_END)[0].item(), F.col("c"))).alias("texts")).first()
    tokens, distinct, texts = total["n"] or 0, total["v"], total["texts"] or 0
    unigram = Discounts.of(_counts_of_counts(words))
    kept = words.agg(F.sum(unigram.discounted(F.col("c"))).alias("s")).first()["s"] or 0.0
    # Where no discount leaves mass, the unknown word counts as seen once.
    seats = tokens if kept < tokens - 1e-6 * tokens else tokens + 1
    unknown = max(seats - kept, 1.0) / max(seats, 1) if tokens else 1.0
    words = words.withColumn("p", unigram.discounted(F.col("c")) / F.lit(float(max(seats, 1))))

    twice = _twice(rows, flush_words, bits, filter_bits)
    again = words.filter("c > 1").select(F.col("w").alias("key"), "c", "p")
    common, _ = _most_common(again, common_words, ("p",))
    # where all other words are seen once, they share one probability
    rest_p = unigram.factor[0] / max(seats, 1) if len(common[0]) == again.count() else None
    table = rows.sparkSession.sparkContext.broadcast(common)
    code, word_p, pair_key = _code_columns(table)
    counts = _pair_counts(train, twice, table, rest_p, flush_words)
    pairs, alone = counts.filter("w IS NOT NULL").select("v", "w", "c"), counts.filter("w IS NULL")
    n = _counts_of_counts(pairs)
    n[1] = tokens - (pairs.filter("c > 1").agg(F.sum("c")).first()[0] or 0)
    bigram = Discounts.of(n, stored_from=pairs_from)
    words = words.withColumn("code", code("w"))
    pairs = pairs.filter(F.col("c") >= pairs_from)
    # P(w) of common words is at hand wherever it is asked for, and so is that of all others where they share it
    if rest_p is None:
        far = words.filter(~_is_place(F.col("code"), len(common[0]))).select(F.col("code").alias("w"), "p")
        far = stored(pairs.filter(~_is_place(F.col("w"), len(common[0]))).join(far, "w").select("v", "w", "c", "p"))
        pairs = pairs.filter(_is_place(F.col("w"), len(common[0]))).withColumn("p", F.lit(None).cast("double")).unionAll(far)
    else:
        pairs = pairs.withColumn("p", F.when(~_is_place(F.col("w"), len(common[0])), rest_p))
    pair_d, pair_p = bigram.discounted(F.col("c")), F.coalesce("p", word_p("w"))
    contexts = words.filter(F.col("w") != _signed(_END)[0].item()).select(F.col("code").alias("v"), "c")
    contexts = contexts.unionAll(contexts.sparkSession.range(1).select(F.lit(_signed(_BEGIN)[0].item()).alias("v"), F.lit(texts).cast("long").alias("c")))
    masses = pairs.select("v", pair_d.alias("d"), pair_p.alias("p"))
    if pairs_from == 1:
        masses = masses.unionAll(alone.select("v", F.col("c") * bigram.factor[0], "p"))
    sums = masses.groupBy("v").agg(F.sum("d").alias("d"), F.sum("p").alias("p"))
    sums = sums.join(contexts, "v")
    full = F.when(F.col("d") < F.col("c") * (1 - 1e-9), F.col("c")).otherwise(F.col("c") + 1)
    sums = sums.select("v", full.alias("full"), ((1 - F.col("d") / full) / F.greatest(1 - F.col("p"), F.lit(1e-12))).alias("weight"))
    sums = stored(sums.select("v", "full", F.log10("weight").alias("weight")))
    begin = sums.filter(F.col("v") == _signed(_BEGIN)[0].item()).first()

    floor = tokens + 0.5 * (distinct + 1)
    unknown_base, unknown_score = math.log10(0.5 / floor), math.log10(unknown)
    weight = F.coalesce("weight", F.lit(0.0))
    own = words.join(sums.select(F.col("v").alias("code"), "weight", "full"), "code", "left").select(
        F.col("w").alias("key"), F.lit(1).alias("known"), (F.log10((F.col("c") + 0.5) / F.lit(floor)) - F.lit(unknown_base)).alias("base"),
        (F.log10("p") + weight - F.lit(unknown_score)).alias("score"), F.log10("p").alias("word"),
        (weight + F.log10(F.coalesce("full", F.lit(1.0)))).alias("context"), "c",
    )
    gain = F.log10(pair_d / F.col("full")) - F.col("weight") - F.log10(pair_p)
    zero = F.lit(0.0)
    joint = pairs.join(sums, "v").select(
        pair_key("v", "w").alias("key"), F.lit(0).alias("known"), zero.alias("base"), gain.alias("score"),
        zero.alias("word"), zero.alias("context"), pair_d.alias("c"),
    )
    begin_score, begin_full = (begin["weight"], begin["full"]) if begin else (0.0, 1)
    single = math.log10(bigram.factor[0]) if pairs_from == 1 else None
    return Katz(
        stored(own.unionAll(joint)), twice, tokens, distinct, unknown_base, unknown_score, begin_score, begin_score + math.log10(begin_full), single
    )


def _code_columns(table: Broadcast) -> tuple[Callable, Callable, Callable]:
    """The code of a hash, P(w) of a code if it is at hand, and the key of a pair of codes, by a table of sorted hashes and their P(w)."""

    @F.arrow_udf("bigint")
    def code(h: pa.Array) -> pa.Array:
        return pa.array(_coded(h.to_numpy(zero_copy_only=False), table.value[0]))

    @F.arrow_udf("double")
    def word_p(w: pa.Array) -> pa.Array:
        known, known_p = table.value
        w = w.to_numpy(zero_copy_only=False)
        here = _is_place(w, len(known))
        p = np.zeros(len(w))
        p[here] = known_p[w[here]]
        return pa.array(p, mask=~here)

    @F.arrow_udf("bigint")
    def pair_key(v: pa.Array, w: pa.Array) -> pa.Array:
        known = table.value[0]

        def hashes(x: pa.Array) -> np.ndarray:
            x = x.to_numpy(zero_copy_only=False)
            here = _is_place(x, len(known))
            out = x.copy()
            out[here] = known[x[here]]
            return out.view(np.uint64)

        return pa.array(_signed(pair_keys(hashes(v), hashes(w))))

    return code, word_p, pair_key


def _most_common(values: DataFrame, most: int, added: tuple[str, ...]) -> tuple[list[np.ndarray], DataFrame]:
    """Sorted keys of at most ``most`` common entries, and what each adds in the named columns; packed on the executors. And the other entries.

    Counts fall into eighths of an octave, and whole ones are taken from the top while they fit.
    """
    size = F.floor(F.log2(F.greatest("c", F.lit(1e-6))) * 8).cast("int").alias("size")
    cut, total = 1 << 30, 0
    for row in values.groupBy(size).agg(F.count("*").alias("n")).orderBy(F.desc("size")).collect():  # some hundred sizes
        total += row["n"]
        if total > most:
            break
        cut = row["size"]
    columns = ("key", *added)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(c).to_numpy(zero_copy_only=False).tobytes()], pa.binary()) for c in columns], columns)

    kept = values.filter(size >= cut).select("key", *[F.col(c).cast("double") for c in columns[1:]])
    blobs = list(kept.mapInArrow(pack, ", ".join(f"{c} binary" for c in columns)).toLocalIterator())
    key, *rest = (np.frombuffer(b"".join(r[c] for r in blobs), np.int64 if c == "key" else np.float64) for c in columns)
    order = np.argsort(key)
    return [key[order], *[x[order] for x in rest]], values.filter(size < cut)


def score_katz(rows: DataFrame, model: Katz, most_common: int = 1_500_000, flush_words: int = 1 << 19) -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score`` of each row of ``doc_id, text, held`` that the model was trained with."""
    added = ("base", "score", "word", "context")
    common, others = _most_common(model.values, most_common, added)
    shared = rows.sparkSession.sparkContext.broadcast((*common, model.pairs))
    kind = T.StructType([rows.schema["doc_id"], *[T.StructField(n, t) for n, t in (
        ("body", T.LongType()), ("key", T.LongType()), ("times", T.IntegerType()), ("as_word", T.IntegerType()), ("as_context", T.IntegerType()),
        ("rows", T.IntegerType()), ("n_tokens", T.LongType()),
        ("n_known", T.DoubleType()), ("base", T.DoubleType()), ("score", T.DoubleType()))]])
    unknown_base, unknown_score, begin_score = model.unknown_base, model.unknown_score, model.begin_score
    begin_context, single = model.begin_context, model.single

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, base, score, as_word, as_context, likely = shared.value
        none = np.zeros(0, np.int64)
        doc_type, batches = peeked(batches, "doc_id")
        names = [f.name for f in kind.fields]

        def found(keys: np.ndarray, doc: np.ndarray, sums: np.ndarray, lost: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
            """Adds what the common keys are worth to the documents, or takes away what they lose; the others are returned."""
            if not len(hot):
                return keys, doc
            signed = _signed(keys)
            at = np.minimum(np.searchsorted(hot, signed), len(hot) - 1)
            here = hot[at] == signed
            at, of = at[here], doc[here]
            if lost is not None:
                sums[2] -= np.bincount(of, lost[at], sums.shape[1])
                return keys[~here], doc[~here]
            for k, value in enumerate((base[at] > 0, base[at], score[at])):  # every known word is worth more than an unknown one
                sums[k] += np.bincount(of, value, sums.shape[1])
            return keys[~here], doc[~here]

        for flush in _flushes(batches, flush_words):
            docs, n = flush.docs, len(flush.docs)
            size = np.bincount(flush.doc, minlength=n)
            sums = np.vstack([np.zeros(n), size * unknown_base, size * unknown_score + begin_score])
            words, word_doc = found(flush.word, flush.doc, sums)
            pairs = pair_keys(flush.context, flush.word)
            passed = likely.passes(pairs)
            pairs, pair_doc = found(pairs[passed], flush.doc[passed], sums)
            asked = [(words, word_doc), (pairs, pair_doc)]
            if single is not None:
                alone = ~passed & ~flush.held  # learnt here and nowhere else
                begins = flush.context == _BEGIN
                sums[2] += np.bincount(flush.doc[alone], minlength=n) * single - np.bincount(flush.doc[alone & begins], minlength=n) * begin_context
                asked.append(found(flush.word[alone], flush.doc[alone], sums, as_word))
                alone &= ~begins
                asked.append(found(flush.context[alone], flush.doc[alone], sums, as_context))
            key, doc = (np.concatenate(x) for x in zip(*asked))
            use = np.repeat([0, 0, 1, 2][: len(asked)], [len(k) for k, _ in asked])
            order = np.lexsort((key, doc))
            doc, key, use = doc[order], key[order], use[order]
            first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])) if len(key) else none
            times = [np.add.reduceat((use == u).astype(np.int64), first) if len(key) else none for u in range(3)]
            doc, key = doc[first], key[first]
            ids = pa.array([d[0] for d in docs], doc_type)
            body = np.array([d[1] & 0xFFFF for d in docs], np.int64)
            # The document's own row goes to a place of its own; it asks zero times.
            m, zero = len(key), np.zeros(len(key))
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([ids, ids.take(pa.array(doc))]), pa.array(np.concatenate([body, body[doc]])),
                pa.array(np.concatenate([_signed(mixed(body.view(np.uint64) + np.arange(n, dtype=np.uint64))), _signed(key)])),
                *[pa.array(np.concatenate([np.zeros(n), t]).astype(np.int32)) for t in times],
                pa.array(np.concatenate([np.ones(n), zero]).astype(np.int32)),
                pa.array(np.concatenate([size, zero]).astype(np.int64)), *[pa.array(np.concatenate([s, np.zeros(m)])) for s in sums],
            ], names)

    asked = rows.mapInArrow(look, kind)
    values = others.select("key", F.col("known").alias("v_known"), F.col("base").alias("v_base"), F.col("score").alias("v_score"), F.col("word").alias("v_word"), F.col("context").alias("v_context"))
    got = asked.join(values, "key", "left")
    worth = lambda times, c: F.col(times) * F.coalesce(f"v_{c}", F.lit(0.0))
    total = got.groupBy("doc_id", "body").agg(
        F.sum("rows").alias("rows"), F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("n_known") + F.col("times") * F.coalesce("v_known", F.lit(0))).alias("n_known"),
        F.sum(F.col("base") + worth("times", "base")).alias("base"),
        F.sum(F.col("score") + worth("times", "score") - worth("as_word", "word") - worth("as_context", "context")).alias("score"),
    )
    rows_of = F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int")))
    each = [(F.col(c) / F.col("rows")).alias(c) for c in ("n_tokens", "n_known", "base", "score")]
    return total.select("doc_id", *each, rows_of.alias("copy")).select(
        "doc_id", F.round("n_tokens").cast("long").alias("n_tokens"), F.round("n_known").cast("long").alias("n_known"),
        F.col("base").alias("base_score"), "score",
    )


def katz_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    The model learns from the documents that are not held out, those whose crc32 of the id as text leaves 1 modulo 5,
    and scores all. Tokens are runs of characters other than ASCII white space, with A to Z in lower case, and one
    end of text. ``base_score`` is an add-half unigram model and ``score`` the Katz model, both log10 of the
    probability of the whole text, in which all words that were never learnt are one unknown word. A null or empty
    text is its end alone. Rows without an id are left out; repeated rows are learnt and scored each, and texts that
    share an id are told apart by 16 bits of their checksum. Without any training text the unknown word has probability one.

    ``pairs_from=1`` puts every pair into the model, as the query does; by default pairs seen once are left out of it.

    ``most_common`` bounds the table of common words and pairs that is sent to the scans; the others are joined, and no
    key that is left then is frequent. The filter of pairs has a fixed size and never misses a pair.
    """
    rows = named(df, id_col, text_col).withColumn("held", held_out_column(F.col("doc_id")))
    fit = {"pairs_from": 2} | {k: v for k, v in options.items() if k in ("flush_words", "filter_bits", "pairs_from", "common_words")}
    model = train_katz(rows, **fit)
    scored = score_katz(rows, model, **{k: v for k, v in options.items() if k in ("flush_words", "most_common")})
    return scored.select(
        "doc_id", held_out_column(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )
