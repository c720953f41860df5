"""The Katz model with every pair in it, also those seen once, against a plain computation."""

import math
import zlib
from collections import Counter, defaultdict

from assay.llm import katz
from assay.llm.katz import katz_scores
from assay.llm.tables import stored as kept
from tests.llm.test_katz import TEXTS, discounts


def whole(rows):
    """The scores, and the numbers of pairs seen once that training texts hold and that held-out texts ask for."""
    tokens = lambda t: [w.decode() for w in (t or "").encode().lower().split()] + ["</s>"]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    train = [tokens(t) for i, t in rows if not held(i)]
    uni, ctx = Counter(w for t in train for w in t), Counter(w for t in train for w in ["<s>", *t[:-1]])
    pair = Counter(p for t in train for p in zip(["<s>", *t], t))
    total = sum(uni.values())
    d1, d2 = discounts(Counter(uni.values()), 1), discounts(Counter(pair.values()), 1)
    kept = sum(c * d1.get(c, 1.0) for c in uni.values())
    seats = total if kept < total * (1 - 1e-6) else total + 1
    p1, unk = {w: c * d1.get(c, 1.0) / seats for w, c in uni.items()}, max(seats - kept, 1.0) / seats
    by = defaultdict(dict)
    for (v, w), c in pair.items():
        by[v][w] = c * d2.get(c, 1.0)
    full, weight = {}, {}
    for v, row in by.items():
        mass = sum(row.values())
        full[v] = ctx[v] if mass < ctx[v] * (1 - 1e-9) else ctx[v] + 1
        weight[v] = (1 - mass / full[v]) / max(1 - sum(p1[w] for w in row), 1e-12)
    prob = lambda v, w: by[v][w] / full[v] if w in by.get(v, ()) else weight.get(v, 1.0) * p1.get(w, unk)
    pairs_of = lambda t: list(zip(["<s>", *tokens(t)], tokens(t)))
    once = [sum(pair[p] == 1 for i, t in rows if held(i) == out for p in pairs_of(t)) for out in (False, True)]
    return {i: sum(math.log10(prob(v, w)) for v, w in pairs_of(t)) for i, t in rows}, once


def same(df, rows, **options):
    got = {r.doc_id: r.score for r in katz_scores(df, pairs_from=1, **options).collect()}
    want, once = whole(rows)
    assert min(once) > 0 and got.keys() == want.keys()
    for i, score in want.items():
        assert abs(got[i] - score) < 1e-6, (i, got[i], score)


def test_small_texts_with_pairs_seen_once(spark):
    more = [f"the cat saw animal{k} near the house{k} {'of a dog' if k % 3 else 'on the mat'}" for k in range(12)]
    rows = list(enumerate([*TEXTS, *more, "animal3 near the dog ran", "of a cat on animal5 near"] * 2 + ["a lone pair", "a lone pair here"] * 3))
    rows += [(100 + k, t) for k, t in enumerate(["lone wolf runs far", "wolf runs", "far away wolf runs far", "lone wolf", "runs far off"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(df, rows)
    same(df, rows, most_common=3, common_words=2, flush_words=40, filter_bits=16)
    same(df, rows, most_common=0, common_words=0)


def test_documents_with_pairs_seen_once(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    same(df, [(r.doc_id, r.text) for r in df.collect()], most_common=500, common_words=300, flush_words=5000)


def test_pairs_of_common_words_are_short_and_find_their_word_without_a_join(spark, monkeypatch):
    """Words of the pairs' table are places among the common words, not hashes, and the table is not stored again with P(w)."""
    held = []
    monkeypatch.setattr(katz, "stored", lambda df: held.append(kept(df)) or held[-1])
    rows = [(i, f"one of {i % 7} and one of {i % 5} more words") for i in range(200)]
    same_scores = katz_scores(spark.createDataFrame(rows, "doc_id long, text string"), pairs_from=1)
    assert same_scores.count() == 200
    tables = [t for t in held if {"v", "w"} <= set(t.columns)]
    assert len(tables) == 1
    places = [w for r in tables[0].filter("w IS NOT NULL").collect() for w in (r.v, r.w)]
    assert len(places) > 20 and sum(0 <= w < 100 for w in places) >= len(places) / 2
    begins = tables[0].filter(tables[0].v == katz._signed(katz._BEGIN)[0].item()).count()
    assert sum(not 0 <= w < 100 for w in places) <= begins


def test_the_query_stores_every_pair(spark):
    import __spark_entry__ as entry

    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want, _ = whole(rows)
    for r in entry.queries()["op2_katz_scores"](spark, "/root/testdata/sf0.001").collect():
        assert abs(r.score - want[r.doc_id]) < 1e-6
