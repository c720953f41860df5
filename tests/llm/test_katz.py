"""The Katz model against a plain computation over all words."""

import math
import zlib
from collections import Counter, defaultdict

from assay.llm.katz import MOST_DISCOUNTED, katz_scores

TEXTS = [
    "the cat sat on the mat", "the cat sat on the hat the cat", "A dog sat on the mat", "the dog ran", None, "", "the cat sat on the mat",
    "a dog and a cat and a dog", "zebra", "on the mat on the mat on the mat", "The\tcat\x0bran\nhome", "é É ß the cat",
]


def discounts(n, stored_from):
    k = MOST_DISCOUNTED
    top = (k + 1) * n.get(k + 1, 0) / n[1] if n.get(1) else 1.0
    out = {}
    for r in range(1, k + 1):
        d = ((r + 1) * n.get(r + 1, 0) / (r * n[r]) - top) / (1 - top) if n.get(r) and top < 1 else 1.0
        out[r] = 0.0 if r < stored_from else d if 0 < d <= 1 else 1.0
    return out


def plain(rows):
    tokens = lambda t: [w.decode() for w in (t or "").encode().lower().split()] + ["</s>"]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    train = [tokens(t) for i, t in rows if not held(i)]
    uni = Counter(w for t in train for w in t)
    ctx = Counter(w for t in train for w in ["<s>", *t[:-1]])
    pair = Counter(p for t in train for p in zip(["<s>", *t], t))
    total, distinct = sum(uni.values()), len(uni)
    d1 = discounts(Counter(uni.values()), 1)
    kept = sum(c * d1.get(c, 1.0) for c in uni.values())
    seats = total if kept < total * (1 - 1e-6) else total + 1
    p1 = {w: c * d1.get(c, 1.0) / seats for w, c in uni.items()}
    unk = max(seats - kept, 1.0) / seats
    d2 = discounts(Counter(pair.values()), 2)
    by = defaultdict(dict)
    for (v, w), c in pair.items():
        if c > 1:
            by[v][w] = c * d2.get(c, 1.0)
    full, weight = {}, {}
    for v, row in by.items():
        mass = sum(row.values())
        full[v] = ctx[v] if mass < ctx[v] * (1 - 1e-9) else ctx[v] + 1
        weight[v] = (1 - mass / full[v]) / max(1 - sum(p1[w] for w in row), 1e-12)

    def prob(v, w):
        return by[v][w] / full[v] if w in by.get(v, ()) else weight.get(v, 1.0) * p1.get(w, unk)

    out = {}
    for i, t in rows:
        own = tokens(t)
        base = sum(math.log10((uni[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in own)
        score = sum(math.log10(prob(v, w)) for v, w in zip(["<s>", *own], own))
        out[i] = held(i), len(own), sum(uni[w] > 0 for w in own), total, base, score
    if unk + sum(p1.values()) <= 1 + 1e-9:
        for v in ctx:
            assert abs(sum(prob(v, w) for w in uni) + prob(v, "never seen") - 1) < 1e-9
    return out


def same(df, rows, **options):
    got = {r["doc_id"]: r for r in katz_scores(df, **options).collect()}
    want = plain(rows)
    assert got.keys() == want.keys()
    for i, w in want.items():
        g = got[i]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == w[:4], i
        assert abs(g.base_score - w[4]) < 1e-6 and abs(g.score - w[5]) < 1e-6, (i, g, w)


def test_small_texts(spark):
    rows = list(enumerate(TEXTS * 3))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string")
    same(df, rows)
    same(df, rows, most_common=3, flush_words=40, filter_bits=16)


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    same(df, [(r.doc_id, r.text) for r in df.collect()], most_common=500, flush_words=5000)


def test_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (None, "x")], "doc_id long, text string")
    assert sorted(r.n_tokens for r in katz_scores(df).collect()) == [2, 3, 3]
    assert katz_scores(df.limit(0)).count() == 0
    only_held = spark.createDataFrame([(i, "a") for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1], "doc_id long, text string")
    assert {r.score for r in katz_scores(only_held).collect()} == {0.0}
