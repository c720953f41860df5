"""Shingle join, block anchors and the positional index against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from assay.llm import shingle_join as shingle_join_module
from assay.llm.block_anchors import drop_repeats
from assay.llm.positional_index import decontaminate, named, postings, proximity
from assay.llm.shingle_join import shingle_join
from tests.llm.fixtures import SCHEMA, frame, rows


def components_by_force(made):
    sets = {}
    for i, text, *_ in made:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent, having = {i: i for i in sets}, defaultdict(list)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in sets.items():
        shared = Counter(j for g in s for j in having[g])
        for j, k in shared.items():
            if 100 * k >= 80 * (len(s) + len(sets[j]) - k) and root(i) != root(j):
                parent[max(root(i), root(j))] = min(root(i), root(j))
        for g in s:
            having[g].append(i)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("block", [4, 1000])
def test_shingle_join(spark, block):
    made = rows(n=40)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join(frame(spark, made), block=block, usual=3, tile=block).collect()}
    assert got == components_by_force(made)


def test_shingle_join_of_little(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "A B C"), (3, None), (None, "q")], "doc_id long, text string")
    assert sorted(map(tuple, shingle_join(df).collect())) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 0, 3)]
    assert shingle_join(spark.createDataFrame([], SCHEMA)).count() == 0


def repeats_by_force(made, window):
    words = [(i, (t or "").encode().split()) for i, t, *_ in made]
    seen = Counter(tuple(w[k : k + window]) for _, w in words for k in range(len(w) - window + 1))
    out = {}
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i] = len(w), sum(gone), hashlib.sha256(kept).hexdigest()
    return out


@pytest.mark.parametrize(("window", "flush_words", "filter_bits"), [(35, 1 << 20, 27), (35, 300, 14), (8, 1000, 27), (1, 500, 20)])
def test_repeats(spark, window, flush_words, filter_bits):
    made = rows()
    got = drop_repeats(frame(spark, made), window=window, flush_words=flush_words, filter_bits=filter_bits).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == repeats_by_force(made, window)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)


def test_repeats_of_nothing(spark):
    assert drop_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    twice = spark.createDataFrame([(1, "a " * 5 + "b"), (1, "a " * 5 + "b"), (None, "z")], "doc_id long, text string")
    assert [(r.doc_id, r.n_removed) for r in drop_repeats(twice, window=6).collect()] == [(1, 6), (1, 6)]


PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hits_by_force(made, items, size):
    words = lambda t: PATTERN.findall((t or "").translate(LOWER))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[k : k + size])].add(str(i))
    out = {}
    for i, t, *_ in made:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    found |= own
                    hit |= set(range(k, k + n))
        out[i] = len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)
    return out


@pytest.mark.parametrize("block_terms", [200_000, 7])
def test_decontamination(spark, block_terms):
    made = rows(n=25)
    texts = [r[1] for r in made if r[1] and len(r[1]) > 300]
    items = [(k, t[20:200]) for k, t in enumerate(texts[:20])] + [(90, "the"), (91, "w1 W2"), (92, None), (93, ""), (94, "...!"), (95, "never seen words here"), (95, "über"), (None, "of")]
    table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, window string")
    want = hits_by_force(made, [x for x in items if x[0] is not None], 10)
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate(frame(spark, made), table, block_terms=block_terms).collect()}
    assert got == want
    empty = decontaminate(frame(spark, made), table.limit(0)).collect()
    assert len(empty) == len(made) and not any(r.contaminated for r in empty)
    assert decontaminate(spark.createDataFrame([], SCHEMA), table).count() == 0


def test_proximity(spark):
    texts = ["alpha x x beta x gamma", "alpha beta gamma", "alpha " + "x " * 9 + "beta gamma", "beta gamma", None]
    docs = named(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text")
    index = postings(docs, spark.createDataFrame([("alpha",), ("beta",), ("gamma",)], "term string"))
    queries = spark.createDataFrame([("q", ["alpha", "beta", "gamma"]), ("r", ["gamma", "beta"]), ("s", [])], "query string, terms array<string>")
    got = {(r.query, r.doc_id): (r.at, r.width) for r in proximity(index, queries, 6).collect()}
    assert got == {("q", 0): (0, 6), ("q", 1): (0, 3), ("r", 0): (3, 3), ("r", 1): (1, 2), ("r", 2): (10, 2), ("r", 3): (0, 2)}


def test_long_words_of_two_letters_are_told_apart(spark):
    """Words that polynomial hashes modulo 2**64 take for equal link nothing and remove nothing."""
    one = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))
    two = one.translate(str.maketrans("ab", "ba"))
    words = [f"w{i}" for i in range(34)]
    texts = [one, two, " ".join([*words[:17], one, *words[17:]]), " ".join([*words[:17], two, *words[17:]])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in shingle_join(df).collect()} == components_by_force_ids(texts)
    assert [r.n_removed for r in drop_repeats(df).collect()] == [0, 0, 0, 0]


def components_by_force_ids(texts):
    return {i: c for i, (_, c) in components_by_force(list(enumerate(texts))).items()}


def test_many_documents_made_of_a_few_shared_passages(spark):
    """Every shingle is common: sets share many tokens without being near, and near ones are still all found."""
    import random

    rng = random.Random(11)
    passages = [" ".join(f"p{k}x{i}" for i in range(30)) for k in range(12)]
    made = []
    for i in range(300):
        parts = rng.sample(passages, rng.randint(2, 5))
        made.append((i, " ".join(parts)))
        if i % 3 == 0:
            made.append((1000 + i, " ".join(parts) + " tail" * (i % 2)))
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(4)
    for block in (5, 1000):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join(df, block=block, usual=3, tile=block).collect()}
        assert got == components_by_force(made)


def test_pairs_need_room_behind_the_first_shared_token(spark):
    """Sets of 90 that share no token before the place 15 have at most 75 in common, and need 80: no pair is made of them."""
    sets = [(i, (90, *[0] * shingle_join_module.LONGS)) for i in range(4)]
    kind = "id bigint, s struct<n: bigint, " + ", ".join(f"{b}: bigint" for b in shingle_join_module.BITMAP) + ">"
    light = spark.createDataFrame(sets, kind)
    met = spark.createDataFrame([(1, 0, 90, 15), (1, 1, 90, 15), (2, 2, 90, 10), (2, 3, 90, 10)], "token bigint, id bigint, n int, pos int")
    assert [(r.a, r.b) for r in shingle_join_module._cross_pairs(met, light, None, 8000).collect()] == [(2, 3)]


def rows_of_joins(plan):
    """Rows that the joins of an executed plan have made, besides those that bring bitmaps to their ids."""
    name, inner = plan.nodeName(), [plan.children().apply(i) for i in range(plan.children().size())]
    if name.startswith("AdaptiveSparkPlan"):
        inner = [plan.executedPlan()]
    elif "QueryStage" in name:
        inner = [plan.plan()]
    own = plan.metrics().get("numOutputRows").get().value() if "Join" in name and plan.condition().isDefined() else 0
    return own + sum(map(rows_of_joins, inner))


def test_pairs_of_a_crowded_token_that_fail_their_bitmaps_are_never_rows(spark):
    """A group of copies that are too far apart to link, but for three pairs: the pairs of the group are its square."""
    rng = np.random.default_rng(3)
    bits = [rng.integers(-(2**62), 2**62, shingle_join_module.LONGS).tolist() for _ in range(300)]
    for i in range(3):
        bits[i] = bits[299 - i]
    kind = "id bigint, s struct<n: bigint, " + ", ".join(f"{b}: bigint" for b in shingle_join_module.BITMAP) + ">"
    light = spark.createDataFrame([(i, (140 + i % 7, *b)) for i, b in enumerate(bits)], kind)
    met = spark.createDataFrame([(token, i, 140 + i % 7, 3) for token in (1, 2) for i in range(300)], "token bigint, id bigint, n int, pos int")
    pairs = shingle_join_module._cross_pairs(met, light, None, 100)
    assert {frozenset((r.a, r.b)) for r in pairs.collect()} == {frozenset((i, 299 - i)) for i in range(3)}
    assert rows_of_joins(pairs._jdf.queryExecution().executedPlan()) == 6


def test_sketches_keep_every_linked_pair():
    rng = np.random.default_rng(5)
    for n in (3, 40, 700, 5000):
        one = np.unique(rng.integers(-(2**62), 2**62, n))
        for share in (1.0, 0.89, 0.6):
            two = np.unique(np.concatenate([rng.permutation(one)[: max(1, int(n * share))], rng.integers(-(2**62), 2**62, n - int(n * share))]))
            fit, link = (f(*map(form, (one, two))) for form, f in ((shingle_join_module.sketch, shingle_join_module.sketches_fit), (np.ndarray.tobytes, shingle_join_module.sets_link)))
            assert fit or not link
            assert not (fit and share == 0.6 and n > 40)
