"""Logs, closed-form places and proofs against trees built level by level."""

import hashlib
import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assay.llm.merkle import append_nodes, build_manifest, folded, height_of, node, path_in, place, siblings
from tests.llm.fixtures import SCHEMA, frame, rows


def levels_of(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([node(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 300))
def test_log_holds_every_node_at_its_place(n):
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    levels = levels_of(leaves)
    log = append_nodes(leaves, height_of(n))
    assert len(log) == sum(map(len, levels))
    assert all(log[place(h, j, n)] == d for h, level in enumerate(levels) for j, d in enumerate(level))
    for i in range(n):
        path = path_in(b"".join(log), i, n, height_of(n))
        want = [lv[(i >> h) ^ 1] for h, lv in enumerate(levels[:-1]) if (i >> h) ^ 1 < len(lv)]
        assert siblings(path) == b"".join(want) and folded(leaves[i], path) == levels[-1][0]


def test_log_grows_by_appending():
    """The log of a longer table begins with the completed nodes of a shorter one."""
    leaves = [bytes([i]) * 32 for i in range(100)]
    for n in (1, 2, 37, 64, 99):
        done = 2 * n - n.bit_count()
        assert append_nodes(leaves[:n], height_of(n))[:done] == append_nodes(leaves, height_of(100))[:done]


def value(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute(made):
    """doc_id, leaf, subroot, root, proof, folded root of the tampered row, from whole levels on one machine."""
    digest = lambda i, t, lang, src, n: hashlib.sha256("".join(map(value, (i, src, lang, n, t))).encode()).digest()
    langs = sorted({r[2] for r in made}, key=lambda v: (v is not None, (v or "").encode()))
    trees = {}
    for lang in langs:
        mine = [(r[0], digest(*r[:5]), r) for r in made if r[2] == lang]
        trees[lang] = sorted(mine, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    low = {lang: levels_of([x[1] for x in t]) for lang, t in trees.items()}
    high = levels_of([low[lang][-1][0] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        for i, (doc, leaf, r) in enumerate(trees[lang]):
            hit = doc is not None and zlib.crc32(str(doc).encode()) % 7 == 0 and r[4] is not None
            at = digest(doc, r[1], lang, r[3], r[4] + 1) if hit else leaf
            proof = []
            for levels, j in ((low[lang], i), (high, k)):
                for level in levels[:-1]:
                    pair = level[j & ~1 : (j & ~1) + 2]
                    proof += [d for p, d in enumerate(pair) if p != j & 1]
                    pair[j & 1] = at
                    at, j = node(*pair), j >> 1
            out.append((doc, leaf, low[lang][-1][0], high[-1][0], b"".join(proof), at, at == high[-1][0]))
    return sorted(out, key=str)


def proved(df, bits):
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    claimed = F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    rows = build_manifest(df, {"n_chars": claimed}, bits=bits).verify().collect()
    return sorted((tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in rows), key=str)


def awkward():
    rng = random.Random(3)
    langs = [None, "", "en", "é", "zz", "中"]
    made = [(*r[:2], rng.choice(langs), r[3], rng.choice([None, 1, 99]), *r[5:]) for r in rows()]
    made += [(None, "no id", "en", None, 3, 1, "k", "n", "p", 2)] * 2 + [made[0]] * 5 + [(made[0][0], "same id", made[0][2], None, 4, 1, "k", "n", "p", 2)]
    return made


def test_manifest_matches_whole_levels_for_any_run_size(spark):
    made = awkward()
    want = brute(made)
    assert {w[-1] for w in want} == {True, False}
    for bits in (1, 3, 12):
        assert proved(frame(spark, made), bits) == want


def test_one_row_one_language_many_languages_and_nothing(spark):
    one = [(4, "x", None, None, None, 1, "k", "n", "p", 2)]
    assert proved(frame(spark, one), 2) == brute(one)
    many = [(i, "t", f"l{i}", "s", 1, 1, "k", "n", "p", 2) for i in range(37)]
    assert proved(frame(spark, many), 2) == brute(many)
    assert build_manifest(spark.createDataFrame([], SCHEMA)).verify().count() == 0


def test_a_claim_in_any_field_is_found(spark):
    df = frame(spark)
    for field, claim in (("text", F.concat("text", F.lit(" "))), ("source", F.lit("elsewhere")), ("lang", F.lit("xx"))):
        got = build_manifest(df, {field: claim}).verify()
        same = df.select("doc_id", F.col(field).cast("string").eqNullSafe(claim).alias("same"))
        assert got.join(same, "doc_id").filter("verified <> same").count() == 0
