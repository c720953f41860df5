"""Exact dedup and ring shards on awkward tables."""

import textwrap
from pathlib import Path
import hashlib
import zlib
from collections import defaultdict

from assay.llm.exact_dedup import exact_dedup
from assay.llm import licences
from assay.llm.licences import _SHORT, KNOWN, scan_licences
from assay.llm.ring_shards import ring_shards
from tests.llm.fixtures import SCHEMA, frame, rows


def test_exact_dedup_matches_grouping(spark):
    groups = defaultdict(list)
    for r in rows():
        groups[r[1] or ""].append(r[0])
    want = {i: (max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    for first, factor in ((128, 8), (1, 2), (3, 5)):
        got = {r.doc_id: tuple(r)[1:] for r in exact_dedup(frame(spark), first=first, factor=factor).collect()}
        assert got == want


def test_exact_dedup_with_repeated_and_missing_ids(spark):
    made = [(1, "same text"), (1, "same text"), (1, "same other"), (2, "same other"), (None, "x"), (3, None), (4, "")]
    df = spark.createDataFrame(made, "doc_id long, text string")
    got = sorted(tuple(r)[:4] for r in exact_dedup(df, first=2).collect())
    assert got == [(1, 1, 2, True), (1, 1, 2, True), (1, 2, 2, False), (2, 2, 2, True), (3, 4, 2, False), (4, 4, 2, True)]
    assert exact_dedup(df.limit(0)).count() == 0


def test_shards_are_balanced_gapless_and_stable(spark):
    got = ring_shards(frame(spark), shards=5, bucket_rows=7).collect()
    texts = {r[0]: (r[1] or "").encode() for r in rows()}
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]), "rows", None)
    assert len(got) == len(texts) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {(r.doc_id, r.shard, r.slot) for r in got} == {(r.doc_id, r.shard, r.slot) for r in ring_shards(frame(spark), shards=5, bucket_rows=100).collect()}


def test_one_more_shard_moves_few_rows(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "'t' AS text")
    before = {r.doc_id: r.shard for r in ring_shards(df, 16).collect()}
    after = {r.doc_id: r.shard for r in ring_shards(df, 17).collect()}
    assert sum(before[i] != s for i, s in after.items()) < 0.2 * len(before)


def test_shards_of_equal_ids_and_of_nothing(spark):
    df = spark.createDataFrame([(7, "x")] * 20 + [(None, "y")], "doc_id long, text string")
    got = ring_shards(df, shards=4).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(s, k) for s in range(4) for k in range(5)]
    assert ring_shards(df.limit(0)).count() == 0


def test_licences_by_canonical_text(spark):
    mit = KNOWN[0][1]
    texts = [
        mit, "Copyright (c) 2020 A. Author\n" + mit.upper().replace("SUBLICENSE", "sub-licence"), "* (c) someone\n" + mit, mit + " more", None, "",
        "text\nLicensed under the Apache Licence, version 2.0\nRELEASED UNDER THE MIT LICENSE\nend", "All rights reserved.",
    ]
    made = [(i, t, None, None, 0, 1, "k", "n", "p", 2) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.licence, r.notices, r.n_notices) for r in scan_licences(frame(spark, made)).collect()}
    assert [got[i][0] for i in range(8)] == ["MIT", "MIT", "MIT", None, None, None, None, "all-rights-reserved"]
    assert got[6] == (None, "Apache-2.0,MIT", 2) and got[4] == got[5] == (None, "", 0)
    assert scan_licences(spark.createDataFrame([], SCHEMA)).count() == 0


def test_published_licence_texts(spark):
    """Wrapped texts with their titles, owners and rights, as files have them."""
    wrap = lambda t, w=74: "\n".join(textwrap.wrap(t, w))
    body = {name: text for name, text in _SHORT}
    mine = "Copyright (c) 2019, Jane Doe\n"
    texts = [("ISC", f"ISC License\n\n{mine}\n" + wrap(body["ISC"], w)) for w in range(60, 90, 3)]
    texts += [("MIT", f"{title}{mine}\n{wrap(body['MIT'])}\n") for title in ("", "The MIT License (MIT)\n\n", "MIT License\n")]
    texts += [("BSD-3-Clause", f"{mine}All rights reserved.\n\n{wrap(body['BSD-3-Clause'], w)}") for w in (70, 76, 79)]
    texts += [("BSD-2-Clause", f"BSD 2-Clause License\n\nCopyright Jane Doe\nAll rights reserved.\n\n{wrap(body['BSD-2-Clause'])}")]
    texts += [("WTFPL", f"        DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\n                Version 2, December 2004\n\nCopyright (C) 2004 Sam Hocevar <sam@hocevar.net>\n\n{wrap(body['WTFPL'], 70)}\n")]
    texts += [("Unlicense", wrap(body["Unlicense"])), ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n\n" + wrap(body["BSL-1.0"]))]
    here = Path(licences.__file__).parent / "licence_texts"
    texts += [(name, (here / f"{file}.txt").read_text()) for name, file in (("Apache-2.0", "Apache-2.0"), ("GPL-2.0", "GPL-2"), ("GPL-3.0", "GPL-3"), ("LGPL-2.1", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0"))]
    made = [(i, t, None, None, 0, 1, "k", "n", "p", 2) for i, (_, t) in enumerate(texts)]
    got = {r.doc_id: r.licence for r in scan_licences(frame(spark, made)).collect()}
    assert [(i, got[i]) for i in range(len(texts))] == [(i, name) for i, (name, _) in enumerate(texts)]
