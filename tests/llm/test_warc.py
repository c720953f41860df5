"""Archives and their index: exact round trips, revisits, binary search over blocks, lost tasks."""

import gzip
import hashlib
import os
import random
from collections import defaultdict

from pyspark.sql import functions as F

from assay.llm.warc import archive_pages, page_record, parsed, read_pages, surt

SCHEMA = "page_id long, url string, html string, file string, key int"


def made(seed=5, n=200):
    rng = random.Random(seed)
    bodies = ["<p>" + "common " * 40 + "</p>", "<p>" + "é中😀" * 50, "x" * 99, "y" * 100, "short", "", None, "\r\n\r\nWARC/1.1\r\n" * 20, "z" * 300_000]
    urls = ["http://a.example.org/x", "https://user@WWW.Example.ORG:8080/a?b=c#d", "http://b.example.net", None, "", "no address", "http://a.example.org/tab\tnew\nline\\", "http://ünï.example/ pfad"]
    rows = [(i, rng.choice(urls) if i % 3 else "http://hot.example.com/", rng.choice(bodies) if i % 2 else f"<b>{i}</b>" * rng.randint(0, 60), "f", 1) for i in range(n)]
    rows += [(-5, urls[0], bodies[0], "f", 1), (None, urls[0], bodies[0], "f", 1), (2**62, urls[2], bodies[1], "f", 1)]
    rng.shuffle(rows)
    return rows


def brute(rows):
    held = defaultdict(list)
    for i, _, html, *_ in rows:
        if i is not None:
            held[(html or "").encode()].append(i)
    out = []
    for body, ids in held.items():
        for i in ids:
            first = None if len(body) < 100 or i == min(ids) else min(ids)
            out.append((i, "response" if first is None else "revisit", first, hashlib.sha256(body).hexdigest(), len(body), None if first is not None else body))
    return sorted(out, key=str)


def back(index, df, **kw):
    got = read_pages(index, df.select("page_id", "url").filter("page_id IS NOT NULL"), **kw).collect()
    return sorted((tuple(r)[:5] + (bytes(r.payload) if r.payload is not None else None,) for r in got), key=str)


def test_every_page_comes_back_whatever_the_sizes(spark):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(rows)
    assert back(archive_pages(df), df) == want
    small = archive_pages(df, hot_rows=3, block_lines=4, file_lines=30, file_bytes=3000)
    assert len(small.files) > 3 and back(small, df) == want
    narrow = [w[:5] + (None,) for w in want]
    assert back(small, df, payloads=False) == narrow


def test_repeated_rows_are_records_of_their_own(spark):
    rows = [(7, "http://a.b/c", "q" * 150, "f", 1)] * 9 + [(8, "http://a.b/c", "q" * 150, "f", 1)] * 3 + [(7, "http://a.b/c", "other", "f", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    index = archive_pages(df, block_lines=2, file_lines=4)
    assert back(index, df) == brute(rows)


def test_lookup_of_some_pages_and_of_unknown_ones(spark):
    df = spark.createDataFrame(made(), SCHEMA)
    index = archive_pages(df, block_lines=5, file_lines=40)
    wanted = df.filter("page_id % 10 = 3").select("page_id", "url").unionAll(spark.createDataFrame([(10**6, "http://nowhere.example/"), (3, "http://zzz/")], "page_id long, url string"))
    assert {r.page_id for r in read_pages(index, wanted).collect()} == {i for i in range(200) if i % 10 == 3}
    assert index.directory.agg(F.sum("lines")).first()[0] == 202
    # Blocks hold sorted lines, and the directory their first ones.
    blocks = index.directory.orderBy("first").collect()
    lines = []
    for b in blocks:
        with open(os.path.join(index.folder.removeprefix("file://"), b.file), "rb") as f:
            f.seek(b.at)
            block = gzip.decompress(f.read(b["size"])).split(b"\n")
        assert block[0].startswith(bytes(b.first)) and len(block) == b.lines
        lines += block
    assert [x.rsplit(b"\t", 3)[0] for x in lines] == sorted(x.rsplit(b"\t", 3)[0] for x in lines)


def test_files_are_plain_gzip_of_records(spark):
    df = spark.createDataFrame(made(n=20), SCHEMA)
    index = archive_pages(df)
    folder, n = index.archives.removeprefix("file://"), 0
    for name in os.listdir(folder):
        if name.endswith(".warc.gz"):
            data = gzip.open(os.path.join(folder, name)).read()
            n += data.count(b"WARC-Record-ID: <urn:page:")
            assert data.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and data.endswith(b"\r\n\r\n")
    assert n == 22


def test_files_of_lost_tasks_are_not_read(spark):
    df = spark.createDataFrame(made(n=30), SCHEMA)
    index = archive_pages(df)
    folder = index.archives.removeprefix("file://")
    with open(os.path.join(folder, "pages-lost.warc.gz"), "wb") as f:
        f.write(page_record(1, "http://a.example.org/x", b"of an attempt that was lost", None))
    assert back(index, df) == brute(made(n=30))


def test_record_round_trip_and_keys(spark):
    headers, block = parsed(page_record(3, "http://a/ b\n\x7f", b"", None))
    assert headers["warc-target-uri"] == "http://a/%20b%0A%7F" and block.endswith(b"Content-Length: 0\r\n\r\n")
    urls = ["https://u@WWW.Example.ORG:80/a?b", "http://x", None, "plain", ""]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(surt(F.col("u"))).collect()]
    assert got == ["org,example,www)/a?b", "x)", ")", ")plain", ")"]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert read_pages(archive_pages(df), df.select("page_id", "url")).count() == 0
