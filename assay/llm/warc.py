"""WARC archives of pages, and a two-level capture index over them.

Archives are gzip members, one a record, in files of a bounded size. The index holds a line a record under its key, the
host's labels in reverse order and the path; lines are sorted over all files, cut into compressed blocks, and a sparse
directory keeps the first key and the byte range of each block. A lookup is a binary search among the index files, one in
the directory of a file and one in a block; then the record is read by its byte range.

Tasks write files under names of their own and return where each record lies. Only what a finished task returned is
ever read, so a task that is lost and run again leaves no double records. Files go to the shared scratch folder through
Arrow's file systems (local, HDFS, S3, GCS, ABFS).
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm.tables import stored
from assay.session import scratch_dir

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
FILE_BYTES, GAP = 256 << 20, 64 << 10


def surt(url: Column) -> Column:
    """The sort key of an address: ``org,example,www)/path?query``; the host in lower case, without port, user or scheme.

    What has no host counts as path alone: ``)`` and the text. Null has the key ``)``.
    """
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest), F.lit(")"))


def record(kind: str, name: str, headers: dict[str, str], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    lines = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}"]
    lines += [f"{k}: {v}" for k, v in headers.items() if v is not None] + [f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n", 5, mtime=0)


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record; it must be whole."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    size = int(headers["content-length"])
    if version != VERSION or rest[size:] != b"\r\n\r\n":
        raise ValueError("broken record")
    return headers, rest[:size]


def _uri(url: str | None, page: int) -> str:
    """The address on one line of a header; control characters and blanks are escaped."""
    if not url:
        return f"urn:page:{page}"
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def page_record(page: int, url: str | None, payload: bytes, first: int | None) -> bytes:
    """A response, or a revisit of the response ``first``, which holds the same payload."""
    digest = hashlib.sha256(payload).hexdigest()
    headers = {"WARC-Target-URI": _uri(url, page), "WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": "application/http;msgtype=response"}
    http = f"{HTTP}Content-Length: {len(payload)}\r\n\r\n".encode()
    if first is None:
        return record("response", f"urn:page:{page}", headers, http + payload)
    headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{first}>"}
    return record("revisit", f"urn:page:{page}", headers, http)


def decided(pages: DataFrame, least: int, hot_rows: int) -> DataFrame:
    """Pages (``page_id, url, payload``) with ``first``: the page that a revisit refers to, null for responses.

    Minima per digest are combined before the shuffle. The few groups above ``hot_rows`` rows are a table by themselves,
    at most one row for each ``hot_rows`` pages; its real size decides the broadcast, and their pages skip the shuffle by
    digest that joins the others.
    """
    keyed = pages.withColumn("digest", F.when(F.length("payload") >= least, F.unhex(F.sha2("payload", 256))))
    groups = keyed.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("page_id").alias("holder"), F.count("*").alias("c"))
    groups = stored(groups.filter("c > 1"))
    hot, cold = groups.filter(F.col("c") > hot_rows), groups.filter(F.col("c") <= hot_rows).select("digest", "holder")
    hot = stored(hot.select(F.col("digest").alias("h"), F.col("holder").alias("hot_holder")))
    marked = keyed.join(hot, F.col("digest") == F.col("h"), "left").drop("h")
    # A pair of types keeps pages that need no partner apart from each other: their key is their own id.
    pair = F.when(F.col("digest").isNotNull() & F.col("hot_holder").isNull(), F.col("digest")).otherwise(F.col("page_id").cast("string").cast("binary"))
    joined = marked.withColumn("pair", pair).join(cold.withColumnRenamed("digest", "pair"), "pair", "left")
    holder = F.coalesce("hot_holder", "holder")
    return joined.select("page_id", "url", "payload", F.when(holder != F.col("page_id"), holder).alias("first"))


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    system, path = fs.FileSystem.from_uri(folder)
    return system, path


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record a page; the rows say where: ``key, page_id, file, at, size``. Evaluate it once, as a stored table."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _open(folder)
        system.create_dir(path, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for key, page, url, payload, first in zip(*[batch.column(c).to_pylist() for c in ("key", "page_id", "url", "payload", "first")]):
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{path}/{name}", compression=None)
                        info = record("warcinfo", f"urn:uuid:{uuid.uuid4()}", {"WARC-Filename": name, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")
                        out.write(info)
                        at = len(info)
                    member = page_record(page, url, payload, first)
                    out.write(member)
                    rows.append((key, page, name, at, len(member)))
                    at += len(member)
                yield _rows(rows, _PLACES)
        finally:
            if out is not None:
                out.close()

    keyed = pages.select(surt(F.col("url")).alias("key"), "page_id", "url", "payload", "first")
    return keyed.mapInArrow(write, "key string, page_id long, file string, at long, size long")


_PLACES = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("at", pa.int64()), ("size", pa.int64())])
_BLOCKS = pa.schema([("first", pa.binary()), ("file", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("lines", pa.int64())])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema.types)], schema=schema)


def _reaching(firsts: list[bytes], line: bytes) -> Iterator[int]:
    """Which of the sorted stretches may hold the line: the last that starts at or before it, and those before that start with it."""
    k = max(0, bisect_right(firsts, line) - 1)
    yield k
    while k and firsts[k] == line:
        k -= 1
        yield k


def _line() -> Column:
    """The sorted part of an index line: key and number of the page, so that equal addresses stand apart."""
    escaped = F.replace(F.replace(F.replace(F.col("key"), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
    number = (F.col("page_id").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string")
    return F.concat(escaped, F.lit("\t"), F.lpad(number, 20, "0")).cast("binary")


def write_index(places: DataFrame, folder: str, block_lines: int, file_lines: int) -> DataFrame:
    """Writes the sorted blocks; the rows are the sparse directory: ``first, file, at, size, lines`` of each block."""
    n_files = max(1, -(-places.count() // file_lines))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _open(folder)
        system.create_dir(path, recursive=True)
        name, out, at, held = f"index-{uuid.uuid4().hex}.gz", None, 0, []

        def block() -> tuple:
            nonlocal at
            data = gzip.compress(b"\n".join(b"%s\t%s\t%d\t%d" % row for row in held), 6, mtime=0)
            out.write(data)
            made = (held[0][0], name, at, len(data), len(held))
            at += len(data)
            held.clear()
            return made

        try:
            for batch in batches:
                rows = []
                for line, file, start, size in zip(*[batch.column(c).to_pylist() for c in ("line", "file", "at", "size")]):
                    out = out or system.open_output_stream(f"{path}/{name}", compression=None)
                    held.append((line, file.encode(), start, size))
                    if len(held) == block_lines:
                        rows.append(block())
                if rows:
                    yield _rows(rows, _BLOCKS)
            if held:
                yield _rows([block()], _BLOCKS)
        finally:
            if out is not None:
                out.close()

    lines = places.select(_line().alias("line"), "file", "at", "size")
    spread = lines.repartitionByRange(n_files, "line", "file", "at").sortWithinPartitions("line", "file", "at")
    return spread.mapInArrow(write, "first binary, file string, at long, size long, lines long")


@dataclass
class CaptureIndex:
    """``directory`` has a row a block, ``files`` the first key and name of each index file in the order of keys."""

    spark: SparkSession
    archives: str
    folder: str
    directory: DataFrame
    files: list[tuple[bytes, str]]

    def places(self, wanted: DataFrame) -> DataFrame:
        """Of ``url, page_id`` rows those that are indexed: ``page_id, file, at, size``, by binary search.

        Rows go to the task of their index file in the order of keys, so a task reads a directory once and each block once.
        """
        firsts, names, folder = [f for f, _ in self.files], [n for _, n in self.files], self.folder
        if not names:
            return self.spark.createDataFrame([], "page_id long, file string, at long, size long")

        def which(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for line, page in zip(batch.column("line").to_pylist(), batch.column("page_id").to_pylist()):
                    out += [(line, page, k) for k in _reaching(firsts, line)]
                columns = zip(*out) if out else [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int32()))], names=["line", "page_id", "part"])

        def search(left: pa.Table, right: pa.Table) -> pa.Table:
            out = []
            if left.num_rows and right.num_rows:
                blocks = sorted(zip(*[right.column(c).to_pylist() for c in ("first", "at", "size")]))
                starts, (held, keys, lines) = [b[0] for b in blocks], (None, [], [])
                system, path = _open(folder)
                with system.open_input_file(f"{path}/{names[left.column('part')[0].as_py()]}") as file:
                    for line, page in sorted(zip(left.column("line").to_pylist(), left.column("page_id").to_pylist())):
                        for k in _reaching(starts, line):
                            if k != held:
                                file.seek(blocks[k][1])
                                lines = gzip.decompress(file.read(blocks[k][2])).split(b"\n")
                                keys, held = [x.rsplit(b"\t", 3)[0] for x in lines], k
                            for i in range(bisect_left(keys, line), bisect_right(keys, line)):
                                name, at, size = lines[i].rsplit(b"\t", 3)[1:]
                                out.append((page, name.decode(), int(at), int(size)))
            return pa.Table.from_batches([_rows(out, _PLACES.remove(0))])

        lines = wanted.select(surt(F.col("url")).alias("key"), "page_id").distinct().select(_line().alias("line"), "page_id")
        dealt = lines.mapInArrow(which, "line binary, page_id long, part int")
        parts = self.spark.createDataFrame([(n, i) for i, n in enumerate(names)], "file string, part int")
        blocks = self.directory.join(F.broadcast(parts), "file").select("part", "first", "at", "size")
        found = dealt.groupBy("part").cogroup(blocks.groupBy("part")).applyInArrow(search, "page_id long, file string, at long, size long")
        return found

    def read(self, places: DataFrame, payloads: bool = True, gap: int = GAP) -> DataFrame:
        """The records at ``file, at, size``: ``page_id, record_type, refers_to, payload_digest, payload_bytes, payload``.

        Places of a file go to one task by their stretch of the file, in the order of their bytes; ranges that lie closer
        than ``gap`` are read at once. The payload of a response is checked against its digest; a revisit has none, its
        digest and size come from its own headers. ``payloads`` off leaves the payload null.
        """
        folder = self.archives
        schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])

        def number(name: str | None) -> int | None:
            return None if name is None else int(name.strip("<>").removeprefix("urn:page:"))

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            system, path = _open(folder)
            name, file = None, None
            try:
                for batch in batches:
                    out, weight = [], 0
                    for run_name, ranges in _runs(zip(*[batch.column(c).to_pylist() for c in ("file", "at", "size")]), gap):
                        if run_name != name:
                            if file is not None:
                                file.close()
                            name, file = run_name, system.open_input_file(f"{path}/{run_name}")
                        start = ranges[0][0]
                        file.seek(start)
                        data = file.read(ranges[-1][0] + ranges[-1][1] - start)
                        for at, size in ranges:
                            headers, block = parsed(data[at - start : at - start + size])
                            kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha256:")
                            http, _, payload = block.partition(b"\r\n\r\n")
                            length = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
                            if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
                                raise ValueError(f"payload of {headers['warc-record-id']} does not match its digest")
                            held = payload if payloads and kind == "response" else None
                            out.append((number(headers["warc-record-id"]), kind, number(headers.get("warc-refers-to")), digest, length, held))
                            weight += len(held or b"")
                            if weight > 16 << 20:
                                yield _rows(out, schema)
                                out, weight = [], 0
                    if out:
                        yield _rows(out, schema)
            finally:
                if file is not None:
                    file.close()

        stretch = (F.col("at") / (16 << 20)).cast("long")
        n_tasks = max(1, -(-places.agg(F.sum("size")).first()[0] // (16 << 20))) if not places.isEmpty() else 1
        ordered = places.repartition(n_tasks, F.col("file"), stretch).sortWithinPartitions("file", "at")
        return ordered.mapInArrow(fetch, "page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary")


def _runs(rows: Iterable[tuple[str, int, int]], gap: int, most: int = 8 << 20) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Ranges of one file that lie close together; a run ends at ``most`` bytes."""
    name, run = None, []
    for file, at, size in rows:
        if run and (file != name or at > run[-1][0] + run[-1][1] + gap or at + size - run[0][0] > most):
            yield name, run
            run = []
        name = file
        run.append((at, size))
    if run:
        yield name, run


def archive_pages(
    df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    least: int = 100, hot_rows: int = 20_000, block_lines: int = 3000, file_lines: int = 300_000, file_bytes: int = FILE_BYTES,
) -> CaptureIndex:
    """Archives of all pages in the shared scratch folder, and their index.

    The payload is the text in UTF-8, a null text counts as empty. Of pages with equal payloads of ``least`` bytes or
    more the one with the smallest id is a response and the others revisit it; rows that repeat this id and payload are
    responses too. Rows without an id cannot be named and are left out. A null or empty address is ``urn:page:<id>`` in the
    record. An empty table gives an index without files. Other columns are not read.
    """
    spark, folder = df.sparkSession, scratch_dir(df.sparkSession)
    payload = F.coalesce(F.col(f"`{html_col}`"), F.lit("")).cast("binary")
    pages = df.filter(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload"))
    archives, index = f"{folder}/archives", f"{folder}/index"
    places = stored(write_archives(decided(pages, least, hot_rows), archives, file_bytes))
    directory = stored(write_index(places, index, block_lines, file_lines))
    files = directory.groupBy("file").agg(F.min("first").alias("first")).orderBy("first")
    # One row for each index file, that is for each file_lines pages.
    return CaptureIndex(spark, archives, index, directory, [(bytes(r["first"]), r["file"]) for r in files.toLocalIterator()])



def read_pages(index: CaptureIndex, wanted: DataFrame, payloads: bool = True) -> DataFrame:
    """The record of every wanted page (``page_id, url``) that is indexed, found by the index and read by its range."""
    return index.read(stored(index.places(wanted)), payloads)
