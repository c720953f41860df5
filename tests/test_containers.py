"""Walks over files: planted damage, EXIF in and out of its segment, and every cut of a whole file."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from assay.functions.containers import JPEG_HEAD, PNG_HEAD, has_exif_marker, walk
from assay.operators import quality


def chunk(kind, data=b""):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def segment(marker, data):
    return bytes([0xFF, marker]) + struct.pack(">H", len(data) + 2) + data


HEAD = chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0))
PNG = PNG_HEAD + HEAD + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND")
FRAME, SCAN = segment(0xC0, bytes(9)), segment(0xDA, bytes(10))
CODED = b"ab\xff\x00c\xff\xd3d"  # a stuffed byte and a restart marker
JPEG = JPEG_HEAD + segment(0xE0, b"JFIF\0") + FRAME + SCAN + CODED + b"\xff\xd9"
EXIF = segment(0xE1, b"Exif\0\0II*\0")


def webp(*chunks):
    body = b"".join(k + struct.pack("<I", len(d)) + d + b"\0" * (len(d) % 2) for k, d in chunks)
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body


CASES = {
    "null": (None, ("none", "empty", False)),
    "no bytes": (b"", ("none", "empty", False)),
    "text": (b"Exif in a text", ("none", "unknown", False)),
    "png": (PNG, ("png", "ok", False)),
    "png, bytes after the end": (PNG + b"Exif\0\0", ("png", "ok", False)),
    "png, exif": (PNG_HEAD + HEAD + chunk(b"eXIf", b"II") + chunk(b"IDAT") + chunk(b"IEND"), ("png", "ok", True)),
    "png, letters": (PNG_HEAD + HEAD + chunk(b"tEXt", b"eXIf Exif\0\0") + chunk(b"IDAT") + chunk(b"IEND"), ("png", "ok", False)),
    "png, flipped": (PNG[:-14] + bytes([PNG[-14] ^ 1]) + PNG[-13:], ("png", "crc", False)),
    "png, no head chunk": (PNG_HEAD + chunk(b"IDAT") + chunk(b"IEND"), ("png", "broken", False)),
    "png, two head chunks": (PNG_HEAD + HEAD + HEAD + chunk(b"IEND"), ("png", "broken", False)),
    "png, no image": (PNG_HEAD + HEAD + chunk(b"IEND"), ("png", "broken", False)),
    "png, huge length": (PNG_HEAD + HEAD + b"\xff\xff\xff\xffIDAT1234", ("png", "cut", False)),
    "jpeg": (JPEG, ("jpeg", "ok", False)),
    "jpeg, fill bytes": (JPEG[:-2] + b"\xff\xff\xff\xd9", ("jpeg", "ok", False)),
    "jpeg, exif": (JPEG_HEAD + EXIF + JPEG[2:], ("jpeg", "ok", True)),
    "jpeg, letters in a comment": (JPEG_HEAD + segment(0xFE, b"Exif\0\0") + JPEG[2:], ("jpeg", "ok", False)),
    "jpeg, letters in the scan": (JPEG[:-2] + b"Exif\0\0\xff\xd9", ("jpeg", "ok", False)),
    "jpeg, other data in the segment": (JPEG_HEAD + segment(0xE1, b"http://ns") + JPEG[2:], ("jpeg", "ok", False)),
    "jpeg, two scans": (JPEG[:-2] + SCAN + CODED + b"\xff\xd9", ("jpeg", "ok", False)),
    "jpeg, no frame": (JPEG_HEAD + SCAN + CODED + b"\xff\xd9", ("jpeg", "broken", False)),
    "jpeg, nothing": (JPEG_HEAD + b"\xff\xd9", ("jpeg", "broken", False)),
    "jpeg, short length": (JPEG_HEAD + b"\xff\xe0\0\1" + JPEG[2:], ("jpeg", "broken", False)),
    "webp": (webp((b"VP8 ", b"abc")), ("webp", "ok", False)),
    "webp, exif": (webp((b"VP8X", bytes(10)), (b"VP8L", b"x"), (b"EXIF", b"II")), ("webp", "ok", True)),
    "webp, no image": (webp((b"EXIF", b"II")), ("webp", "broken", True)),
    "webp, cut": (webp((b"VP8 ", b"abcdef"))[:-3], ("webp", "cut", False)),
}


@pytest.mark.parametrize("name", CASES)
def test_walk(name):
    data, want = CASES[name]
    assert walk(data) == want


@pytest.mark.parametrize("data", [PNG, JPEG, JPEG_HEAD + EXIF + JPEG[2:]])
def test_every_cut_is_found(data):
    assert {walk(data[:n])[1] for n in range(1, len(data))} == {"cut"}


def test_every_flipped_bit_of_png_chunks_is_found():
    for at in range(len(PNG_HEAD), len(PNG)):
        for bit in range(8):
            flipped = PNG[:at] + bytes([PNG[at] ^ (1 << bit)]) + PNG[at + 1 :]
            assert walk(flipped)[1] != "ok", (at, bit)


def test_long_files_are_linear():
    many = PNG_HEAD + HEAD + chunk(b"IDAT", b"x" * 100) * 50_000 + chunk(b"IEND")
    assert walk(many)[1] == "ok"
    assert walk(JPEG[:-2] + b"\xff" * 2_000_000) == ("jpeg", "cut", False)
    assert walk(JPEG[:-2] + b"\xff\x00" * 2_000_000 + b"\xff\xd9") == ("jpeg", "ok", False)


def test_audits_of_tables(spark):
    files = spark.createDataFrame([(n, d) for n, (d, _) in CASES.items()], "path string, content binary")
    got = {r["path"]: (r["container"], r["state"], r["exif"]) for r in quality.container_audit(files).collect()}
    assert got == {n: want for n, (_, want) in CASES.items()}
    kinds = {r["path"]: r["kind"] for r in quality.damaged_or_tiny(files, min_bytes=100).collect()}
    want = {n: "corrupt" if w[1] != "ok" else "tiny" for n, (d, w) in CASES.items() if w[1] != "ok" or len(d) < 100}
    assert kinds == want
    marks = {r["path"]: r["m"] for r in files.select("path", has_exif_marker(F.col("content")).alias("m")).collect()}
    assert {n for n, m in marks.items() if m == 1.0} == {n for n, (_, w) in CASES.items() if w[2]}
    assert quality.damaged_or_tiny(files.limit(0)).count() == 0
