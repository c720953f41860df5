"""Walks over the containers of image files: is a file whole, and does it carry EXIF data. No pixel is decoded.

A walk follows the lengths that the file states, so its steps are the chunks or segments of the file and not its bytes.
"""

from __future__ import annotations

import re
import struct
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values of the formats
PNG_HEAD = b"\x89PNG\r\n\x1a\n"
JPEG_HEAD = b"\xff\xd8"
EXIF_HEAD = b"Exif\x00\x00"
FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
BARE = frozenset([0x01, *range(0xD0, 0xD9)])
# the end of entropy-coded data: a marker that is neither a stuffed byte nor a restart
AFTER_SCAN = re.compile(rb"\xff[^\x00\xff\xd0-\xd7]")

Found = tuple[str, str, bool]


def walk(data: bytes | None) -> Found:
    """(container, state, exif) of a file.

    States: ``ok``; ``empty`` for no bytes or null; ``unknown`` for a signature of none of PNG, JPEG and WebP; ``cut`` if
    the bytes end before the container does; ``crc`` if a checksum is wrong; ``broken`` if the structure is impossible or
    the image data is missing. Bytes after the end of the container are ignored, as decoders do.
    """
    if not data:
        return "none", "empty", False
    if data.startswith(PNG_HEAD):
        return "png", *_png(data)
    if data.startswith(JPEG_HEAD):
        return "jpeg", *_jpeg(data)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "webp", *_webp(data)
    cut = any(head.startswith(data) for head in (PNG_HEAD, JPEG_HEAD))
    return "none", "cut" if cut else "unknown", False


def _png(data: bytes) -> tuple[str, bool]:
    at, exif, pixels = len(PNG_HEAD), False, False
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        end = at + 12 + size
        if (kind == b"IHDR") != (at == len(PNG_HEAD)):
            return "broken", exif
        if end > len(data):
            return "cut", exif
        if zlib.crc32(memoryview(data)[at + 4 : end - 4]) != struct.unpack_from(">I", data, end - 4)[0]:
            return "crc", exif
        exif |= kind == b"eXIf"
        pixels |= kind == b"IDAT"
        if kind == b"IEND":
            return ("ok" if pixels else "broken"), exif
        at = end
    return "cut", exif


def _jpeg(data: bytes) -> tuple[str, bool]:
    at, exif, frame, scan = 2, False, False, False
    while at + 1 < len(data):
        if data[at] != 0xFF:
            return "broken", exif
        while at + 1 < len(data) and data[at + 1] == 0xFF:  # fill bytes
            at += 1
        if at + 1 == len(data):
            break
        marker, at = data[at + 1], at + 2
        if marker == 0xD9:
            return ("ok" if frame and scan else "broken"), exif
        if marker in BARE:
            continue
        if at + 2 > len(data):
            break
        (size,) = struct.unpack_from(">H", data, at)
        if size < 2:
            return "broken", exif
        if at + size > len(data):
            break
        exif |= marker == 0xE1 and data.startswith(EXIF_HEAD, at + 2)
        frame |= marker in FRAMES
        at += size
        if marker == 0xDA:
            if not frame:
                return "broken", exif
            scan, end = True, AFTER_SCAN.search(data, at)
            if end is None:
                break
            at = end.start()
    return "cut", exif


def _webp(data: bytes) -> tuple[str, bool]:
    end = 8 + struct.unpack_from("<I", data, 4)[0]
    if end > len(data):
        return "cut", False
    at, exif, pixels = 12, False, False
    while at + 8 <= end:
        kind, size = struct.unpack_from("<4sI", data, at)
        if at + 8 + size > end:
            return "broken", exif
        exif |= kind == b"EXIF"
        pixels |= kind in (b"VP8 ", b"VP8L", b"ANMF")
        at += 8 + size + (size & 1)
    return ("ok" if pixels else "broken"), exif


FOUND = T.StructType([T.StructField("container", T.StringType()), T.StructField("state", T.StringType()), T.StructField("exif", T.BooleanType())])


@F.pandas_udf(FOUND)
def _inspect(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([walk(c) for c in content], columns=FOUND.names)


def inspect(content: Column) -> Column:
    """Struct (container, state, exif) of each file; see ``walk``."""
    return _inspect(content.cast("binary"))


def has_exif_marker(content: Column) -> Column:
    """1.0 when the file has an EXIF block where its container keeps one, 0.0 otherwise and for unreadable files."""
    return inspect(content)["exif"].cast("double")
