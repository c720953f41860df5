"""64-bit hashes of words and of runs of words, and filters of bounded size over them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash

# An odd multiplier for rolling sums and the two of a 64-bit finalizer. Fixed values.
ROLL, MIX, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX2)
    return x ^ (x >> np.uint64(31))


_BREAK = re.compile(rb"[ \t-\r]")
CHUNK = 1 << 22


def word_hashes(data: bytes, lower: bool = False) -> np.ndarray:
    """64-bit hashes of the words of a text in UTF-8: runs of bytes other than ASCII white space, as ``bytes.split`` cuts them.

    XXH3 of each word's bytes; ``lower`` counts A to Z as a to z. Long texts are taken in chunks that end at white space.
    """
    if len(data) > CHUNK and (end := _BREAK.search(data, CHUNK)):
        parts, at = [], 0
        while end:
            parts.append(word_hashes(data[at : end.start()], lower))
            at = end.end()
            end = _BREAK.search(data, at + CHUNK) if at + CHUNK < len(data) else None
        return np.concatenate([*parts, word_hashes(data[at:], lower)])
    words = (data.lower() if lower else data).split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def rolled(h: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of ``width`` words; as long as ``h``, with zeros where no run starts.

    Runs of 1, 2, 4, ... words are joined to the width. Every joint is mixed, so that no sum over a run can cancel out;
    different seeds give independent hashes of the same run.
    """
    out = np.zeros(len(h), np.uint64)
    size = len(h) - width + 1
    if size <= 0:
        return out
    power, step, done, run = mixed(h ^ np.uint64(seed)), 1, 0, None
    while True:
        if width & step:
            part = power[done : done + size]
            run = part if run is None else mixed(run * np.uint64(ROLL) + part)
            done += step
            if done == width:
                out[:size] = run
                return out
        power = mixed(power[:-step] * np.uint64(ROLL) + power[step:])
        step *= 2


def by_part(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Slices of sorted keys by their leading bits."""
    if len(keys):
        part = (keys >> np.uint64(64 - bits)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        for a, b in zip(starts, [*starts[1:], len(keys)]):
            yield int(part[a]), slice(a, b)


def packed(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each value."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(blob: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").ravel()


def rest_of(keys: np.ndarray, bits: int, width: int) -> np.ndarray:
    """The ``width`` bits that follow the leading ``bits``."""
    return (keys << np.uint64(bits)) >> np.uint64(64 - width)


class BitFilter:
    """A filter of 2**bits bits over the leading bits of keys. It never misses a key; the more keys, the more it lets pass."""

    def __init__(self, bits: int):
        self.bits, self.map = bits, np.zeros(1 << (bits - 3), np.uint8)

    def put_part(self, part: int, part_bits: int, segment: bytes) -> None:
        size = 1 << (self.bits - part_bits - 3)
        self.map[part * size : (part + 1) * size] |= np.frombuffer(segment, np.uint8)

    def passes(self, keys: np.ndarray) -> np.ndarray:
        slot = keys >> np.uint64(64 - self.bits)
        return (self.map[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def segment_of(rest: np.ndarray, rest_bits: int, size_bits: int) -> bytes:
    """The filter segment of one part from what follows the leading bits of its keys."""
    marks = np.zeros(1 << size_bits, np.uint8)
    marks[rest >> np.uint64(rest_bits - size_bits)] = 1
    return np.packbits(marks, bitorder="little").tobytes()


def part_bits(width: int) -> int:
    """Bits of the part number for a shuffle of ``width`` partitions: several parts each, 256 at least."""
    return max(10, (8 * width - 1).bit_length())
