"""Merging of adjacent symbols on a heap and a linked list."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

BITS = 20
NEW = (1 << BITS) - 1
PLACE = (1 << 32) - 1


def pair_key(left: int, right: int) -> int:
    return left << BITS | right


def pair_value(rank: int, new: int) -> int:
    return rank << BITS | new


def merge(symbols: list[int], pairs: dict[int, int]) -> list[int]:
    """What is left of the symbols after all merges; of each run of merged symbols the first place is used.

    The pair of the lowest rank goes first, and of equal ranks the leftmost. ``pairs`` gives rank and new symbol
    of a pair. A heap entry is a rank and a place; it is void if the pair at that place has another rank by now.
    """
    n = len(symbols)
    find = pairs.get
    heap, left = [], symbols[0] if symbols else 0
    for i in range(1, n):
        right = symbols[i]
        value = find(left << BITS | right)
        if value is not None:
            heap.append(value >> BITS << 32 | i - 1)
        left = right
    if not heap:
        return symbols
    heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while heap:
        entry = heappop(heap)
        i = entry & PLACE
        j = after[i]
        if j >= n or symbols[i] < 0:
            continue
        value = find(symbols[i] << BITS | symbols[j])
        if value is None or value >> BITS != entry >> 32:
            continue
        new = symbols[i] = value & NEW
        symbols[j] = -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            value = find(new << BITS | symbols[k])
            if value is not None:
                heappush(heap, value >> BITS << 32 | i)
        h = before[i]
        if h >= 0:
            value = find(symbols[h] << BITS | new)
            if value is not None:
                heappush(heap, value >> BITS << 32 | h)
    return [s for s in symbols if s >= 0]
