"""Token counts by byte-pair merging on a heap and a linked list.

The vocabulary file is the JSON of a byte-level BPE tokenizer. A word starts as its bytes. The adjacent pair of the
lowest rank is popped and merged until no pair has a rank, and the count is the number of bytes minus the number of
merges: no identifiers are made.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from assay.llm.merging import merge, pair_key, pair_value
from assay.llm.tables import columns_of, in_batches, named

# The pattern that byte-level tokenizers split text by, with white space as Unicode defines it. A fixed value.
WORDS = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def printable_bytes() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies.

    Bytes that print keep their own character; the others take the characters from 256 on, in order.
    """
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class PairMerger:
    """Counts the tokens of a text. Words are remembered up to a bounded number of entries."""

    def __init__(self, path: str, remember: int = 400_000, longest: int = 48):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or before["type"] != "ByteLevel" or before["add_prefix_space"]:
            raise ValueError(f"{path} is not a byte-level BPE vocabulary without a prefix space")
        byte = printable_bytes()
        symbol, self.pairs = {c: b for b, c in enumerate(byte)}, {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            new = symbol.setdefault(left + right, len(symbol))
            self.pairs[pair_key(symbol[left], symbol[right])] = pair_value(rank, new)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.known: dict[str, int] = {}
        self.remember, self.longest = remember, longest

    def symbols_left(self, word: str) -> int:
        """Bytes of a word minus its merges."""
        return len(merge(list(word.encode("utf-8")), self.pairs))

    def _of_words(self, words: list[str]) -> int:
        known, total = self.known, 0
        for word in words:
            n = known.get(word)
            if n is None:
                n = self.symbols_left(word)
                if len(word) <= self.longest:
                    if len(known) >= self.remember:
                        known.clear()
                    known[word] = n
            total += n
        return total

    def count(self, text: str) -> int:
        """Tokens of a text. Strings of special tokens inside it count as one token each."""
        if self.special is None:
            return self._of_words(WORDS.findall(text))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self._of_words(WORDS.findall(p)) for p in parts if p)


_MERGERS: dict[str, PairMerger] = {}


def merger(path: str) -> PairMerger:
    if path not in _MERGERS:
        _MERGERS[path] = PairMerger(path)
    return _MERGERS[path]


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of the input: ``doc_id, n_bytes, n_tokens``.

    A null or empty text has no bytes and no tokens. Rows without an id are left out; repeated rows are counted
    each. Nothing is shuffled. ``path`` is a vocabulary file that every executor can read at that place.
    """
    rows = named(df, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = merger(path)
        for batch in batches:
            schema = pa.schema([batch.schema.field("doc_id"), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
            ids, texts = columns_of(batch, "doc_id", "text")
            yield from in_batches(((i, len(t.encode()), tokens.count(t)) for i, t in zip(ids, texts)), schema)

    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
