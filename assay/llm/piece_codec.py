"""SentencePiece encoding and decoding of merge-type (BPE) models, exactly, by backtracking.

A text is walked with the longest pieces that an Aho-Corasick automaton finds at each position. A piece may follow
another one only if merging their characters anew gives these two pieces again; otherwise the next shorter prefix
is tried, and positions from which no way leads to the end are marked in a field so that they are tried once.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from assay.llm.merging import merge, pair_key, pair_value
from assay.llm.tables import columns_of, named

SPACE = "▁"
# Piece types and field numbers of the public model format. Fixed values.
NORMAL, BYTE, UNUSED, USER_DEFINED = 1, 6, 5, 4
PIECES, TRAINER, NORMALIZER = 1, 2, 3


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[at : at + size]
            at += size


class _Parts(dict):
    """Ids and decoded text of the parts that occurred; emptied when it is full."""

    def __init__(self, pieces: PieceCodec, remember: int, longest: int):
        super().__init__()
        self.pieces, self.remember, self.longest = pieces, remember, longest

    def __missing__(self, part: str) -> tuple[tuple[int, ...], str]:
        ids = tuple(self.pieces.encode_part(part))
        got = ids, self.pieces._join(ids)
        if len(part) <= self.longest:
            if len(self) >= self.remember:
                self.clear()
            self[part] = got
        return got


class _Words(dict):
    """The same for words of letters behind a single space: such a word is one part, and no pattern is needed to see it."""

    def __init__(self, parts: _Parts):
        super().__init__()
        self.parts = parts

    def __missing__(self, word: str) -> tuple[tuple[int, ...], str]:
        ids = tuple(self.parts.pieces.encode_part(SPACE + word))
        got = ids, self.parts.pieces._join(ids)
        if len(word) <= self.parts.longest:
            if len(self) >= self.parts.remember:
                self.clear()
            self[word] = got
        return got


class PieceCodec:
    """Encoder and decoder of one model file. What it remembers is bounded."""

    def __init__(self, path: str, remember: int = 400_000, longest: int = 40):
        with open(path, "rb") as file:
            parts = list(_fields(file.read()))
        trainer, rules = (dict(_fields(next((v for f, v in parts if f == k), b""))) for k in (TRAINER, NORMALIZER))
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0):
            raise ValueError(f"{path} is not a BPE model with byte fallback")
        if rules.get(2) or rules.get(4, 1) or not rules.get(3, 1) or not rules.get(5, 1):
            raise ValueError(f"{path} changes the text in ways that are not supported")
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte_id: dict[int, int] = {}
        self.piece: list[str | int | None] = []
        for number, (_, value) in enumerate(p for p in parts if p[0] == PIECES):
            entry = dict(_fields(value))
            text, kind = entry[1].decode("utf-8"), entry.get(3, NORMAL)
            if kind in (UNUSED, USER_DEFINED):
                raise ValueError(f"{path} has user-defined or unused pieces")
            self.piece.append(text if kind == NORMAL else int(text[1:-1], 16) if kind == BYTE else None)
            if kind == NORMAL:
                self.score[text] = struct.unpack("<f", entry[2])[0] if 2 in entry else 0.0
                self.id[text] = number
            elif kind == BYTE:
                self.byte_id[int(text[1:-1], 16)] = number
        order = {v: n for n, v in enumerate(sorted(set(self.score.values()), reverse=True))}
        self.pairs = {}
        for text, number in self.id.items():
            value = pair_value(order[self.score[text]], number)
            for cut in range(1, len(text)):
                left, right = self.id.get(text[:cut]), self.id.get(text[cut:])
                if left is not None and right is not None:
                    self.pairs[pair_key(left, right)] = value
        self.pieces = ahocorasick.Automaton()
        for text in self.score:
            self.pieces.add_word(text, len(text))
        self.pieces.make_automaton()
        self.part = self._parts_of_text()
        self.letters = {p for p in self.score if len(p) == 1}
        self.shown = [p.replace(SPACE, " ") if isinstance(p, str) else "" for p in self.piece]
        self.bytes = frozenset(self.byte_id.values())
        self._parts = _Parts(self, remember, longest)
        self._words = _Words(self._parts)
        self.plain = self.part.pattern != ".+" and set(map(chr, range(65, 91))) | set(map(chr, range(97, 123))) <= self.letters
        self._pairs: dict[tuple[str, str], bool] = {}
        self._shorter: dict[str, str] = {}
        self.remember = remember

    def _parts_of_text(self) -> re.Pattern:
        """Where texts can be cut into parts that are encoded one by one, as the pieces of this model allow.

        If no piece has a space mark after another character, a run of marks begins a part. Characters that are no
        piece stand alone. A sign ends the letters before it if no piece has that sign after anything but signs.
        """
        inside = {(a, b) for p in self.score for a, b in zip(p, p[1:])}
        if any(b == SPACE != a for a, b in inside):
            return re.compile(".+", re.DOTALL)
        signs = {c for c in self.score if len(c) == 1 and not c.isalpha() and c != SPACE}
        while joined := {b for a, b in inside if b in signs and a not in signs and a != SPACE}:
            signs -= joined
        sign = "".join(map(re.escape, sorted(signs)))
        lone = "".join(re.escape(c) for c in map(chr, range(128)) if c not in self.score)
        letter = f"[^{SPACE}{sign}{lone}]"
        return re.compile(f"{SPACE}*[{sign}]*{letter}+|{SPACE}*[{sign}]+|{SPACE}+|[{lone}]", re.DOTALL)

    def remerge(self, text: str) -> list[str]:
        """Pieces of a text whose characters are all pieces after all merges: highest score first, then leftmost."""
        return [self.piece[i] for i in merge([self.id[c] for c in text], self.pairs)]

    def compatible(self, left: str, right: str) -> bool:
        """True if the characters of two pieces merge to these two pieces again."""
        found = self._pairs.get((left, right))
        if found is None:
            if len(self._pairs) >= self.remember:
                self._pairs.clear()
            found = self._pairs[left, right] = self.remerge(left + right) == [p for p in (left, right) if p]
        return found

    def shorter(self, piece: str) -> str:
        """The longest piece that is a proper prefix, or an empty text."""
        if piece not in self._shorter:
            size = next((n for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.score), 0)
            self._shorter[piece] = piece[:size]
        return self._shorter[piece]

    def backtrack(self, text: str) -> list[str]:
        """Pieces of a text whose characters are all pieces."""
        size = len(text)
        longest = [1] * size
        for end, n in self.pieces.iter(text):
            if n > longest[end - n + 1]:
                longest[end - n + 1] = n
        compatible, closed, at, way, last = self.compatible, bytearray(size + 1), 0, [], ""
        piece = text[: longest[0]]
        while True:
            end = at + len(piece)
            if not closed[end] and compatible(last, piece):
                way.append(piece)
                if end == size:
                    return way
                at, last = end, piece
                piece = text[at : at + longest[at]]
                continue
            piece = self.shorter(piece)
            while not piece:  # nothing fits from here: close the position and take back the piece before it
                closed[at] = 1
                if not way:
                    return self.remerge(text)
                last = way.pop()
                at -= len(last)
                piece = self.shorter(last)
                last = way[-1] if way else ""

    def encode_part(self, part: str) -> list[int]:
        if self.letters.issuperset(part):
            return self._encode_known(part)
        ids, known = [], ""
        for c in part:
            if c in self.id:
                known += c
                continue
            ids += self._encode_known(known)
            ids += [self.byte_id[b] for b in c.encode("utf-8")]
            known = ""
        return ids + self._encode_known(known)

    def _encode_known(self, text: str) -> list[int]:
        if not text:
            return []
        # Pieces of several marks share one score, where the order of ties matters beyond neighbouring pieces.
        pieces = self.remerge(text) if SPACE in text[1:] else self.backtrack(text)
        return [self.id[p] for p in pieces]

    def _join(self, ids) -> str:
        """Text of the pieces, with spaces for marks; bytes that are no character give U+FFFD."""
        if self.bytes.isdisjoint(ids):
            return "".join([self.shown[i] for i in ids])
        out, held = [], bytearray()

        def close() -> None:
            while held:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(held[:n]).decode("utf-8"))
                        del held[:n]
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�")
                    del held[:1]

        for i in ids:
            piece = self.piece[i]
            if isinstance(piece, int):
                held.append(piece)
            else:
                close()
                out.append(self.shown[i])
        close()
        return "".join(out)

    def encode_and_decode(self, text: str) -> tuple[list[tuple[int, ...]], str]:
        """Ids of a text, part by part, and the text that they decode to."""
        if not text:
            return [], ""
        known, cut = self._parts, self.part.findall
        words = text.split(" ")
        if not self.plain or "" in words or SPACE in text:  # runs of marks belong to one part
            parts = [known[p] for p in cut(SPACE + text.replace(" ", SPACE))]
        else:
            letters, parts = self._words, []
            for word in words:
                if word.isalpha():
                    parts.append(letters[word])
                else:
                    parts += [known[p] for p in cut(SPACE + word)]
        return [p[0] for p in parts], "".join([p[1] for p in parts])[1:]

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.encode_and_decode(text)[0]))

    def decode(self, ids: list[int]) -> str:
        """Text of any ids; the space that encoding puts in front is taken away."""
        text = self._join(ids)
        first = self.piece[ids[0]] if ids else None
        return text[1:] if isinstance(first, str) and first.startswith(SPACE) else text


_CODECS: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def encode_pieces(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of the input: ``doc_id, ids, decoded``.

    ``ids`` has no begin or end id, and ``decoded`` is what the ids decode to. A null or empty text has no ids and
    decodes to an empty text. Rows without an id are left out; repeated rows are encoded each. Nothing is shuffled.
    ``path`` is a model file that every executor can read at that place.
    """
    rows = named(df, id_col, text_col)
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = codec(path)
        for batch in batches:
            (texts,) = columns_of(batch, "text")
            for start in range(0, len(texts), 512):
                values, ends, decoded = array("i"), array("i", [0]), []
                for text in texts[start : start + 512]:
                    parts, back = pieces.encode_and_decode(text)
                    values.extend(chain.from_iterable(parts))
                    ends.append(len(values))
                    decoded.append(back)
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
                own = batch.column(batch.schema.get_field_index("doc_id")).slice(start, 512)
                yield pa.RecordBatch.from_arrays([own, ids, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return rows.mapInArrow(encode, T.StructType([rows.schema["doc_id"], *fields]))
