"""Both tokenizers against their libraries, on the awkward texts and on random mixtures."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from assay.llm.pair_merge import PairMerger, count_tokens
from assay.llm.piece_codec import PieceCodec, encode_pieces
from tests.llm.fixtures import SCHEMA, frame, rows

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    return Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES), PairMerger(BPE), PieceCodec(PIECES)


def mixtures(n=3000):
    rng = random.Random(11)
    alphabet = "abcdeinrst  ▁\n.,'é日😀Tz0 19<>|-_\t ́"
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(n)]
    return out + ["<|endoftext|>", "a<|endoftext|><|endoftext|>b", " " * 99, "a" * 3000, "<s>x</s>", "\x00", "ab" * 4000, "don't I'LL 12 ٣"]


def test_libraries_agree(libraries):
    bpe, sp, counter, codec = libraries
    for text in mixtures():
        assert counter.count(text) == len(bpe.encode(text, add_special_tokens=False).ids), repr(text)
        ids = sp.encode(text, num_threads=1)
        assert codec.encode(text) == ids and codec.encode_and_decode(text)[1] == sp.decode(ids) == codec.decode(ids), repr(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_any_text(libraries, text):
    bpe, sp, counter, codec = libraries
    assert counter.count(text) == len(bpe.encode(text, add_special_tokens=False).ids)
    assert codec.encode(text) == sp.encode(text, num_threads=1)


def test_any_ids_decode_alike(libraries):
    _, sp, _, codec = libraries
    rng = random.Random(2)
    for _ in range(300):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(3, 32000)]) for _ in range(rng.randint(1, 12))]
        assert codec.decode(ids) == sp.decode(ids), ids


def test_tables(spark, libraries):
    bpe, sp, _, _ = libraries
    counts = {r.doc_id: (r.n_bytes, r.n_tokens) for r in count_tokens(frame(spark), BPE).collect()}
    coded = {r.doc_id: (r.ids, r.decoded) for r in encode_pieces(frame(spark), PIECES).collect()}
    for i, text, *_ in rows():
        text = text or ""
        ids = sp.encode(text, num_threads=1)
        assert counts[i] == (len(text.encode()), len(bpe.encode(text, add_special_tokens=False).ids))
        assert coded[i] == (ids, sp.decode(ids))
    nothing = spark.createDataFrame([], SCHEMA)
    assert count_tokens(nothing, BPE).count() == 0 and encode_pieces(nothing, PIECES).count() == 0


def test_query_digests(spark):
    from assay.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op5_piece_codec"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = sp.encode(texts[r.doc_id], num_threads=1)
        want = len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want


def test_long_unbroken_texts_take_time_in_proportion():
    import time

    import public_tokenizers
    import sentencepiece

    from assay.llm.piece_codec import PieceCodec

    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces, library = PieceCodec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    text = "ab" * 20_000
    assert pieces.encode(text) == library.encode(text)
    begin = time.perf_counter()
    assert pieces.decode(pieces.encode("ab" * 500_000)) == "ab" * 500_000
    assert time.perf_counter() - begin < 60


def test_words_between_single_spaces_are_encoded_as_whole_texts_are():
    import public_tokenizers
    import sentencepiece

    from assay.llm.piece_codec import PieceCodec

    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces, library = PieceCodec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    for text in ("a b, c\nd (e) 12.5%", " a b", "a b ", "a  b", "a▁ b", "▁a b", "x▁", "é ü 中文 😀", ",a ,b", "a\n\n b", "\t"):
        assert pieces.encode(text) == library.encode(text), text
        assert pieces.encode_and_decode(text)[1] == library.decode(library.encode(text)), text
