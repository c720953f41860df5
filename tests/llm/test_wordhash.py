"""Word hashes against splitting, on any bytes and across chunks."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from assay.llm import wordhash
from assay.llm.wordhash import rolled, word_hashes

SEEN: dict[int, bytes] = {}


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab AZ\t\n\r\x0b\x0c\x1c\x85\xa0é中😀 xyz"), max_size=80))
def test_equal_words_have_equal_hashes_and_others_do_not(text):
    for lower in (False, True):
        data = text.encode()
        words = (data.lower() if lower else data).split()
        hashes = word_hashes(data, lower)
        assert len(hashes) == len(words)
        for w, h in zip(words, hashes.tolist()):
            assert SEEN.setdefault(h, w) == w


def test_place_and_chunk_do_not_matter(monkeypatch):
    rng = np.random.default_rng(4)
    words = [bytes(rng.integers(97, 123, rng.integers(1, 9)).tolist()) for _ in range(5000)]
    one = word_hashes(b" ".join(words))
    monkeypatch.setattr(wordhash, "CHUNK", 50)
    assert np.array_equal(one, word_hashes(b"\n ".join(words) + b" "))
    alone = {w: word_hashes(w)[0] for w in set(words)}
    assert len(set(alone.values())) == len(alone) and [alone[w] for w in words] == one.tolist()
    assert np.array_equal(word_hashes(b"x" * 500), word_hashes(b"  " + b"x" * 500))


def test_rolled_runs():
    h = word_hashes(b"a b c a b c d")
    runs = rolled(h, 3)
    assert runs[0] == runs[3] and len(set(runs[:5].tolist())) == 4 and not runs[5:].any()
    assert not rolled(h[:2], 3).any()


def thue_morse(n: int) -> str:
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def test_words_and_runs_that_cancel_out_in_polynomials_differ():
    swap = str.maketrans("ab", "ba")
    for n in (64, 1024, 4096):
        word = thue_morse(n)
        one, two = word_hashes(word.encode()), word_hashes(word.translate(swap).encode())
        assert one != two
        runs = [rolled(word_hashes(" ".join(w).encode()), n)[0] for w in (word, word.translate(swap))]
        assert runs[0] != runs[1] and (int(runs[0]) ^ int(runs[1])) & 0xFFFFF


def test_runs_depend_on_all_their_words_in_order_and_on_the_seed():
    rng = np.random.default_rng(8)
    h = rng.integers(0, 2**63, 300).astype(np.uint64)
    for width in (1, 2, 3, 5, 18, 35, 64):
        runs = rolled(h, width)
        assert len(set(runs[: 301 - width].tolist())) == 301 - width and not runs[301 - width :].any()
        assert np.array_equal(rolled(np.concatenate([h[7:90], h]), width)[83 : 384 - width], runs[: 301 - width])
        for i in range(width):
            other = h.copy()
            other[i] += np.uint64(1)
            assert rolled(other, width)[0] != runs[0]
        assert not (runs[: 301 - width] == rolled(h, width, 9)[: 301 - width]).any()
