"""Word helpers and the Simple-8b codec against plain Python."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from turnstile.llm import simple8b
from turnstile.llm import words as W

SPACES, SYMBOLS = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t-7　ß", max_size=30)), max_size=8), st.sampled_from([1, 20, 1000]))
def test_words_match_regex(texts, size):
    for sep, pattern in ((W.space_separators(), SPACES), (W.symbol_separators(), SYMBOLS)):
        got, names = [], {}
        for _, _, w in W.chunks(pa.array(texts, pa.string()), sep, True, size):
            words = [bytes(w.data[a:b]).decode() for a, b in zip(w.start, w.end)]
            got += [words[a:b] for a, b in zip(w.first[:-1], w.first[1:])]
            for x, h in zip(words, w.hashes().tolist()):
                assert names.setdefault(x, h) == h
        assert got == [re.findall(pattern, low(t)) for t in texts]
        assert len(set(names.values())) == len(names)


def test_ngrams_stay_inside_a_text():
    (_, _, w), = W.chunks(pa.array(["a b c", "a b", None, "b c"]), W.space_separators(), True)
    key, at = W.ngrams(w.hashes(), w.doc, 2)
    assert w.doc[at].tolist() == [0, 0, 1, 3]
    assert key[0] == key[2] and key[1] == key[3] and key[0] != key[1]


def test_substrings_hash_like_words():
    (_, _, w), = W.chunks(pa.array(["hello"]), W.space_separators(), True)
    data = np.frombuffer(b"xhellox", np.uint8)
    found = {n: key for n, key, _ in W.substring_hashes(data, np.zeros(7, int), 3, 6)}
    assert (found[5] == w.hashes()[0]).sum() == 1


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 9000])
@pytest.mark.parametrize("kind", ["uniform", "skewed", "one", "wide"])
def test_simple8b_round_trip(n, kind):
    r = np.random.default_rng(n)
    ids = {"uniform": r.integers(0, 50257, n), "skewed": r.zipf(1.3, n) % 50000, "one": np.full(n, 7),
           "wide": r.integers(0, 2 ** 32, n)}[kind].astype(np.int64)
    segment = simple8b.encode(ids)
    assert simple8b.decode(segment).tolist() == ids.tolist()
    if n > 4096:
        assert simple8b.decode(segment, 1, 3).tolist() == ids[1024:3072].tolist()


def test_simple8b_is_smaller_than_plain_ids():
    ids = (np.random.default_rng(1).zipf(1.3, 100_000) % 50000).astype(np.int64)
    assert len(simple8b.encode(ids)) < 4 * len(ids) / 2


def test_simple8b_rejects_other_bytes():
    with pytest.raises(ValueError):
        simple8b.decode(bytes(64))


def test_pieces_encode_as_whole_texts():
    """Cuts of the piece encoder against the library on texts of odd white space, and over an emptied cache."""
    import random

    import pyarrow as pa
    import public_tokenizers

    from turnstile.llm import tokenstore as T

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        tokenizer = T._tokenizer(f.read())
    rng = random.Random(5)
    alphabet = ["a", "b", " ", "  ", "\n", " \n", "\n\n", "\t", " ", "　", "\x1c", "é", "'s", "1", "23", "!", "?", " ", "\x85",
                " ", "日本", "\r\n", "x" * 20, " y" * 3, "\x00", " ", "Â", " "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(8000)] + ["", " ", "\n", "z" * 5000]
    want = [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    encoder = T.PieceEncoder(tokenizer)
    assert [x.tolist() for x in encoder.encode(pa.array(texts))] == want
    known, encoder.known = encoder.known, T.CACHE_PIECES
    assert [x.tolist() for x in encoder.encode(pa.array(texts))] == want and encoder.known <= known
