"""Counts of several vocabularies in one scan, against each library on whole texts."""

import base64

import pytest

from tests.conftest import SF_SMALL
from turnstile.operators import vocabularies as V

P = pytest.importorskip("public_tokenizers")


def files():
    return [V.Vocabulary(n, P.path(n), P.PATTERN if n.endswith("tiktoken") else None)
            for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json", "piece_bpe_32k.model")]


def library_counts(texts):
    import sentencepiece
    import tiktoken
    from tokenizers import Tokenizer

    out = {}
    for n in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        t = Tokenizer.from_file(P.path(n))
        out[n] = (t.get_vocab_size(), sum(len(t.encode(x, add_special_tokens=False).ids) for x in texts))
    for n in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"):
        with open(P.path(n), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        out[n] = (len(ranks), sum(len(e.encode_ordinary(x)) for x in texts))
    s = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    out["piece_bpe_32k.model"] = (s.get_piece_size(), sum(len(s.encode(x)) for x in texts))
    return out


def test_vocabularies_equal_their_libraries_and_are_cached(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("text")
    docs = docs.unionByName(spark.createDataFrame([(None,), ("",), ("日本 語\n\n x",)], "text string"))
    texts = [r["text"] for r in docs.collect() if r["text"] is not None]
    whole = V.measure_vocabularies(docs, "text", files())
    rows = whole.collect()
    assert {r["tokenizer"]: (r["vocab_size"], r["n_tokens"]) for r in rows} == library_counts(texts)
    assert {r["n_chars"] for r in rows} == {sum(map(len, texts))}
    shown = V.efficiency(spark.createDataFrame(rows, whole.schema)).collect()
    assert [r["chars_per_token"] for r in shown] == sorted((r["n_chars"] / r["n_tokens"] for r in rows), reverse=True)
    cache = spark.createDataFrame(rows[:4], whole.schema)
    left = V.measure_vocabularies(docs.repartition(3), "text", files(), cache).collect()
    assert [r["tokenizer"] for r in left] == [rows[4]["tokenizer"]]
    assert len(V.measure_vocabularies(docs.limit(5), "text", files()[:1], cache).collect()) == 1       # other texts
    copy = f"{tmp_path}/copy.json"
    with open(P.path("byte_bpe_50k.json"), "rb") as a, open(copy, "wb") as b:
        b.write(a.read())
    assert V.Vocabulary("another name", copy).fingerprint == files()[0].fingerprint
    with pytest.raises(ValueError):
        V.counter_of("txt", b"", None)
    none = V.measure_vocabularies(docs.where("false"), "text", files()[:1])
    assert V.efficiency(none).first()["chars_per_token"] == 0.0


def test_equal_pieces_are_encoded_once(spark, monkeypatch):
    """Counts over the different pieces are those of whole texts: white space of all kinds, special strings, joined marks."""
    odd = ["", " ", "  ", "a ", " a  b", "a\u3000 b\u00a0 c\u0085 d", "x \u0301y e\u0301 z", "\u2581 a \u2581b\u2581 c", "ΣΑΣ ΣΑΣ.", "can't 's  'll 12 345",
           "<|endoftext|> a<|endoftext|> <|startoftext|>", "a\n b \n\n c\t d  ", "日本 語 、 🙂 🙂", "don't don't don't " * 50, "!\x1c \x00 a"]
    docs = spark.createDataFrame([(t,) for t in [*odd, None]], "text string").repartition(3)
    assert all(V.adds_over_pieces(f.path.rsplit(".", 1)[1], f.content(), f.pattern) for f in files())
    assert not V.adds_over_pieces("tiktoken", b"", r"\S+ \S+")
    rows = V.measure_vocabularies(docs, "text", files()).collect()
    assert {r["tokenizer"]: (r["vocab_size"], r["n_tokens"]) for r in rows} == library_counts(odd)
    assert {r["n_chars"] for r in rows} == {sum(map(len, odd))}
    pieces = V.text_pieces(docs, "text").collect()
    assert len(pieces) == len({(r["first"], r["piece"]) for r in pieces}) and sum(r["n"] for r in pieces if r["piece"] == " don't") == 149
    monkeypatch.setattr(V, "_GPT2", "none")                 # an unknown pattern: whole texts
    rows = V.measure_vocabularies(docs, "text", files()).collect()
    assert {r["tokenizer"]: (r["vocab_size"], r["n_tokens"]) for r in rows} == library_counts(odd)
