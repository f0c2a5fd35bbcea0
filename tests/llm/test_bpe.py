"""Byte-level BPE against the tiktoken library."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from helixgraph.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    e = bpe.encoder(PATH, public_tokenizers.PATTERN)
    return e, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=e.ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(text=st.text(max_size=60))
def test_equals_tiktoken(both, text):
    e, t = both
    ids, = e.encode([text])
    assert np.frombuffer(ids, "<u4").tolist() == t.encode_ordinary(text)
    assert e.decode(ids) == text.encode()


def test_long_and_repetitive(both):
    e, t = both
    for text in ("a" * 3000, "ab" * 999, " " * 500 + "\n" * 30, "Ünïcödé ß 漢字 🎉" * 50, "<|endoftext|>", "it's I'LL don't 12345 x1y2"):
        ids, = e.encode([text])
        assert np.frombuffer(ids, "<u4").tolist() == t.encode_ordinary(text) and e.decode(ids) == text.encode()


def test_memo_is_bounded(both, monkeypatch):
    e, t = both
    monkeypatch.setattr(bpe, "MEMO", 40)
    e.memo.clear()
    texts = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(10)]
    for text, ids in zip(texts, e.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode_ordinary(text)
    assert len(e.memo) <= 200


def test_perfect_hash():
    keys = [f"k{i}".encode() for i in range(5000)]
    h = bpe.PerfectHash(keys, list(range(5000)))
    assert h.find(keys) == list(range(5000)) and sorted(h.slot_value.tolist()) == list(range(5000))
    assert set(h.find([f"z{i}".encode() for i in range(2000)])) == {-1}
    assert bpe.PerfectHash([], []).find([b"x"]) == [-1]


def test_columns(spark, both):
    _, t = both
    rows = [(1, "one two", "k"), (2, None, "k"), (3, "", "k"), (4, "word " * 20_000, "k"), (1, "one two", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.round_trip(df, "doc_id", "text", PATH, public_tokenizers.PATTERN).collect()
    expected = sorted((d, len(t.encode_ordinary(x or "")), hashlib.sha256(np.array(t.encode_ordinary(x or ""), "<u4").tobytes()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest()) for d, x, _ in rows)
    assert sorted(map(tuple, out)) == expected
    assert bpe.round_trip(df.limit(0), "doc_id", "text", PATH, public_tokenizers.PATTERN).collect() == []
    ids = bpe.encode_column(df.limit(1), "doc_id", "text", PATH, public_tokenizers.PATTERN)
    assert bytes(bpe.decode_column(ids, "doc_id", "ids", PATH, public_tokenizers.PATTERN).first()["bytes"]) == b"one two"
