"""Token counts against the tokenizers library, and the proof of the whole-token shortcut."""

from __future__ import annotations

import random

import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from trialscope.llm import token_counts
from trialscope.llm.parameters import byte_vocabulary

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n  x", "a<|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext", "'s 'S it's\n's don'tt 　x  y",
       "՘ ֋ 😀 日本語１２ Ⅷ ½", "\u0000퟿￿", "x" * 5000, "ab" * 40_000, " " * 200 + "a", "a\r\n\t\r b", "é" * 300,
       "word " * 60_000, "ß😀" * 3000, "a" * 300_000 + " b"]


@pytest.fixture(scope="module")
def proof():
    return token_counts.prove(byte_vocabulary())


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(byte_vocabulary())
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


def rows():
    r = random.Random(5)
    made = ["".join(r.choice("aZ é's0 \n\t.中ⅷ😀ʰ") for _ in range(r.randint(0, 60))) for _ in range(300)]
    texts = ODD + made + ODD[:4] * 2
    return [(k // 2 if k % 7 else None, t) for k, t in enumerate(texts)]


def test_counts(spark, proof, library):
    table = [(d, t, 1, 2, 3, "x") for d, t in rows()]
    docs = spark.createDataFrame(table, "doc_id long, text string, n_tokens long, k0 int, n_bytes int, over_limit string")
    got = token_counts.token_counts(docs, proof, limit=40)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(d, len((t or "").encode()), n := library(t), n > 40) for d, t in rows()]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_documents(spark, proof, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, proof).collect()}
    assert got == {r["doc_id"]: library(r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}


def test_empty_table(spark, proof):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.token_counts(docs, proof).collect() == []


def test_shortcut_carries_the_count(proof, library):
    """Single strings are one token to the library; a counter that may merge nothing still counts texts of such words."""
    for word in random.Random(1).sample(sorted(w for w in proof.single if w.strip() and not w.startswith("<|")), 2000):
        assert library(word) == 1, word
    only = token_counts.Counter(token_counts.Proof(proof.single, {}, proof.added, proof.unproven))
    text = "The people of the city said that they would not go there."
    assert only.tokens(text) == library(text)
    assert only.tokens("Zxqvjk") > library("Zxqvjk") > 1


def test_caches_stay_bounded(proof, library, monkeypatch):
    monkeypatch.setattr(token_counts, "KEPT", 5)
    monkeypatch.setattr(token_counts, "SHORT", 3)
    monkeypatch.setattr(token_counts, "PIECE", 16)
    counter = token_counts.Counter(proof)
    for _, text in rows():
        assert counter.tokens(text or "") == library(text)
    assert len(counter) <= len(proof.single) + 5


def test_unproven_blocks_differ():
    """The first block where the two Unicode versions part is left to the library."""
    import regex
    odd = regex.compile(token_counts.unproven_blocks())
    assert not odd.search("plain text, é 中文") and odd.search("😀")


def test_other_vocabularies_are_refused(tmp_path):
    import public_tokenizers
    with pytest.raises(ValueError):
        token_counts.prove(public_tokenizers.path("word_bpe_49k.json"))
