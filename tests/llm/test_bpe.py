"""Forced-boundary BPE against the library's own encoder and decoder."""

import hashlib
import random

import numpy as np
import pytest

from deskpass.llm import bpe, queries
from tests.conftest import SF_SMALL

POOL = "abcXYZ'sd’“…  \t\n  ́̀éÉßÀİΣςσı中文字漢ไทย한글ガ゙🎉👍🏽½②١٢_-<|>.,!?\x1c\x1d\x85\x00​﻿ǅİẞ"
PARTS = ["<|endoftext|>", "<|startoftext|>", "'ll", "'RE", "</w>", "ÀÉ", "é", "中文中文", "thethe"]


@pytest.fixture(scope="module")
def own():
    return bpe.bpe(bpe.default_vocabulary())


def expected(own, text):
    ids = own.library.encode(text or "", add_special_tokens=False).ids
    return ids, own.library.decode(ids, skip_special_tokens=False)


def random_text(rng):
    return "".join(rng.choice(POOL) if rng.random() < .9 else rng.choice(PARTS) for _ in range(rng.randint(0, 40)))


def test_ids_and_text_equal_the_library(own):
    rng = random.Random(1)
    texts = [random_text(rng) for _ in range(4000)]
    tokens = bpe.read_tokens(bpe.default_vocabulary())
    for t, ids in zip(texts, own.encode_all(texts), strict=True):
        want = expected(own, t)
        assert np.frombuffer(ids, "<u4").tolist() == want[0]
        assert bpe.decode(tokens, ids) == want[1]


def test_long_texts_and_runs(own, monkeypatch):
    monkeypatch.setattr(bpe, "AT_ONCE", 100)
    rng = random.Random(2)
    long = "".join(random_text(rng) for _ in range(60))
    for t in [long, "a" * 5000, "ab" * 3000, "中文" * 2000, "word " * 3000, "<|endoftext|>" * 50, "x" * 70 + " " + "qz" * 40]:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == expected(own, t)[0]


def test_cuts_are_certain(own):
    """No token holds a pair that is a cut, and cuts do fall inside words."""
    assert own.certain.any()
    for token in list(own.library.get_vocab(with_added_tokens=False))[::50]:
        s = own.symbols(token)
        assert not any(own.certain[a & 255, b] for a, b in zip(s, s[1:]))
    raw = "中文字漢".encode()
    assert any(own.certain[a, b] for a, b in zip(raw, raw[1:]))


def test_forgetting_changes_nothing(own, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    rng = random.Random(3)
    texts = [random_text(rng) for _ in range(200)]
    for t in texts:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == expected(own, t)[0]
    assert len(own.words) <= 20 + 200 and all(len(w) <= bpe.SHORT for w in own.words)


def test_cases(spark, own):
    rows = [(1, None, "k"), (2, "", "k"), (3, "Hello, WORLD's end", "k"), (3, "Hello, WORLD's end", "k"), (None, "x", "k"),
            (4, "y" * 200_000, "k"), (5, " \n\t ", "k")]
    d = spark.createDataFrame(rows, "doc_id long, text string, ids string")  # a column whose name clashes
    got = bpe.token_digests(d).collect()
    assert len(got) == len(rows)
    for r in got:
        text = {k: t for k, t, _ in rows}[r.doc_id]
        ids, decoded = expected(own, text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.token_digests(d.limit(0)).count() == 0
    whole = bpe.decode_ids(bpe.encode_texts(d))
    assert whole.columns == ["doc_id", "text", "ids", "decoded"]
    assert {r.decoded for r in whole.where("doc_id = 3").collect()} == {expected(own, "Hello, WORLD's end")[1]}
    one_pass = bpe.encode_texts(d, decoded=True)
    assert sorted(map(str, one_pass.collect())) == sorted(map(str, whole.collect()))
    unknown = spark.createDataFrame([(None,)], "ids binary")
    assert bpe.decode_ids(unknown).first().decoded is None


def test_query_equals_the_library(spark, own):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    for r in queries.QUERIES["op11_forced_boundary_bpe"](spark, SF_SMALL).collect():
        ids, decoded = expected(own, docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
