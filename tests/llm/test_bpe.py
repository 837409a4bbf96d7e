import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyweave.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def encoder():
    return bpe.encoder_of(bpe.vocabulary_text())


@pytest.fixture(scope="module")
def other():
    t = tokenizers.Tokenizer.from_file(f"{bpe.TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def ids(encoder, text):
    return np.frombuffer(encoder.encode(text), np.int32).tolist()


PARTS = ["aaaa", " ", "  ", "\n", "é", "日本", "1", "23", "'s", "'ll", "!", "<|endoftext|>", "\x1c", "​", "\xa0", "²", "ab", "the", "ing", "\t", "é", "😀", "\r\n", "Ⅷ", " ", "\x85"]


def test_against_the_other_implementation(encoder, other):
    rnd = random.Random(1)
    for _ in range(4000):
        s = "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 14)))
        assert ids(encoder, s) == other.encode(s, add_special_tokens=False).ids, repr(s)
    for _ in range(1000):
        s = "".join(rnd.choice("abcdeeiotnrs") for _ in range(rnd.randint(1, 60)))
        assert ids(encoder, s) == other.encode(s, add_special_tokens=False).ids, s


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_any_text(encoder, other, s):
    got = ids(encoder, s)
    assert got == other.encode(s, add_special_tokens=False).ids
    assert encoder.vocabulary.decode(got) == s.encode()


def test_long_texts(encoder, other):
    for s in ("a" * 200_000, "word " * 50_000, " " * 50_000, "ab1 " * 30_000 + "\n"):
        assert ids(encoder, s) == other.encode(s, add_special_tokens=False).ids


def test_small_caches_change_nothing(encoder, monkeypatch):
    monkeypatch.setattr(bpe, "_CACHE_ENTRIES", 3)
    small = bpe.Encoder(encoder.vocabulary)
    text = "the quick brown fox  jumps over\nthe lazy dog again and again " * 3
    assert small.encode(text) == encoder.encode(text) == small.encode(text)


def test_corpus(spark, data, other):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {r.doc_id: r.ids for r in bpe.encode_corpus(docs).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.doc_id] == (other.encode(r.text, add_special_tokens=False).ids if r.text else [])
    n = {r.doc_id: r.n_tokens for r in bpe.count_tokens(docs).collect()}
    assert n == {k: len(v) for k, v in got.items()}


def test_null_empty_and_clashing(spark):
    df = spark.createDataFrame([(1, None, 3, "x"), (None, "", 3, "x"), (1, "a", 3, "x"), (1, "a", 3, "x")], "doc_id int, text string, n_tokens int, ids string")
    assert sorted((str(r.doc_id), r.ids) for r in bpe.encode_corpus(df).collect()) == [("1", []), ("1", [64]), ("1", [64]), ("None", [])]
    assert bpe.encode_corpus(df.limit(0)).count() == 0
