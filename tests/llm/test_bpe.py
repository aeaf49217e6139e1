"""Encoding and decoding over the distinct-word table against the tokenizers library."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from walkweave.llm import bpe
from walkweave.llm.common import table
from walkweave.llm.pretokens import within
from walkweave.llm.queries import QUERIES


def library(path, texts):
    tok = Tokenizer.from_file(path)
    for t in texts:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        yield ids, tok.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("hot", [0, 40, 10_000_000])
@pytest.mark.parametrize("words", [True, False])
def test_round_trip_of_odd_texts(odd, word_bpe, byte_bpe, hot, words):
    path = word_bpe if words else byte_bpe
    rows = odd.collect()
    want = Counter((r.doc_id, tuple(ids), text) for r, (ids, text) in zip(rows, library(path, [r.text for r in rows]), strict=True))
    got = bpe.decode(bpe.encode(odd, path, words, hot_bytes=hot), path)
    assert got.columns == ["doc_id", "ids", "decoded"]
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), r.decoded) for r in got.collect()) == want


def test_specials_in_order(spark, word_bpe):
    texts = ["<|endoftext|>", "a<|startoftext|><|endoftext|>b c<|endoftext|> d", "<|endoftext|><|endoftext|>", "<|ENDOFTEXT|> <|endoftext"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in bpe.decode(bpe.encode(docs, word_bpe, hot_bytes=0), word_bpe).collect()}
    assert [got[k] for k in range(4)] == [(i, t) for i, t in library(word_bpe, texts)]


def test_every_word_is_encoded_once(spark, sf, word_bpe):
    found = bpe.distinct_words(table(spark, sf, "documents"), word_bpe).collect()
    assert len({r.word for r in found}) == len(found) > 1000


def test_whole_table(spark, sf, word_bpe):
    docs = table(spark, sf, "documents").collect()
    want = {}
    for r, (ids, text) in zip(docs, library(word_bpe, [r.text for r in docs]), strict=True):
        want[r.doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert {r[0]: tuple(r[1:]) for r in QUERIES["op11_bpe"](spark, sf).collect()} == want


def test_empty_table_and_null_ids(spark, none, word_bpe):
    assert bpe.decode(bpe.encode(none, word_bpe), word_bpe).collect() == []
    given_ids = spark.createDataFrame([(1, None, "x"), (2, bytearray(b""), "y"), (3, bytearray(np.array([320, 60_000, 321], "<u4").tobytes()), "z")],
                                      "k long, ids binary, decoded string")
    got = {r.k: r.decoded for r in bpe.decode(given_ids, word_bpe).collect()}
    tok = Tokenizer.from_file(word_bpe)
    assert got == {1: None, 2: "", 3: tok.decode([320, 60_000, 321], skip_special_tokens=False)}


def test_very_long_text(spark, word_bpe):
    """20 MB in one row, cut inside at white space."""
    text = "Lorem ipsum's dolor 12 sit-amet " * 650_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    one = list(library(word_bpe, ["Lorem ipsum's dolor 12 sit-amet"]))[0][0]
    row = bpe.encode(docs, word_bpe).select(F.sha2("ids", 256).alias("h")).first()
    assert row.h == hashlib.sha256(np.array(one * 650_000, "<u4").tobytes()).hexdigest()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab' \n\té1", max_size=60), st.integers(1, 9))
def test_cuts_inside_texts_keep_the_tokens(byte_bpe, word_bpe, text, size):
    parts = list(within(text, size))
    assert "".join(parts) == text
    for path in (byte_bpe, word_bpe):
        tok = Tokenizer.from_file(path) if path not in TOK else TOK[path]
        TOK[path] = tok
        assert sum((tok.encode(p, add_special_tokens=False).ids for p in parts), []) == tok.encode(text, add_special_tokens=False).ids


TOK = {}
