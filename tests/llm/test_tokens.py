from __future__ import annotations

from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewire.llm import tokens

pytestmark = pytest.mark.skipif(not Path(tokens.TOKENIZERS, tokens.VOCABULARY).exists(), reason="no vocabulary here")


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.Vocabulary())


@pytest.fixture(scope="module")
def public():
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}")
    library.encode_special_tokens = True
    return lambda t: library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a" * 3001, "ab" * 100_000, "-" * 47 + "=" * 2 + "-" * 47, "é" * 200, " " * 500 + "x", "ab" * 300 + "aab" * 50, "漢字かな交じり文" * 80, "<|endoftext|> it's", "\x00\x07​﻿" * 30, "строка, ещё одна!\n\n  3.14", "🧑🏽‍🔧🇺🇳"])
def test_same_ids_as_the_public_library(encoder, public, text):
    assert encoder.encode([text]).to_pylist() == [public(text)]


def test_random_texts(encoder, public):
    @given(st.lists(st.text(max_size=60), max_size=5))
    @settings(max_examples=40, deadline=None)
    def run(texts):
        assert encoder.encode(texts).to_pylist() == [public(t) if t else [] for t in texts]

    run()


def test_small_memory_gives_the_same(public):
    small = tokens.Encoder(tokens.Vocabulary(), remembered=3)
    for text in ("one two three", "four five six seven", "one two"):
        assert small.encode([text]).to_pylist() == [public(text)]


def test_table_and_round_trip(spark, rows):
    data = [(1, "Hello, мир!", "x"), (2, "", "x"), (3, None, None), (4, "word " * 4000, "y"), (1, "Hello, мир!", "x")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, key string")
    out = tokens.encode(df)
    got = {r["doc_id"]: r["ids"] for r in out.collect()}
    assert out.count() == 5 and got[2] == got[3] == [] and len(got[4]) > 4000
    assert rows(tokens.decode(out).where("doc_id < 4").distinct()) == [(1, "Hello, мир!"), (2, ""), (3, "")]
    assert tokens.encode(df.limit(0)).count() == 0
