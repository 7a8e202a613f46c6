"""Byte pair encoding and token counts against the tokenizers library."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from clauseflow.llm.bpe import Encoder, Vocabulary, encode_texts
from clauseflow.llm.tokencount import count_tokens
from clauseflow.session import scratch_path

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encoder():
    with open(BYTES, encoding="utf-8") as f:
        return Encoder(Vocabulary(f.read()))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTES)


ODD = [
    "", " ", "  ", "a  b", "a \n b", "\n\n x", "tab\t\ty", "x's 'tis we'll !!'s", "a b　c ",
    "<|endoftext|>", "a<|endoftext|> b <|endoftext|><|endoftext|>", "<|ENDOFTEXT|>", "aaaa" * 400,
    "\x1c\x1d x\x85y", "é é", "\U0001f600 ok", "12 345,6", "zero​width", "ab" * 3000, "\x00\x01 \x7f",
]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(encoder, library, text):
    ids = np.frombuffer(encoder.encode([text])[0], "<u4").tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert encoder.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'setrl12.,é")), max_size=60), max_size=4))
def test_any_texts(encoder, library, texts):
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [encoder.decode(np.array(i, "<u4").tobytes()) for i in got] == texts


def test_certain_cuts_lie_in_no_token(encoder):
    v = encoder.vocabulary
    assert v.certain.sum() > 10_000
    assert not v.certain[ord("t"), ord("h")] and v.certain[ord("h"), ord(" ")]


def test_encode_table(docs, rows, none, library):
    got = encode_texts(docs, BYTES).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        assert (r.n_tokens, r.decoded) == (len(ids), r.text or "")
    assert encode_texts(none, BYTES).count() == 0


def test_token_counts(spark, docs, rows, none):
    library = Tokenizer.from_file(WORDS)
    cache = scratch_path(spark, "cache")
    for _ in range(2):
        for r in count_tokens(docs, WORDS, cache).collect():
            text = r.text or ""
            assert r.n_tokens == len(library.encode(text, add_special_tokens=False).ids), text[:50]
            assert r.n_bytes == len(text.encode())
        # the second time nothing is encoded
        contents = {" ".join(x for x in (t or "").replace("\n", " ").replace("\t", " ").split(" ") if x) for _, t in rows}
        assert spark.read.parquet(cache).count() == len(contents)
    assert count_tokens(none, WORDS, scratch_path(spark, "cache")).count() == 0


def test_cached_counts_are_used(spark):
    cache = scratch_path(spark, "cache")
    one = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    count_tokens(one, WORDS, cache).collect()
    old = spark.read.parquet(cache).collect()
    other = scratch_path(spark, "cache")
    spark.createDataFrame([(old[0].content, old[0].tokenizer, 77)], "content string, tokenizer string, n_tokens long").write.parquet(other)
    assert count_tokens(one, WORDS, other).first().n_tokens == 77
    # a count of another tokenizer version is not
    third = scratch_path(spark, "cache")
    spark.createDataFrame([(old[0].content, "other", 77)], "content string, tokenizer string, n_tokens long").write.parquet(third)
    assert count_tokens(one, WORDS, third).first().n_tokens == old[0].n_tokens
