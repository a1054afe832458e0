import hashlib

import numpy as np
import public_tokenizers as public
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from querent.llm.bpe import Encoder, decode, encode, encoded_digests

PATH = public.path("word_bpe_49k.json")
REAL = Tokenizer.from_file(PATH)
CODER = Encoder(PATH)
ODD = ["", "It's WE'LL don't 'S", "Σίσυφος ΟΔΟΣ", "İstanbul ŉ ǰ", "é café ½ ² ٣٤ Ⅷ", "a<|endoftext|>b <|startoftext|><|endoftext|>", "漢字かな 😀👍🏽 ‍ x​y", "\x00\x01\x1c\x1f a\x85b\xa0c　d", "aaaaaaaaaaaaaaaaaaa hahahahahaha !!!!!!!!!!???", "x" * 3000, "ab" * 2000 + " " + "=" * 999]


def same(text):
    ids = CODER.encode([text])[0]
    want = REAL.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want
    assert CODER.decode(ids).decode() == REAL.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("the ing tion ch ß é a e o ll ou x 1 ! ' .".split()), max_size=40))
def test_syllables(parts):
    same("".join(parts))


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in encoded_digests(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = REAL.encode(r.text, add_special_tokens=False).ids
        g = got[r.doc_id]
        assert g.n_tokens == len(ids) and g.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256(REAL.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_nulls_clashes_and_empty(spark):
    schema = "doc_id long, text string, ids string, n_tokens string"
    got = encoded_digests(spark.createDataFrame([(1, None, "a", "b"), (None, "x y", None, None), (1, None, "a", "b")], schema)).collect()
    assert sorted(r.n_tokens for r in got) == [0, 0, 2] and sum(r.doc_id is None for r in got) == 1
    assert encoded_digests(spark.createDataFrame([], schema)).count() == 0
    assert decode(encode(spark.createDataFrame([(1, "Hello world", "", "")], schema))).first().text == "hello</w> world</w>"
