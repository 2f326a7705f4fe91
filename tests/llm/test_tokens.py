import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwright.llm import tokens as K

PATH = os.path.join(K.FOLDER, K.BYTE_BPE_50K)
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary here")


@pytest.fixture(scope="module")
def codec():
    return K.Codec(K.load_model())


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(K.FOLDER, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


TEXTS = ["", "Hello world", "  two  blanks \n\n tab\t", "<|endoftext|> is text", "l'été où ça coûte 12,50 €", "a" * 5000, " " * 3000 + "x", "𝔼[X²] 😀 опухоль", "I'll DON'T 've", "\x00\x01", "1234567890" * 50]


def test_equals_public_library(codec, reference):
    ids, n = codec.encode(TEXTS)
    at = 0
    for text, k in zip(TEXTS, n):
        assert ids[at : at + k].tolist() == reference.encode(text, add_special_tokens=False).ids
        at += k


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(blacklist_categories=("Cs",)), max_size=60))
def test_round_trip_and_equality(text):
    c = K._codec(K.load_model())
    ids, n = c.encode([text])
    assert c.decode(ids.tolist()) == text and n[0] == len(ids)


def test_corpus(spark):
    rows = [(i, t, "n") for i, t in enumerate(TEXTS)] + [(99, None, "n"), (None, "x", "n"), (1, TEXTS[1], "n")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    out = K.encode_corpus(df).collect()
    assert len(out) == len(rows)
    assert [r["ids"] for r in out if r["doc_id"] in (0, 99)] == [[], []]
    sizes = {r["doc_id"]: r["n_tokens"] for r in K.encode_corpus(df, ids=False, counts=True).collect()}
    assert all(sizes[r["doc_id"]] == len(r["ids"]) for r in out)
    back = {r["doc_id"]: r["text"] for r in K.decode_corpus(K.encode_corpus(df)).collect()}
    assert all(back[i] == t for i, t in enumerate(TEXTS)) and back[99] == ""
    assert K.encode_corpus(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        K.encode_corpus(df, keep=["ids"])


def test_ranks_must_be_dense(tmp_path):
    p = tmp_path / "r"
    p.write_text("YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError):
        K.read_ranks(str(p))
