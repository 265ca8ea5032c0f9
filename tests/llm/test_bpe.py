"""Encoding by forced boundaries against the tokenizer library."""

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestone.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " \n ", "one", "Hello, World's 12 don't WE'LL !'s ''s", "x<|endoftext|>y <|STARTOFTEXT|> <|startoftext|><|", "İSTANBUL ΣΑΣ ﬁ é ǅ Å", "a\tb\r\nc d \x1c\x85 　z",
    "123４５ \U0001f600‍日本語テキスト 한국어", "a" * 3000, "</w> x</w>y", "\x00\x01 ~", "xq" * 800 + "zj%%%***", "équeçoi. Straße ñandú ×÷ ªº", "one two " * 300000,
]

_kept = {}


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def plain(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)


def test_whole_table(spark, library):
    rows = [(i, t, f"k{i}", "old") for i, t in enumerate(TEXTS)] + [(3, "one", None, "old"), (None, "no id", "k", "old")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, joined string, IDS string").repartition(3)
    got = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert got[0].__fields__ == ["doc_id", "text", "joined", "ids", "decoded"] and len(got) == len(rows)
    for r in got:
        assert (bytes(r.ids), r.decoded) == plain(library, r.text)
    assert bpe.encode(docs.limit(0), PATH).count() == 0
    odd = spark.createDataFrame([(None,), (np.array([320, 999999, 2], "<u4").tobytes(),)], "ids binary")
    assert sorted(r.decoded for r in bpe.decode(odd, PATH).collect()) == ["", library.decode([320, 2], skip_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abcestAZ' \n.!<|>09éßñÑ´`"), st.characters(codec="utf-8")), max_size=40), max_size=4))
def test_any_text(texts):
    library, codec = _kept.setdefault("library", None) or Tokenizer.from_file(PATH), bpe.codec(PATH)
    _kept["library"] = library
    for text, ids in zip(texts, codec.encode(pa.array(texts, pa.string())), strict=True):
        want, decoded = plain(library, text)
        assert ids == want and codec.decode(ids) == decoded


def test_boundaries_are_forced(library):
    """No token of the vocabulary holds a pair that cuts, and runs with cuts fall apart there."""
    codec = bpe.codec(PATH)
    inside = {t[i : i + 2] for t in library.get_vocab(with_added_tokens=False) for i in range(len(t.removesuffix("</w>")) - 1)}
    assert inside == codec.joined and 0 < codec.together.sum() < 1 << 16
    assert "".join(codec.fragments("thexqzj")) == "thexqzj" and all(f[i : i + 2] in inside for f in codec.fragments("thexqzj") for i in range(len(f) - 1))
    for word in ("internationalisation", "aaaaaaa", "zzxxqq"):
        assert codec.merge([codec.inner[c] for c in word[:-1]] + [codec.final[word[-1]]]) == library.encode(word, add_special_tokens=False).ids


def test_query(spark, library):
    from lodestone.llm.shared import table

    docs = table(spark, "/root/testdata/sf0.001", "documents")
    want = {r.doc_id: plain(library, r.text) for r in docs.select("doc_id", "text").collect()}
    got = bpe.op11_bpe(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(want)
    for r in got:
        ids, decoded = want[r.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
