import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from volley.llm import bpe
from volley.llm.queries import vocabulary_path

VOCAB = bpe.Vocabulary(vocabulary_path())
REAL = Tokenizer.from_file(vocabulary_path())
WORDS = [b"the", b" the", b" them", b"then", b" worth", b"th", "é".encode(), b" ", b"\n"]
ENC = bpe.Encoder(VOCAB, bpe.compile_lexicon({w: VOCAB.merge(w) for w in WORDS}))


def ids(text):
    return np.frombuffer(ENC.encode(text), "<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" '\n\t\r.,!?09abtheTHElsvemdr\x1c\x1f\x85  　éñß中\U0001f600<|>")), st.characters(exclude_categories=["Cs", "Cn"])), max_size=60))
def test_equals_library(text):
    want = REAL.encode(text, add_special_tokens=False).ids
    assert ids(text) == want
    assert ENC.decode(ENC.encode(text)) == REAL.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "x" * 5000, "ab" * 3000, " " * 3000, "the " * 2000, "don't 've I'LL"])
def test_special_and_long(text):
    assert ids(text) == REAL.encode(text, add_special_tokens=False).ids


def test_lexicon_is_shared_and_exact():
    words = {w: [k] for k, w in enumerate(sorted(a + b for a in [b"x", b"yy", b"zz"] for b in [b"ing", b"ed", b"", b"ings"]))}
    lex = bpe.Lexicon(bpe.compile_lexicon(words))
    assert {w: int.from_bytes(lex.get(w), "little") for w in words} == {w: v[0] for w, v in words.items()}
    assert lex.get(b"y") is None and lex.get(b"xingss") is None and lex.get(b"") is None
    assert len(lex.final) <= 10  # the suffixes of x, yy and zz are one part
    assert bpe.Lexicon(bpe.compile_lexicon({})).get(b"a") is None


def test_documents(spark):
    rows = [(1, "the worth of then", "a"), (2, None, "b"), (3, "", "b"), (3, "", "b"), (None, "naïve <|endoftext|>\n", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = bpe.encode_documents(df, vocabulary_path(), words=3).collect()
    assert len(out) == 5
    for r in out:
        want = REAL.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.n_tokens == len(want) and r.decoded == (r.text or "")
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
    assert bpe.encode_documents(df.limit(0), vocabulary_path()).count() == 0
