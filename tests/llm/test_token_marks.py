"""Ids of words put together are those of the text, for every letter with every mark."""

import string

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkwake.llm import packing


@pytest.fixture(scope="module")
def both():
    tokenizers = pytest.importorskip("tokenizers")
    of = tokenizers.Tokenizer.from_file(packing.vocabulary())
    return packing.WordTokenizer(packing.vocabulary()), lambda t: np.array(of.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_letters_with_marks(both):
    words, whole = both
    for mark in map(chr, range(0x300, 0x346)):
        texts = [f"{a}{c}{mark}{b}, {c}{mark}. {c} {mark}" for c in string.ascii_letters for a, b in (("", ""), ("x", "Y"))]
        assert words.encode(texts) == list(map(whole, texts))


LETTERS = "aTHJWYwIİßſKÅéÉņ̱̃̈̌̊́ͅ.,'!-<|> \n　 "


@settings(deadline=None, max_examples=300)
@given(st.lists(st.text(alphabet=LETTERS, max_size=25), max_size=5))
def test_any_text(both, texts):
    words, whole = both
    assert words.encode(texts) == list(map(whole, texts))


def test_words_are_encoded_once_whatever_closes_them(both, monkeypatch):
    tok, plain = both
    of, seen = tok.of, []

    class Counting:
        def __getattr__(self, name):
            return getattr(of, name)

        def encode(self, text, **more):
            seen.extend(text.split())
            return of.encode(text, **more)

        def encode_batch_fast(self, texts, **more):
            seen.extend(w for t in texts for w in t.split())
            return of.encode_batch_fast(texts, **more)

    monkeypatch.setattr(tok, "of", Counting())
    words = [f"{a}{b}{c}ley" for a in "bcdf" for b in "aeio" for c in "lmnr"]
    texts = [" ".join(w + tail for w in words) for tail in ("", ".", "###", "***", "%%%", "?!)", "$$$,")]
    assert tok.encode(texts) == [plain(t) for t in texts]
    assert len(seen) <= len(words) + len(texts)
