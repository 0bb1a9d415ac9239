import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from govspark.llm import token_files
from tests.llm.test_encoding import WORDS

TOKENIZER = Tokenizer.from_str(WORDS)


def _same(texts, encoder):
    for text, packed in zip(texts, encoder.encode(texts, 2)):
        assert np.frombuffer(packed, "<u2").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids + [2]


ENCODER = token_files.Encoder(WORDS, "<u2")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aabS'stlrevdmI.,</>w  \n\t\x0b\r\x1c\x7f\x00019é"), st.characters(codec="utf-8")), max_size=60), max_size=5))
def test_encodes_like_the_public_library(texts):
    _same(texts, ENCODER)


def test_added_tokens_contractions_and_a_small_memory(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_ENTRIES", 4)
    encoder, texts = token_files.Encoder(WORDS, "<u2"), ["It's we'll I'D 've '' '?s", "a<|endoftext|>b <|startoftext|>", "</w> a</w>b", "x" * 3000 + " 12a3\nB",
                                                        "İΣ café Å", ""]
    for _ in range(2):
        _same(texts, encoder)


def test_a_word_that_many_runs_hold_goes_to_the_library_once(monkeypatch):
    encoder, asked = token_files.Encoder(WORDS, "<u2"), []
    library = encoder._library
    monkeypatch.setattr(encoder, "_library", lambda texts: (asked.extend(texts), library(texts))[1])
    words = encoder._library_words
    monkeypatch.setattr(encoder, "_library_words", lambda texts: (asked.extend(texts), words(texts))[1])
    _same(["tharly Tharly, (tharly) THARLY. tharly;\ntharly"], encoder)
    assert sorted(asked) == ["(", ")", ",", ".", ";", "tharly"]


def test_blocks_of_any_size_unpack_together():
    rng = np.random.default_rng(1)
    code = token_files.Code(token_files.code_lengths(np.bincount(rng.zipf(1.3, 50_000) % 3000, minlength=3000)))
    known = np.flatnonzero(code.lengths)
    blocks = [rng.choice(known, n) for n in (0, 1, 255, 256, 257, 9000, 0)]
    got = code.unpack_all([(*code.pack(b), len(b)) for b in blocks])
    assert [g.tolist() for g in got] == [b.tolist() for b in blocks]


def test_words_with_letters_of_latin_1_go_to_the_library_as_pre_tokens(monkeypatch):
    encoder, whole, pieces = token_files.Encoder(WORDS, "<u2"), [], []
    library, words = encoder._library, encoder._library_words
    monkeypatch.setattr(encoder, "_library", lambda texts: (whole.extend(texts), library(texts))[1])
    monkeypatch.setattr(encoder, "_library_words", lambda texts: (pieces.extend(texts), words(texts))[1])
    _same(["Éa éa, (ÉA) éa.\nß ñ×ñ a÷a", "中 e\u0301a ²µ éa<|endoftext|>", ""], encoder)
    assert sorted(p for p in pieces if p) == ["(", ")", ",", ".", "ß", "éa"]
    assert sorted(whole) == sorted(["ñ×ñ", "a÷a", "中", "e\u0301a", "²µ", "éa<|endoftext|>"])


LATIN = st.text(alphabet="abSst'lre É é ß ÿ×÷ªµ²\xa0\x85 \n\t,9!", max_size=80)


@settings(max_examples=300, deadline=None)
@given(st.lists(LATIN, max_size=5))
def test_latin_1_encodes_like_the_public_library(texts):
    _same(texts, ENCODER)
