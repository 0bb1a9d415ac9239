from collections import Counter

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from govspark.llm import quality_lm

LETTERS = st.one_of(st.sampled_from("abAB \n\t\x1c\x1f\x85\u3000é中\U0001F600İ\x00"), st.characters(codec="utf-8"))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=LETTERS, max_size=60), max_size=5), st.sampled_from([1, 60, 4000, 1 << 22]))
def test_grams_are_exact_and_in_order(texts, dense):
    plain = [quality_lm.plain(t) for t in texts]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(quality_lm, "DENSE", dense)
        found, at, sizes = quality_lm.grams(plain)
    want = [[t[i:i + 4] for i in range(len(t) - 3)] for t in plain]
    assert found == sorted({g for t in want for g in t})
    assert [found[i] for i in at] == [g for t in want for g in t] and sizes.tolist() == [len(t) for t in want]
    assert Counter(at.tolist()) == Counter({found.index(g): n for g, n in Counter(g for t in want for g in t).items()})


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=LETTERS, max_size=60))
def test_blanks_are_those_of_unicode(text):
    assert quality_lm.plain(text) == "\n\n\n" + regex.sub(r"\s+", " ", text).strip().lower() + "\n"


def test_texts_of_one_script_are_not_sorted(monkeypatch):
    def refused(*args, **kwargs):
        raise AssertionError("sorted every place")
    monkeypatch.setattr(np, "unique", refused)
    alphabet = "".join(map(chr, range(33, 97)))
    text = "".join(np.random.default_rng(1).choice(list(alphabet), 20_000))
    assert quality_lm.grams([quality_lm.plain(text)])[0] == sorted({quality_lm.plain(text)[i:i + 4] for i in range(20_001)})
