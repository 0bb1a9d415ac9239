import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from govspark.llm import spelling
from govspark.llm.spelling import Spelling, misspelt, variants, word_counts
from govspark.runtime import local_frame

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(counts, ratio=10):
    """Every pair of words compared."""
    form, out = {}, {}
    for w, n in counts.items():
        around = [v for v in counts if near(w, v)]
        best = min(around, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
        out[w] = (len(around), counts[form[w]] if form[w] else None)
    rows = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n, *out[w]))
    return rows


def counted(rows, letters=7, least=2, errors=True):
    found = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if errors and h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            found[run] += len(run) >= letters
    return {w: n for w, n in found.items() if n >= least}


def got(df):
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("letters", ["ab", "aé", "abcdÿ"])
def test_against_every_pair(spark, letters):
    """Many neighbours, long runs of one letter, ties in counts, chains of forms."""
    rng = random.Random(len(letters) + ord(letters[-1]))
    counts = {}
    for _ in range(350):
        word = "".join(rng.choice(letters) for _ in range(rng.randrange(3, 9)))
        counts[word] = rng.choice([2, 3, 20, 30, 200, 300, 2000, 20000])
    df = local_frame(spark, list(counts.items()), "word string, n long").repartition(3)
    assert got(variants(df)) == plain(counts)


def test_counts_and_errors(spark, awkward):
    rng = random.Random(5)
    vocabulary = ["reading", "Reader", "readers", "großen", "ÜBERALL", "überall", "Überalle", "naïvely", "mississippi", "committee", "comittee"]
    rows = [(i if i % 5 else None, " ".join(rng.choice(vocabulary) for _ in range(40)) + rng.choice([".", "×", "1x", "字"])) for i in range(200)]
    docs = local_frame(spark, rows, "doc_id long, text string")
    counts = counted(rows)
    assert {r.word: r.n for r in word_counts(docs, alter=misspelt).collect()} == counts
    assert {r.word: r.n for r in word_counts(docs).collect()} == counted(rows, errors=False)
    assert got(variants(word_counts(docs, alter=misspelt))) == plain(counts)
    strange = awkward("n").collect()
    assert got(variants(word_counts(awkward("n"), Spelling(letters=3), misspelt))) == plain(counted([(r.doc_id, r.text) for r in strange], 3))


def test_empty_and_very_long_words(spark, nothing):
    assert variants(word_counts(nothing, alter=misspelt)).count() == 0
    long = "".join(random.Random(1).choice("abc") for _ in range(30_000))
    counts = {long: 2, long[:10_000] + "z" + long[10_000:]: 50, long[:-1]: 7, "x" * 20_000: 3, "x" * 20_001: 3, "alone": 2}
    assert got(variants(local_frame(spark, list(counts.items()), "word string, n long"))) == plain(counts)


def test_nodes_are_numbered_apart(spark, monkeypatch):
    """Where two nodes share a number the seed is raised."""
    real = spelling._dictionary

    def clash(seed):
        def run(batch):
            yield from real(seed)(batch)
            if seed == 0:
                yield {"tree": np.zeros(2, np.int32), "node": np.array([5, 5]), "parent": np.array([1, 2]), "letter": np.array([97, 97], np.int32)}
        return run

    monkeypatch.setattr(spelling, "_dictionary", clash)
    assert spelling._seed(local_frame(spark, [("word", 2)], "word string, n long")) == 1


def test_chains_are_prefixes_and_suffixes():
    words = ["aab", "b", "aa", "aabb"]
    _, sizes, _, start, front, back = spelling._chains(words, 0)
    prefixes, suffixes = {}, {}
    for w, s in zip(words, start):
        for i in range(len(w) + 1):
            assert prefixes.setdefault(w[:i], front[s + i]) == front[s + i]
            assert suffixes.setdefault(w[i:], back[s + i]) == back[s + i]
    assert len(set(prefixes.values())) == len(prefixes) and len(set(suffixes.values())) == len(suffixes)
