"""Links of near-duplicates against all pairs, where ASCII and Unicode readings of a text fall on other sides of the threshold."""

import random

from pyspark.sql import functions as F

from govspark.llm import near_dedup
from govspark.runtime import local_frame

HOW = near_dedup.Similarity(words=3, percent=85)


def _texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    out = []
    for case in range(4):
        base = [word() for _ in range(200)]
        other = list(base)
        if case == 0:  # one word in bytes, eighty when no-break spaces split
            other[100] = "\u00a0".join(word() for _ in range(80))
        if case == 1:
            other[100] = "\u3000".join(word() for _ in range(80))
        if case > 1:  # equal only when other capitals than A-Z fold
            for i in range(5, 200, 20):
                low, high = (("\u00fc", "\u00dc"), ("\u0436", "\u0416"))[case - 2]
                base[i], other[i] = low + base[i], high + base[i]
        out += [" ".join(base), " ".join(other)]
    return out


def _shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[i:i + HOW.words]) for i in range(len(words) - HOW.words + 1)}


def test_against_all_pairs(spark):
    texts = _texts()
    sets = [_shingles(t) for t in texts]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])] * 3
    linked = {(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= HOW.percent * len(sets[i] | sets[j])}
    assert linked == {(1, 0), (3, 2)}
    got = near_dedup.near_duplicates(local_frame(spark, rows, "doc_id long, text string"), HOW)
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(i, 2 * (i // 2) if i < 4 else i) for i in range(8)}
    assert got.count() == 11 and got.where(F.col("doc_id") > 3).agg(F.sum("found_links")).first()[0] == 0
