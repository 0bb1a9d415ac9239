"""Language identification: the sample is the same at every run, predictions are those of a plain nearest-centroid reading."""

import math
import random
from collections import Counter

import numpy as np

from govspark.llm import language_id
from govspark.llm.common import mix64
from govspark.runtime import local_frame

SCHEMA = "doc_id long, text string, lang string"
WORDS = {"en": "the cat and dog house with reading".split(), "de": "der Hund und das große Haus über".split(), "fr": "le chat été où la maison très".split()}


def rows(seed, n=300):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        lang = rnd.choice(list(WORDS))
        out.append((rnd.choice([None, None, i, 7]), " ".join(rnd.choice(WORDS[lang]) for _ in range(rnd.randint(3, 20))), lang))
    return out + out[:40]


def test_reruns_learn_the_same_rows(spark, monkeypatch):
    """Most rows have no id or one id, some are repeated, and the rows lie in other partitions each time."""
    monkeypatch.setattr(language_id, "SAMPLE", 25)
    data = rows(1)
    found = [language_id.sample(local_frame(spark, random.Random(s).sample(data, len(data)), SCHEMA).repartition(parts)) for s, parts in ((1, 1), (2, 3), (3, 7))]
    assert found[0] == found[1] == found[2]
    texts, langs = found[0]
    assert set(langs) == set(WORDS) and max(Counter(langs).values()) <= 25 and len(set(zip(texts, langs))) > 20
    assert all(any(t == text and lang == label for _, text, label in data) for t, lang in zip(texts, langs))


def plain_vector(text, idf):
    """TF-IDF of the hashed 1- to 3-grams of letters, one gram after the other."""
    kept = "".join(c if c.isalpha() else " " for c in text.lower())
    plain = " " + " ".join(kept.split()) + " "
    cells = Counter()
    for n in (1, 2, 3):
        for i in range(len(plain) - n + 1):
            key = 0
            for c in plain[i:i + n]:
                key = (key * 0x110000 + ord(c)) % (1 << 64)
            cells[int(mix64(np.array([(key + n * 0x1E3779B97F4A7C15) % (1 << 64)], dtype=np.uint64))[0]) % language_id.DIMENSIONS] += 1
    weighed = {c: math.log1p(k) * idf[c] for c, k in cells.items()}
    length = math.sqrt(sum(v * v for v in weighed.values()))
    return {c: v / length for c, v in weighed.items()}


def test_predictions_are_the_nearest_centroids(spark):
    data = rows(2, 150)
    model = language_id.fit([t for _, t, _ in data], [lang for _, _, lang in data])
    texts = [t for _, t, _ in rows(3, 40)] + ["x", "Zug und cat", "été 12 dog", None, "", "123"]
    df = local_frame(spark, [(i, t, "en") for i, t in enumerate(texts)], SCHEMA + "").selectExpr("doc_id", "text", "lang", "1 AS score", "'a' AS lang_pred")
    got = {r.doc_id: r for r in language_id.identify(df, model).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        if not t or not any(c.isalpha() for c in t):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        vector = plain_vector(t, model.idf)
        cosine = [sum(v * centre[c] for c, v in vector.items()) for centre in model.centroids]
        best = max(range(len(cosine)), key=cosine.__getitem__)
        assert abs(got[i].cosine - cosine[best]) < 1e-9 and got[i].lang_pred == model.languages[model.owner[best]]
        assert 0 <= got[i].score <= 1 and got[i].rejected == (1 - cosine[best] > model.reach[best])
