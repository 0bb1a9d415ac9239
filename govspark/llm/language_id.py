"""Language identification: nearest centroid of normalised TF-IDF character n-grams, with rejection by distance.

A text is lower-cased and counted as 1- to 3-grams of its letters, hashed into one vector; sublinear counts are weighted by
the inverse document frequency and scaled to length 1. Each language has several centroids, found by spherical k-means on a
bounded sample of its labelled rows. The nearest centroid by cosine names the language; a text farther from it than nearly
all training texts of that centroid were is marked as rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from govspark.llm.common import mix64, over_batches, slices, table
from govspark.llm.toxicity import held_out

DIMENSIONS = 1 << 13
LONGEST = 3
#: Rows per language to learn from, their longest text in characters, and centroids per language.
SAMPLE, SAMPLE_CHARS, CENTROIDS = 600, 20_000, 4
#: Share of a centroid's training texts that its rejection distance admits.
ADMITTED = 0.995
#: Sharpness of the score, a softmax over the best cosine of each language.
SHARPNESS = 20.0

_not_letters = regex.compile(r"[^\p{L}\p{M}]+")
_letter = regex.compile(r"\p{L}")


def counts(text: str) -> np.ndarray:
    """Hashed counts of the n-grams of a whole text; runs of other characters than letters are one blank."""
    plain = " " + _not_letters.sub(" ", text.lower()).strip() + " "
    points = np.frombuffer(plain.encode("utf-32-le"), np.uint32).astype(np.uint64)
    out, key = np.zeros(DIMENSIONS), np.zeros(len(points), dtype=np.uint64)
    for n in range(1, LONGEST + 1):
        if len(points) < n:
            break
        key = (key[:len(points) - n + 1] if n == 1 else key[:-1]) * np.uint64(0x110000) + points[n - 1:]
        out += np.bincount((mix64(key + np.uint64(n * 0x1E3779B97F4A7C15)) % np.uint64(DIMENSIONS)).astype(np.int64), minlength=DIMENSIONS)
    return out


@dataclass
class Model:
    """Learned languages by their centroids: rows of unit length, the language of each, and its largest admitted distance."""

    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    reach: np.ndarray
    languages: list[str]

    def vectors(self, texts: list[str]) -> np.ndarray:
        x = np.array([counts(t) for t in texts]).reshape(-1, DIMENSIONS)
        x = np.log1p(x) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def predict(self, texts: list[str | None]) -> dict[str, list]:
        plain = [t if t and _letter.search(t) else None for t in texts]
        named, scores, near, rejected = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts), [True] * len(texts)
        rows = [i for i, t in enumerate(plain) if t]
        for a in range(0, len(rows) if self.languages else 0, 256):
            part = rows[a:a + 256]
            cosine = self.vectors([plain[i] for i in part]) @ self.centroids.T
            best = np.full((len(part), len(self.languages)), -1.0)
            for c, lang in enumerate(self.owner):
                best[:, lang] = np.maximum(best[:, lang], cosine[:, c])
            lang, centre = best.argmax(axis=1), cosine.argmax(axis=1)
            soft = np.exp(SHARPNESS * (best - best.max(axis=1, keepdims=True)))
            for i, k, c, row, s in zip(part, lang, centre, cosine, soft):
                named[i], scores[i], near[i] = self.languages[k], float(s[k] / s.sum()), float(row[c])
                rejected[i] = bool(1 - row[c] > self.reach[c])
        return {"lang_pred": named, "score": scores, "cosine": near, "rejected": rejected}


def fit(texts: list[str], langs: list[str], seed: int = 5, rounds: int = 12) -> Model:
    """Centroids from labelled texts; texts without letters do not count. Without any text nothing is learned and every
    prediction is ``und``."""
    usable = [(t, lang) for t, lang in zip(texts, langs) if t and _letter.search(t)]
    languages = sorted({lang for _, lang in usable})
    model = Model(np.zeros(DIMENSIONS), np.zeros((0, DIMENSIONS)), np.zeros(0, dtype=int), np.zeros(0), languages)
    if not usable:
        return model
    random = np.random.default_rng(seed)
    seen = np.zeros(DIMENSIONS)
    for t, _ in usable:
        seen += counts(t) > 0
    model.idf = np.log((1 + len(usable)) / (1 + seen)) + 1
    rows, owner, reach = [], [], []
    for k, lang in enumerate(languages):
        x = model.vectors([t for t, l in usable if l == lang])
        centres = x[random.choice(len(x), min(CENTROIDS, len(x)), replace=False)]
        for _ in range(rounds):
            near = (x @ centres.T).argmax(axis=1)
            sums = np.array([x[near == c].sum(axis=0) if (near == c).any() else centres[c] for c in range(len(centres))])
            centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        cosine = x @ centres.T
        near = cosine.argmax(axis=1)
        for c in range(len(centres)):
            own = 1 - cosine[near == c, c]
            rows.append(centres[c])
            owner.append(k)
            reach.append(np.quantile(own, ADMITTED) if len(own) else 0.0)
    model.centroids, model.owner, model.reach = np.array(rows), np.array(owner), np.array(reach)
    return model


def sample(docs: DataFrame) -> tuple[list[str], list[str]]:
    """Per language up to ``SAMPLE`` labelled rows outside the held-out fold: two scans, the first for counts.

    Rows are taken in the order of a hash of doc_id and text, equal ones once, so reruns learn the same rows whatever repeats
    or lacks an id. A limit on the hash that about ``SAMPLE`` and a half of a language pass keeps the sort small."""
    free = docs.select("doc_id", "lang", "text").where(~held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in free.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    if not sizes:
        return [], []
    limit = F.lit(0)
    for lang, n in sizes.items():
        limit = F.when(F.col("lang") == lang, min(1 << 20, (1 << 20) * 3 * SAMPLE // (2 * n) + 1)).otherwise(limit)
    h = F.xxhash64("doc_id", "text")
    passed = free.where((F.pmod(h, F.lit(1 << 20)) < limit) & (F.length("text") <= SAMPLE_CHARS)).select("lang", h.alias("h"), "text")
    once = passed.groupBy("lang", "h").agg(F.min("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 20)), "h"))
    rows = once.withColumn("place", place).where(F.col("place") <= SAMPLE).orderBy("lang", "place").collect()
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def identify(df: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cosine, rejected of every row of (doc_id, text).

    ``lang_pred`` is the nearest learned language also where ``rejected`` says that the text resembles none; null texts and
    texts without letters are ``und`` with score 0. Repeated and null doc_id are predicted row by row."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # a few centroids of fixed size per language

    def run(batch: pa.RecordBatch):
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        for a, b in slices(texts):
            yield {"doc_id": ids[a:b], **shared.value.predict(texts[a:b])}

    found = over_batches(df.select("doc_id", "text"), run,
                         "doc_id long, lang_pred string, score double, cosine double, rejected boolean")
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "cosine", "rejected")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(*sample(docs)))
