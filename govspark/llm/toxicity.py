"""Toxicity: a bidirectional gated recurrent network with attention pooling, over word and character inputs.

A text is read in windows of ``WINDOW`` words, each beginning half a window after the last, so every pair of neighbours
lies in some window; all windows are scored and the highest score is the text's. A word enters as its own hashed embedding
and as the mean embedding of its character n-grams, each beside how much likelier it is in toxic labelled texts than in
others (the mean, and for n-grams the largest too). Everything that depends on the word alone is computed once per distinct word.

Training is plain numpy in one task, over a bounded sample of labelled rows (``SAMPLE``), in rounds that pick each text's
highest window by the model so far. A training text is read with the likelihoods of the half of the sample it is not in.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from govspark.llm.common import mix64, over_batches, slices, table, texts_of

WINDOW, STRIDE = 32, 16
#: Most labelled rows to train on, toxic and other, and the most characters of one of them.
SAMPLE = {1: 1500, 0: 3500}
SAMPLE_CHARS = 20_000
THRESHOLD = 0.3
#: Empty texts that training adds as not toxic.
EMPTY = 80

_LIKELY, _WORDS, _GRAMS = 1 << 18, 1 << 14, 1 << 14  # sizes of hashed tables
_WORD_DIM, _GRAM_DIM, _HIDDEN = 5, 8, 8
_INPUT = 3 + _WORD_DIM + _GRAM_DIM
_SHORTEST, _LONGEST = 3, 5


def _words(texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct lower-cased words, the word of each place, and the number of words of each text."""
    known: dict[bytes, int] = {}
    split = [(t or b"").lower().split() for t in texts]
    sizes = np.array([len(w) for w in split], dtype=np.int64)
    places = np.fromiter((known.setdefault(w, len(known)) for words in split for w in words), np.int64, int(sizes.sum()))
    return list(known), places, sizes


def _hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each distinct word its hash; for each of its n-grams, boundaries marked, the hash and the word."""
    marked = [b"<" + w.rstrip(b".,;:!?\"')") + b">" for w in words]
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    sizes = np.array([len(m) for m in marked], dtype=np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))  # bytes up to the word's end
    grams, owners, key = [], [], np.zeros(len(data), dtype=np.uint64)
    for n in range(1, _LONGEST + 1):
        ok = np.flatnonzero(left >= n)
        key[ok] = key[ok] * np.uint64(257) + data[ok + n - 1] + np.uint64(1)
        if n >= _SHORTEST:
            grams.append(mix64(key[ok] + np.uint64(n << 56)))
            owners.append(owner[ok])
    starts = np.cumsum(sizes) - sizes
    # A word is its bytes in base 257, summed per word and mixed.
    power = np.ones(int(sizes.max()) if len(sizes) else 0, dtype=np.uint64)
    power[1:] = np.cumprod(np.full(max(len(power) - 1, 0), 257, dtype=np.uint64))
    word = mix64(np.add.reduceat(data * power[np.arange(len(data)) - np.repeat(starts, sizes)], starts)) if len(words) else key
    return word, np.concatenate(grams), np.concatenate(owners)


@dataclass
class Net:
    word_likely: np.ndarray  # two tables of three rows each: by all training texts, by its first half, by its second
    gram_likely: np.ndarray
    p: dict[str, np.ndarray]
    base: float | None = None  # score of every text if the labels cannot train a network

    def inputs(self, words: list[bytes], by: np.ndarray | int = 0) -> tuple[np.ndarray, tuple]:
        """Input vectors of words; the last row is the padding word. ``by`` is the row of the likelihoods to read: 0 for new
        texts; training texts read those of the half that they are not in."""
        n = len(words)
        x = np.zeros((n + 1, _INPUT), dtype=np.float32)
        if not n:
            return x, ()
        word, gram, owner = _hashes(words)
        count = np.maximum(np.bincount(owner, minlength=n), 1).astype(np.float32)
        by = np.broadcast_to(by, n)
        likely = _likely(self.gram_likely, by[owner], gram)
        top = np.full(n, -9, dtype=np.float32)
        np.maximum.at(top, owner, likely)
        x[:n, 0] = _likely(self.word_likely, by, word)
        x[:n, 1] = np.where(top > -9, top, 0)
        x[:n, 2] = np.bincount(owner, weights=likely, minlength=n) / count
        w, g = (word % _WORDS).astype(np.int64), (gram % _GRAMS).astype(np.int64)
        x[:n, 3:3 + _WORD_DIM] = self.p["word"][w]
        for d in range(_GRAM_DIM):
            x[:n, 3 + _WORD_DIM + d] = np.bincount(owner, weights=self.p["gram"][g, d], minlength=n) / count
        return x, (w, g, owner, count)

    def all_inputs(self, words: list[bytes]) -> np.ndarray:
        """``inputs`` of many words, made a part at a time."""
        parts = [self.inputs(words[a:a + 20_000])[0][:-1] for a in range(0, len(words), 20_000)]
        return np.concatenate([*parts, np.zeros((1, _INPUT), dtype=np.float32)])

    def forward(self, places: np.ndarray, x: np.ndarray, trace: bool = False):
        """Logits of windows (rows of word places, -1 for padding) of words with inputs ``x``."""
        n, steps, h = len(places), places.shape[1], _HIDDEN
        mask = (places >= 0).astype(np.float32)
        outs, kept = [], []
        for side, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            ready = x @ self.p["x" + side] + self.p["c" + side]
            u, un = self.p["u" + side], self.p["n" + side]
            state, seq, tape = np.zeros((n, h), dtype=np.float32), np.empty((steps, n, h), dtype=np.float32), []
            for t in order:
                a = ready[places[:, t]]
                zr = _sigmoid(a[:, :2 * h] + state @ u)
                z, r = zr[:, :h], zr[:, h:]
                new = np.tanh(a[:, 2 * h:] + (r * state) @ un)
                m = mask[:, t:t + 1]
                if trace:
                    tape.append((t, state, z, r, new))
                state = state + m * z * (new - state)
                seq[t] = state
            outs.append(seq)
            kept.append(tape)
        s = np.concatenate(outs, axis=2)
        e = np.tanh(s @ self.p["a"]) @ self.p["v"]
        e = np.where(mask.T > 0, e, -1e9)
        w = np.exp(e - e.max(axis=0)) * mask.T
        w /= np.maximum(w.sum(axis=0), 1e-9)
        pooled = (w[:, :, None] * s).sum(axis=0)
        logit = pooled @ self.p["o"] + self.p["d"]
        return (logit, (mask, s, w, pooled, kept)) if trace else logit

    def gradient(self, places: np.ndarray, x: np.ndarray, target: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the mean cross-entropy: of the weights, and of the inputs of each word."""
        logit, (mask, s, w, pooled, kept) = self.forward(places, x, True)
        n, h, p = len(places), _HIDDEN, self.p
        g = {k: np.zeros_like(p[k]) for k in p if k not in ("word", "gram")}
        dl = ((_sigmoid(logit) - target) / n).astype(np.float32)
        g["o"], g["d"] = pooled.T @ dl, dl.sum(keepdims=True)
        dp = dl[:, None] * p["o"]
        ds = w[:, :, None] * dp
        dw = (s * dp).sum(axis=2)
        de = w * (dw - (w * dw).sum(axis=0))
        hidden = np.tanh(s @ p["a"])
        g["v"] = np.einsum("tnk,tn->k", hidden, de)
        dh = de[:, :, None] * p["v"] * (1 - hidden ** 2)
        g["a"] = np.einsum("tnh,tnk->hk", s, dh)
        ds = ds + dh @ p["a"].T
        dx = np.zeros_like(x)
        for side, tape, part in (("f", kept[0], ds[:, :, :h]), ("b", kept[1], ds[:, :, h:])):
            u, un, dstate = p["u" + side], p["n" + side], np.zeros((n, h), dtype=np.float32)
            dready = np.zeros((len(x), 3 * h), dtype=np.float32)
            for t, state, z, r, new in reversed(tape):
                m = mask[:, t:t + 1]
                total = dstate + part[t]
                dz = total * m * (new - state) * z * (1 - z)
                dnew = total * m * z * (1 - new ** 2)
                back = dnew @ un.T
                g["n" + side] += (r * state).T @ dnew
                dr = back * state * r * (1 - r)
                dzr = np.concatenate((dz, dr), axis=1)
                g["u" + side] += state.T @ dzr
                dstate = total * (1 - m * z) + back * r + dzr @ u.T
                np.add.at(dready, places[:, t], np.concatenate((dzr, dnew), axis=1))
            dready[-1] = 0  # padding
            g["x" + side] += x.T @ dready
            g["c" + side] += dready.sum(axis=0)
            dx += dready @ p["x" + side].T
        return g, dx

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        if self.base is not None:
            return np.full(len(texts), self.base)
        words, places, sizes = _words(texts)
        starts, owner = _windows(sizes)
        x = self.inputs(words)[0]
        out = np.full(len(texts), -np.inf)
        for a in range(0, len(starts), 1 << 13):
            part = slice(a, a + (1 << 13))
            np.maximum.at(out, owner[part], self.forward(_cut(places, sizes, starts[part], owner[part]), x))
        return _sigmoid(out)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of each window within its text, and the text: at least one window for every text."""
    counts = np.maximum(-(-(sizes - (WINDOW - STRIDE)) // STRIDE), 1)
    owner = np.repeat(np.arange(len(sizes)), counts)
    return (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * STRIDE, owner


def _cut(places, sizes, starts, owner) -> np.ndarray:
    """Word places of windows, -1 beyond the text."""
    first = (np.cumsum(sizes) - sizes)[owner] + starts
    at = starts[:, None] + np.arange(WINDOW)
    index = np.minimum(first[:, None] + np.arange(WINDOW), max(len(places) - 1, 0))
    return np.where(at < sizes[owner][:, None], places[index] if len(places) else -1, -1)


class _Likelihoods:
    """By hash, the log of how much likelier a toxic text holds it, drawn to 0 by ``prior`` texts of the usual mix: by all
    texts and by those of each half. Counts are added up a few texts at a time, in two tables by different bits of the hash:
    what shares a place with a telling word in one of them hardly does in the other."""

    def __init__(self, toxic: np.ndarray, half: np.ndarray):
        self.toxic, self.half, self.counts = toxic, half, np.zeros((2, 2, 2, _LIKELY))  # by table, half and label

    def add(self, hashed: np.ndarray, owner: np.ndarray) -> None:
        for at, counts in zip(_slots(hashed), self.counts):
            pairs = np.unique(owner.astype(np.int64) * _LIKELY + at)
            text = pairs // _LIKELY
            np.add.at(counts, (self.half[text], self.toxic[text], pairs % _LIKELY), 1)

    def table(self, prior: float = 10.0) -> np.ndarray:
        p = self.toxic.mean()
        odds = lambda c: np.log(((c[1] + prior * p) / (c[0] + prior * (1 - p))) * ((1 - p) / p))
        return np.stack([[odds(c) for c in (t.sum(axis=0), t[0], t[1])] for t in self.counts]).astype(np.float32)


def _slots(hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (hashed % _LIKELY).astype(np.int64), ((hashed >> np.uint64(32)) % _LIKELY).astype(np.int64)


def _likely(table: np.ndarray, by: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """What the two tables say, the weaker of them."""
    a, b = (t[by, at] for t, at in zip(table, _slots(hashed)))
    return np.where(np.abs(a) < np.abs(b), a, b)


def _originals(texts: list[bytes | None]) -> list[int]:
    """Places of texts that are no near copies of an earlier one: those that share none of three min-hashes of word triples
    with it. A text that is copied often would otherwise pass its rare words off as signs of its label."""
    seen: list[set] = [set(), set(), set()]
    kept = []
    for i, text in enumerate(texts):
        words = (text or b"").lower().split()
        triples = np.fromiter((xxhash.xxh3_64_intdigest(b" ".join(words[j:j + 3])) for j in range(max(len(words) - 2, 1))), np.uint64)
        low = [int(mix64(triples + np.uint64(k << 60)).min()) for k in range(3)]
        if not any(h in s for h, s in zip(low, seen)):
            kept.append(i)
        for h, s in zip(low, seen):
            s.add(h)
    return kept


def train(texts: list[bytes | None], toxic: np.ndarray, seed: int = 3, rounds: int = 3, epochs: int = 2, batch: int = 128, steps: int = 60) -> Net:
    """A network from labelled texts. Without a toxic one there is nothing to learn and every score is 0."""
    kept = _originals(texts)
    texts, toxic = [texts[i] for i in kept], np.asarray(toxic, dtype=np.int64)[np.array(kept, dtype=int)]
    if len(texts):  # texts without words are not toxic
        texts, toxic = [*texts, *[b""] * EMPTY], np.append(toxic, np.zeros(EMPTY))
    toxic = np.asarray(toxic, dtype=np.int64)
    random = np.random.default_rng(seed)
    p = {"word": np.zeros((_WORDS, _WORD_DIM)), "gram": np.zeros((_GRAMS, _GRAM_DIM)), "a": (2 * _HIDDEN, 8), "v": (8,),
         "o": (2 * _HIDDEN,), "d": np.full(1, -3.0)}
    for side in "fb":
        p |= {"x" + side: (_INPUT, 3 * _HIDDEN), "u" + side: (_HIDDEN, 2 * _HIDDEN), "n" + side: (_HIDDEN, _HIDDEN),
              "c" + side: np.zeros(3 * _HIDDEN)}
    p = {k: (random.normal(0, 0.3, v) if isinstance(v, tuple) else v).astype(np.float32) for k, v in p.items()}
    p["word"] += random.normal(0, 0.05, p["word"].shape).astype(np.float32)
    p["gram"] += random.normal(0, 0.05, p["gram"].shape).astype(np.float32)
    net = Net(np.zeros((2, 3, _LIKELY), np.float32), np.zeros((2, 3, _LIKELY), np.float32), p)
    if not toxic.any():
        net.base = 0.0
        return net
    half = random.integers(0, 2, len(toxic))
    words, places, sizes = _words(texts)
    word, gram, owner = _hashes(words)
    order = np.argsort(owner, kind="stable")
    gram, counts = gram[order], np.bincount(owner, minlength=len(words))
    first, ends = np.cumsum(counts) - counts, np.cumsum(sizes)
    by_word, by_gram = _Likelihoods(toxic, half), _Likelihoods(toxic, half)
    for a in range(0, len(texts), 128):
        b = min(a + 128, len(texts))
        own = places[ends[a] - sizes[a]:ends[b - 1]]
        pair = np.unique(np.repeat(np.arange(a, b), sizes[a:b]) * len(words) + own) if len(own) else own
        text, place = pair // max(len(words), 1), pair % max(len(words), 1)
        by_word.add(word[place], text)
        lengths = counts[place]
        index = np.repeat(first[place] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        by_gram.add(gram[index], np.repeat(text, lengths))
    net.word_likely, net.gram_likely = by_word.table(), by_gram.table()

    target = toxic.astype(np.float32)
    starts, owner = _windows(sizes)
    cut = _cut(places, sizes, starts, owner).astype(np.int32)
    x = net.all_inputs(words)
    likely = x[:, 0] + x[:, 1]
    logit = np.concatenate([likely[cut[a:a + 8192]].max(axis=1) for a in range(0, len(cut), 8192)])  # before training: the likeliest word
    moments: dict[str, list] = {}
    step = 0
    picked: np.ndarray = np.empty(0, dtype=np.int64)
    for _ in range(rounds):
        order = np.lexsort((-logit, owner))
        top = order[np.append(True, owner[order][1:] != owner[order][:-1])]
        low = random.integers(0, len(starts), len(top))
        low = low[target[owner[low]] == 0]
        # Highest windows of now and of earlier rounds where the text is not toxic; the present one where it is.
        picked = np.unique(np.concatenate((picked[target[owner[picked]] == 0], top, low)))
        parts = max(1, len(picked) // batch)
        for _ in range(max(epochs, -(-steps // parts))):  # small samples take as many steps as larger ones
            for at in np.array_split(random.permutation(picked), parts):
                step += 1
                other = 1 - half[owner[at]]
                used, local = np.unique(np.where(cut[at] >= 0, 2 * cut[at] + other[:, None], -1), return_inverse=True)
                pad = int(used[0] < 0)
                used = used[pad:]
                x = net.inputs([words[i] for i in used // 2], used % 2 + 1)
                if not len(used):
                    continue
                grads, dx = net.gradient(local.reshape(cut[at].shape) - pad, x[0], target[owner[at]])
                w, g, own, count = x[1]
                grads["word"], grads["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
                np.add.at(grads["word"], w, dx[:-1, 3:3 + _WORD_DIM])
                np.add.at(grads["gram"], g, (dx[:-1, 3 + _WORD_DIM:] / count[:, None])[own])
                for k, v in grads.items():
                    m = moments.setdefault(k, [np.zeros_like(v), np.zeros_like(v)])
                    m[0] += 0.1 * (v - m[0])
                    m[1] += 0.01 * (v * v - m[1])
                    p[k] -= (0.001 if k in ("word", "gram") else 0.01) * (m[0] / (1 - 0.9 ** step)) / (np.sqrt(m[1] / (1 - 0.99 ** step)) + 1e-6)
        x = net.all_inputs(words)
        logit = np.concatenate([net.forward(cut[a:a + 8192], x) for a in range(0, len(cut), 8192)])
    return net


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """label, text of the labelled rows to train on: of each label up to ``SAMPLE`` rows outside the held-out fold, by hash
    of doc_id. Null labels and ids do not count; if a document has several labels the highest holds."""
    free = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL AND crc32(cast(doc_id AS string)) % 4 <> 2")
    free = free.groupBy("doc_id").agg(F.max("toxic").alias("label"))
    usable = docs.select("doc_id", "text").where(F.length("text") <= SAMPLE_CHARS)
    known = free.join(usable.select("doc_id").distinct(), "doc_id")  # ids only; texts are not shuffled
    chosen = reduce(DataFrame.union, (known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
                                      for label, most in SAMPLE.items()))
    # At most as many ids as SAMPLE says; a document that repeats counts once.
    return usable.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(
        F.max("label").alias("label"), F.min("text").alias("text")).select("label", "text")


def trained(docs: DataFrame, labels: DataFrame) -> Net:
    """The network that one task trains on the sample, which is bounded; it comes back as one row."""
    def run(batches):
        rows = sorted(row for batch in batches for row in zip(batch.column("label").to_pylist(), texts_of(batch)))
        net = train([text for _, text in rows], np.array([label for label, _ in rows], dtype=np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((net.word_likely, net.gram_likely, net.p, net.base))], pa.binary())], names=["net"])

    row = sample(docs, labels).coalesce(1).mapInArrow(run, "net binary").first()
    return Net(*pickle.loads(row["net"])) if row else train([], np.empty(0))  # no rows, no task


def score(df: DataFrame, net: Net) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; null and empty texts are scored as an empty window,
    which training knows as not toxic. Repeated and null doc_id are scored row by row; other columns are not read."""
    shared = df.sparkSession.sparkContext.broadcast(net)  # tables of fixed size, about 15 MB

    def run(batch: pa.RecordBatch):
        ids, texts = batch.column("doc_id").to_pylist(), texts_of(batch)
        for a, b in slices(texts):
            values = shared.value.scores(texts[a:b])
            yield {"doc_id": ids[a:b], "score": values, "predicted": (values >= THRESHOLD).astype(np.int32)}

    scored = over_batches(df.select("doc_id", "text"), run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def held_out(doc_id: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def keep(df: DataFrame, net: Net) -> DataFrame:
    """The rows that are not predicted toxic, with all their columns. One narrow pass, no shuffle."""
    shared, schema = df.sparkSession.sparkContext.broadcast(net), df.schema

    def run(batches):
        arrow = to_arrow_schema(schema)
        for batch in batches:
            texts = texts_of(batch)
            for a, b in slices(texts):
                kept = shared.value.scores(texts[a:b]) < THRESHOLD
                part = batch.slice(a, b - a).filter(pa.array(kept))
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(part.columns, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, trained(docs, table(spark, sf_dir, "labels")))
