"""MinHash near-duplicates with sequential Bayesian verification.

1. Texts become sets of hashed word shingles; texts with equal sets collapse into one class, named by its smallest doc_id.
2. Bands of each class's signature are buckets. In every bucket all classes are compared with one pivot, the class that
   shares most buckets with others, so a bucket of n costs n comparisons. Pairs are counted as edges where verified. A class
   hangs on its highest verified pivot; pivots outrank what they meet, so this is a forest, whose roots are found by doubling.
3. Classes that remain apart from their pivot's tree are compared with everything that met the same pivot, in blocks of
   bounded size. So no pair that shares a bucket is left unless both are in one tree already.
4. A comparison looks at the signatures a few hashes at a time. With a uniform prior the similarity has a Beta posterior
   after each; a pair is dropped once the posterior chance of reaching the threshold is below ``miss``. Survivors are
   verified on their full shingle sets, so every edge is exact.
5. Trees are contracted to their roots; the few edges between roots become components by alternating large-star and
   small-star steps.

Bands are as many as make the chance that a pair at the threshold shares none at most ``miss``. Intermediate tables are
written to the shared folder: lost executors cost no more than the stage that they were in.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, comb, log

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from govspark.llm.common import mix64, over_batches, slices, stored, table, texts_of


@dataclass(frozen=True)
class Similarity:
    """Jaccard similarity of at least ``percent``/100 on shingles of ``words`` words; ``miss`` is the chance of losing a
    pair at the threshold, in banding and in verification alike."""

    words: int = 5
    percent: int = 80
    rows: int = 5
    miss: float = 1e-6
    seed: int = 7
    batch: int = 20
    #: Shingles of both sides of a block of comparisons, at most (a single text may have more).
    block: int = 1 << 14

    @property
    def bands(self) -> int:
        return ceil(log(self.miss) / log(1 - (self.percent / 100) ** self.rows))

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    def multipliers(self) -> tuple[np.ndarray, np.ndarray]:
        random = np.random.default_rng(self.seed)
        a = random.integers(0, 1 << 63, self.hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        return a, random.integers(0, 1 << 63, self.hashes, dtype=np.uint64)

    def least_matches(self) -> list[tuple[int, int]]:
        """(hashes seen, fewest matches with which a pair goes on). After m matches of n the posterior of the similarity is
        Beta(m + 1, n - m + 1), whose upper tail at t is the chance of at most m successes in n + 1 draws of chance t."""
        t, out = self.percent / 100, []
        for n in [*range(self.batch, self.hashes, self.batch), self.hashes]:
            tail, m = 0.0, -1
            while tail < self.miss:
                m += 1
                tail += comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
            out.append((n, m))
        return out


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text with A-Z lower-cased; all words as one if there are fewer."""
    found = (text or b"").lower().split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    width = min(words, len(ids))
    out = np.full(len(ids) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + ids[i:len(ids) - width + 1 + i])
    return np.unique(out)


def signature(items: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of each hash function over the items."""
    out = np.full(len(a), np.iinfo(np.uint32).max, dtype=np.uint32)
    for start in range(0, len(items), 1 << 14):
        part = items[start:start + (1 << 14)]
        out = np.minimum(out, ((part[None, :] * a[:, None] + b[:, None]) >> np.uint64(32)).min(axis=1).astype(np.uint32))
    return out


def _described(df: DataFrame, how: Similarity) -> DataFrame:
    """doc_id, n_shingles, class_key (equal for equal sets), bands."""
    a, b = how.multipliers()

    def run(batch: pa.RecordBatch):
        ids, texts = batch.column("doc_id").to_pylist(), texts_of(batch)
        for start, stop in slices(texts):
            sets = [shingles(t, how.words) for t in texts[start:stop]]
            signs = np.array([signature(s, a, b) for s in sets]).reshape(len(sets), how.bands, how.rows).astype(np.uint64)
            key = np.full(signs.shape[:2], 0, dtype=np.uint64) + np.arange(how.bands, dtype=np.uint64)
            for r in range(how.rows):
                key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + signs[:, :, r])
            yield {"doc_id": ids[start:stop], "n_shingles": [len(s) for s in sets],
                   "class_key": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                   "bands": [list(k) for k in key.view(np.int64)]}

    return over_batches(df.select("doc_id", "text"), run, "doc_id long, n_shingles long, class_key binary, bands array<long>")


# Room for any id, counted from the lowest, behind a weight inside one decimal.
_SPAN_SQL, _LOWEST_SQL = "20000000000000000000BD", "9223372036854775808BD"


def _rank(weight: str, vertex: str) -> F.Column:
    """One decimal that orders like (weight, smallest id first), so that the maximum is a hash aggregate."""
    return (F.col(weight).cast("decimal(18,0)") * F.expr(_SPAN_SQL) - (F.col(vertex) + F.expr(_LOWEST_SQL))).cast("decimal(38,0)")


def _ranked(rank: str) -> tuple[F.Column, F.Column]:
    """Weight and id back from a rank."""
    weight = F.ceil(F.col(rank) / F.expr(_SPAN_SQL)).cast("decimal(18,0)")
    return weight.cast("long"), (weight * F.expr(_SPAN_SQL) - F.col(rank) - F.expr(_LOWEST_SQL)).cast("long")


def _pivots(classes: DataFrame) -> DataFrame:
    """(id, n_shingles, pivot, weight): every class with the pivot of each bucket that it shares with others, and its weight."""
    buckets = classes.select("id", "n_shingles", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    rows = stored(buckets.join(shared, "bucket"), "shared")
    weight = rows.groupBy("id").agg(F.sum("n").alias("weight"))
    ranked = rows.select("bucket", "id", "n_shingles").join(weight, "id").withColumn("rank", _rank("weight", "id"))
    best = ranked.groupBy("bucket").agg(F.max("rank").alias("rank"))
    weight, pivot = _ranked("rank")
    best = best.select("bucket", pivot.alias("pivot"), weight.alias("weight"))
    return ranked.select("bucket", "id", "n_shingles").join(best, "bucket").select("id", "n_shingles", "pivot", "weight").distinct()


def _similar_pairs(how: Similarity):
    """For a block with sides 0 (left) and 1 (right): the verified pairs of different components, and the left one's weight."""
    a, b = how.multipliers()
    steps = how.least_matches()

    def verify(block: pd.DataFrame) -> pd.DataFrame:
        sides = []
        for side in (0, 1):
            rows = block[block["side"] == side].sort_values("id")
            sets = [shingles(t, how.words) for t in rows["text"]]
            signs = np.array([signature(s, a, b) for s in sets]).reshape(len(sets), how.hashes)
            sides.append((rows["id"].to_numpy(), rows["component"].to_numpy(), rows["weight"].to_numpy(), sets, signs))
        (ids, groups, weights, sets, signs), (ids2, groups2, _, sets2, signs2) = sides
        out = []
        for i in range(len(ids)):
            alive = np.flatnonzero((groups2 != groups[i]) & (ids2 != ids[i]))
            matches, seen = np.zeros(len(alive), dtype=np.int64), 0
            for n, least in steps:
                matches += (signs2[alive, seen:n] == signs[i, seen:n]).sum(axis=1)
                seen, go = n, matches >= least
                alive, matches = alive[go], matches[go]
            for j in alive:
                common = len(np.intersect1d(sets[i], sets2[j], assume_unique=True))
                if 100 * common >= how.percent * (len(sets[i]) + len(sets2[j]) - common):
                    out.append((ids[i], ids2[j], weights[i]))
        return pd.DataFrame(out, columns=["u", "v", "weight"], dtype="int64")

    return verify


def _written(df: DataFrame, purpose: str, *metrics: F.Column) -> tuple[DataFrame, tuple]:
    """``df`` written and read back, with aggregates that the write itself observed."""
    seen = Observation()
    named = [m.alias(f"m{i}") for i, m in enumerate(metrics)]
    out = stored(df.observe(seen, *named), purpose)
    return out, tuple(seen.get[f"m{i}"] for i in range(len(metrics)))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex of the edges (u, v); the component is its smallest id.

    Large-star links the larger neighbours of a vertex to its smallest neighbour, small-star the smaller ones and itself;
    alternated, they turn every component into a star around its smallest id."""
    down = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, state = _written(down, "edges", F.count("*"), F.sum(F.hash("u", "v").cast("long")))
    while state[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
        large = _salted(both, low, "u", "v").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = _salted(large, low, "u", "v").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).union(low)
        before = state
        edges, state = _written(small.where("u <> v").distinct(), "edges", F.count("*"), F.sum(F.hash("u", "v").cast("long")))
        if state == before:
            break
    members = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return members.union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _roots(stars: DataFrame) -> DataFrame:
    """(id, root) of every class that hangs on a pivot, from the verified pairs (u a pivot, v, weight of u).

    A pivot outranks all that it was compared with, so the highest pivots of all classes form a forest."""
    _, pivot = _ranked("rank")
    hung = stars.withColumn("rank", _rank("weight", "u")).groupBy("v").agg(F.max("rank").alias("rank")).select(F.col("v").alias("id"), pivot.alias("root"))
    hung = stored(hung, "roots")
    while True:
        above = hung.select(F.col("id").alias("root"), F.col("root").alias("above"))
        moved = hung.join(above, "root", "left")
        hung, (changed,) = _written(moved.select("id", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")),
                                    "roots", F.count_if("moved"))
        hung = hung.select("id", "root")
        if not changed:
            return hung


def _blocks(met: DataFrame, texts: DataFrame, how: Similarity) -> DataFrame:
    """Blocks of comparisons of ``met`` (pivot, id, component, weight, left, right): each left with each right of the same pivot.

    A side is cut by a hash of the id into chunks of at most about ``how.block`` shingles; a block is a pair of chunks."""
    sizes = met.groupBy("pivot").agg(*(F.ceil(F.sum(F.when(F.col(s), F.col("n_shingles")).otherwise(0)) / how.block).cast("int")
                                       .alias(f"{s}s") for s in ("left", "right")))
    rows = _salted(met, sizes, "pivot", "id").join(texts, "id")
    place = lambda s: F.pmod(F.xxhash64("id"), F.greatest(F.col(f"{s}s"), F.lit(1))).cast("int")
    every = lambda s: F.sequence(F.lit(0), F.greatest(F.col(f"{s}s"), F.lit(1)) - 1)
    one = lambda side, x, y: rows.where(F.col(side)).select(
        "pivot", "id", "component", "weight", "text", F.lit(int(side == "right")).alias("side"), x.alias("x"), y.alias("y"))
    return one("left", place("left"), F.explode(every("right"))).union(one("right", F.explode(every("left")), place("right")))


def _salted(rows: DataFrame, small: DataFrame, key: str, within: str, salts: int = 16) -> DataFrame:
    """``rows`` joined with ``small``, which has one row per key: a key that holds many rows is dealt to many tasks by another column."""
    salt = F.pmod(F.xxhash64(within), F.lit(salts))
    spread = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return rows.withColumn("_salt", salt).join(spread, [key, "_salt"]).drop("_salt")


def near_duplicates(df: DataFrame, how: Similarity = Similarity()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, links: one row per row of ``df`` (doc_id, text).

    ``component_id`` is the smallest doc_id reachable over links, ``kept`` says that it is the row's own. Texts without words
    are linked with nothing. Rows that repeat a doc_id are one document if their texts are equal sets, else each is linked
    as itself under that id. Rows without doc_id are in no component and are kept. Other columns are not read."""
    described = stored(_described(df, how), "described")
    # Equal sets have equal bands, so any row of a class has them.
    classes = stored(described.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("class_key").agg(
        F.min("doc_id").alias("id"), F.min("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")), "classes")
    # Two texts of one id are two classes of the same name, which are linked as one.
    met = stored(_pivots(classes), "met")
    # Bytes, as in the signatures: ASCII case and white space only. Rows that repeat a text are compared once.
    # The same plan at every size: without the hint a small table of ids would be broadcast, and a larger one would not.
    texts = df.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text"))
    texts = stored(texts.join(met.select("id").distinct().hint("merge"), "id").distinct(), "texts")
    verify = _similar_pairs(how)
    edge_of = lambda blocks: blocks.groupBy("pivot", "x", "y").applyInPandas(verify, "u long, v long, weight long")

    part = lambda rows, left: rows.select("pivot", "id", F.col("id").alias("component"), "n_shingles", "weight",
                                          F.lit(left).alias("left"), F.lit(not left).alias("right"))
    stars = stored(edge_of(_blocks(part(met.where("id <> pivot"), False).union(part(met.where("id = pivot"), True)), texts, how)), "links")
    roots = _roots(stars)

    label = lambda rows, key, name: rows.join(roots.select(F.col("id").alias(key), F.col("root").alias(name)), key, "left").withColumn(
        name, F.coalesce(name, key))
    apart = stored(label(label(met, "id", "component"), "pivot", "home").withColumn("left", F.col("component") != F.col("home")), "apart")
    open_pivots = apart.where("left").select("pivot").distinct()
    rest = _salted(apart, open_pivots, "pivot", "id").select("pivot", "id", "component", "n_shingles", "weight", "left",
                                                         (F.col("id") != F.col("pivot")).alias("right"))
    more = stored(edge_of(_blocks(rest, texts, how)), "links")
    links = stars.union(more).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    # Only pairs of different trees are left for the components of roots.
    between = label(label(links, "u", "a"), "v", "b").where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    joined = components(between).select(F.col("id").alias("root"), "component")
    members = roots.union(roots.select(F.col("root").alias("id"), "root").distinct())
    members = members.union(between.select(F.explode(F.array("u", "v")).alias("id")).distinct().select("id", F.col("id").alias("root"))).distinct()
    labelled = stored(members.join(joined, "root", "left").select("id", F.coalesce("component", "root").alias("label")), "members")
    found = labelled.join(labelled.groupBy("label").agg(F.min("id").alias("component")), "label").select("id", "component")
    degree = links.select("u").union(links.select("v")).groupBy("u").count().select(F.col("u").alias("id"), F.col("count").alias("found_links"))
    named = classes.select("id", "class_key").join(found, "id", "left").join(degree, "id", "left").select(
        "class_key", F.coalesce("component", "id").alias("component_id"), F.coalesce("found_links", F.lit(0)).alias("found_links"))
    usual = described.where("doc_id IS NOT NULL AND n_shingles > 0").drop("bands").join(named, "class_key")
    alone = described.where("doc_id IS NULL OR n_shingles = 0").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(0).cast("long").alias("found_links"))
    return usual.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"),
                        "found_links").unionByName(alone)


def keep_one(df: DataFrame, how: Similarity = Similarity()) -> DataFrame:
    """The rows of ``df`` with their own columns, one for each component: the first by text of its smallest doc_id."""
    kept = near_duplicates(df, how).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_kept_id")).distinct()
    own = df.select(F.struct(*df.columns).alias("row"), F.col("doc_id").alias("_kept_id"), F.col("text").alias("_text"))
    chosen = own.join(kept, "_kept_id").withColumn("_n", F.row_number().over(Window.partitionBy("_kept_id").orderBy("_text"))).where("_n = 1")
    return chosen.select("row.*").union(df.where("doc_id IS NULL"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Similarity(words=3, percent=85))
