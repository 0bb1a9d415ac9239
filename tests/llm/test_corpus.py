import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from govspark.llm import ann, mixing, near_dedup, quality_lm, queries
from govspark.runtime import local_frame
from tests.conftest import SMALL


def word_sets(rows, n):
    out = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        out[i] = frozenset(tuple(words[k:k + n]) for k in range(max(1, len(words) - n + 1))) if words else frozenset()
    return out


def linked(sets, percent):
    """Components by comparing every pair."""
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y) and find(a) != find(b):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in sets}


def test_op5_against_all_pairs(spark):
    sets = word_sets([(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()], 3)
    want = linked(sets, 85)
    rows = queries.QUERIES["op5_near_duplicates"](spark, SMALL).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows} == {(i, len(s), want[i], want[i] == i) for i, s in sets.items()}


def test_families_of_near_copies_lose_no_link(spark):
    """Copies of one text with more and more edits, and chains that only hold through their neighbours, in small blocks."""
    rng = np.random.default_rng(4)
    base, rows = [f"w{i}" for i in range(60)], []
    for i in range(90):
        words = list(base)
        for j in rng.choice(60, rng.integers(0, 6), replace=False):
            words[j] = f"e{rng.integers(1000)}"
        rows.append((i, " ".join(words)))
    for i in range(30):
        rows.append((1000 + i, " ".join(f"c{k}" for k in range(3 * i, 3 * i + 60))))
    sets = word_sets(rows, 3)
    df = local_frame(spark, rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(df, near_dedup.Similarity(words=3, percent=80, block=600)).collect()
    assert {r.doc_id: r.component_id for r in got} == linked(sets, 80)


def test_near_duplicates_of_any_rows(awkward, nothing):
    rows = near_dedup.near_duplicates(awkward("kept")).collect()
    assert len(rows) == 10
    for r in rows:
        if r.doc_id in (1, 2, 3):
            assert (r.n_shingles, r.component_id, r.kept) == (0, r.doc_id, True)
        if r.doc_id is None:
            assert r.component_id is None and r.kept
    kept = near_dedup.keep_one(awkward("kept"))
    assert kept.columns == awkward("kept").columns and Counter(r.doc_id for r in kept.collect())[4] == 1 and kept.count() == 9
    assert near_dedup.near_duplicates(nothing).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    how = near_dedup.Similarity()
    rng = np.random.default_rng(0)
    for n, least in how.least_matches():
        assert (rng.binomial(n, how.percent / 100, 100_000) < least).mean() <= 1e-4
    assert (1 - (how.percent / 100) ** how.rows) ** how.bands <= how.miss


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (5, 6), (7, 7), (6, 10), (10, 11), (11, 12), (12, 13), (13, 14), (14, 15)]
    got = {r.id: r.component for r in near_dedup.components(local_frame(spark, edges, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, **{i: 5 for i in (5, 6, 10, 11, 12, 13, 14, 15)}}


def fill(sizes):
    """Targets by repeated sharing."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        free = {s: weight[s] for s in sizes if s not in full}
        target = {s: 3 * sizes[s] if s in full else rest * weight[s] / sum(free.values()) for s in sizes}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1000, "b": 1, "c": 2, None: 5}, {"a": 0, "b": 7}, {"é": 3, "z": 900, None: 1, "Z": 30, "b": 2}])
def test_targets(spark, sizes):
    rows = [("" if s is None else "s" + s, s, n) for s, n in sizes.items()]
    got = mixing.targets(local_frame(spark, rows, "source_key string, source string, source_size long")).collect()
    want = fill(sizes)
    assert {r.source_key: pytest.approx(r.target) for r in got} == {("" if s is None else "s" + s): t for s, t in want.items()}


def test_op10_meets_targets(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = queries.QUERIES["op10_mixing"](spark, SMALL).collect()
    assert [r.doc_id for r in rows] == [r.doc_id for r in queries.QUERIES["op10_mixing"](spark, SMALL).collect()]
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) for i, d in docs.items()}
    by = defaultdict(int)
    for i, d in docs.items():
        by[d.source] += size[i]
    want, taken = fill(dict(by)), defaultdict(int)
    for r in rows:
        source = docs[r.doc_id].source
        assert r["size"] == size[r.doc_id] and r.source_size == by[source] and r.target == pytest.approx(want[source]) and r.taken <= 3 * r["size"]
        taken[source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in by)


def test_positions_invert_the_demand(spark):
    rows = [(i, " ".join("w" * 5), s) for i, s in enumerate("aaaaabbbbbccccc" * 40)]
    plan = mixing.plan(local_frame(spark, rows, "doc_id long, text string, source string"), weights=(1, 1, 1))
    times = defaultdict(list)
    for r in plan.collect():
        times[r.row.source] += r.positions
    for k, s in enumerate("abc"):
        values, t = mixing.SCHEDULES[k], sorted(times[s])
        area = lambda x: np.trapezoid(np.interp(np.linspace(0, x, 2001), np.linspace(0, 1, len(values)), values), np.linspace(0, x, 2001))
        for x in (0.25, 0.5, 0.9):
            assert np.searchsorted(t, x) / len(t) == pytest.approx(area(x) / area(1), abs=0.01)


def test_mixing_of_any_rows(awkward, nothing):
    docs = awkward("size").withColumnRenamed("size", "target")
    rows = mixing.plan(docs).collect()
    assert len(rows) == 10 and all(r.taken == 0 and r.positions == [] for r in rows if r["size"] == 0)
    assert mixing.training_order(docs).columns == docs.columns
    assert mixing.plan(nothing).count() == 0 and mixing.training_order(nothing).count() == 0


def nearest(ids, vectors, asked, k=20):
    for q in asked:
        scores = vectors @ vectors[ids.index(q)]
        order = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-scores[i], ids[i]))[:k]
        yield q, [ids[i] for i in order], [scores[i] for i in order]


def test_op4_recall(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    ids, vectors = [r.vec_id for r in rows], np.array([r.embedding for r in rows], dtype=float)
    got = defaultdict(list)
    for r in sorted(queries.QUERIES["op4_nearest_neighbours"](spark, SMALL).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append(r)
    hits = total = 0
    for q, want, _ in nearest(ids, vectors, [i for i in ids if i % 20 == 0]):
        hits, total = hits + len({r.vec_id for r in got[q]} & set(want)), total + len(want)
        assert [r.rank for r in got[q]] == list(range(1, 21))
        assert all(r.score == pytest.approx(float(vectors[ids.index(r.vec_id)] @ vectors[ids.index(q)]), abs=1e-12) for r in got[q])
    assert hits / total >= 0.9


def test_neighbours_of_any_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]),
            (8, [1.0, None]), (9, []), (10, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (3, [0.0, 2.0]), (20, [0.5, 0.5]), (40, None)]
    df = local_frame(spark, rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.neighbours(df, df.where("vec_id % 20 = 0"), k=3).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert dict(got) == {0: [(1, 1.0), (2, 1.0), (20, 0.5)], 20: [(3, 1.0), (0, 0.5), (1, 0.5)]}
    assert ann.neighbours(df.where("false"), df.where("false")).count() == 0


def test_chi_square_quantile():
    for p, degrees, want in ((0.95, 8, 15.507), (0.5, 2, 1.386), (0.99, 1, 6.635)):
        assert ann.chi_square_quantile(p, degrees) == pytest.approx(want, abs=1e-3)


def kneser_ney(texts):
    """Perplexity function of the model by its recursive definition."""
    n = quality_lm.ORDER
    grams = {n: Counter(t[i:i + n] for t in texts for i in range(len(t) - n + 1))}
    for k in range(n - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    discounts, contexts = {}, {}
    for k, c in grams.items():
        m = [float(sum(v == i for v in c.values())) for i in range(1, 5)]
        y = m[0] / (m[0] + 2 * m[1]) if m[0] else 0.5
        discounts[k] = [min(max(i - (i + 1) * y * m[i] / m[i - 1], 0.05), i - 0.05) if m[i - 1] and m[i] else min(y, i - 0.05) for i in (1, 2, 3)]
        contexts[k] = defaultdict(lambda: [0.0, 0.0])
        for g, v in c.items():
            contexts[k][g[:-1]][0] += v
            contexts[k][g[:-1]][1] += discounts[k][min(v, 3) - 1]
    letters = len({t[i + n - 1] for t in texts for i in range(len(t) - n + 1)})

    def p(g):
        if not g:
            return 1 / (letters + 1)
        k, v = len(g), grams[len(g)].get(g, 0)
        if g[:-1] not in contexts[k]:
            return p(g[1:])
        total, left = contexts[k][g[:-1]]
        return (v - discounts[k][min(v, 3) - 1] if v else 0) / total + left / total * p(g[1:])

    return lambda t: math.exp(-sum(math.log(p(t[i:i + n])) for i in range(len(t) - n + 1)) / (len(t) - n + 1))


def test_perplexities_against_the_definition(spark, awkward):
    rows = [(i, t, "en", 1) for i, t in enumerate(["the cat sat on the mat", "the dog ran to the cat and the mat", "a dog, a cat; a mat", "on and on and on"] * 3)]
    docs = local_frame(spark, rows, "doc_id long, text string, lang string, kept long").unionByName(
        awkward("kept").selectExpr("doc_id + 100 AS doc_id", "text", "source AS lang", "kept"))
    labels = local_frame(spark, [(i, 1) for i in range(12)] + [(101, 0), (None, 1)], "doc_id long, quality int")
    got = quality_lm.score(docs, labels).collect()
    assert len(got) == 22
    from pyspark.sql import functions as F
    held = {r.i for r in spark.range(12).select(F.col("id").alias("i"), (F.pmod(F.xxhash64("id"), F.lit(quality_lm.HELD_OUT)) == 0).alias("h")).collect() if r.h}
    model = kneser_ney([quality_lm.plain(t) for i, t, _, _ in rows if i not in held])
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        if r.doc_id is not None:
            assert r.perplexity == pytest.approx(model(quality_lm.plain(texts[r.doc_id])), rel=1e-4)


def test_quality_model_without_rows(spark, nothing):
    labels = local_frame(spark, [], "doc_id long, quality int")
    assert quality_lm.score(nothing, labels).count() == 0
    docs = local_frame(spark, [(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert all(r.kept for r in quality_lm.score(docs, labels).collect())


def test_quality_model_tells_junk(spark):
    rows = queries.QUERIES["op2_quality_lm"](spark, "/root/testdata/sf0.01")
    both = rows.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    share = lambda q: sum(r.kept for r in both if r.quality == q) / sum(r.quality == q for r in both)
    assert share(1) > 0.97 and share(0) < 0.4


def test_stages_do_what_they_say(spark):
    """The stages one by one on the small tables: each against its own definition on the rows it was given."""
    from govspark.llm.common import stored, table
    docs = table(spark, SMALL, "documents")
    columns = docs.columns
    seen = [{r.doc_id: r.text for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SMALL), name)
        assert docs.columns == columns
        rows = docs.collect()
        seen.append({r.doc_id: r.text for r in rows})
        assert all(seen[-2][i] == t for i, t in seen[-1].items())
    from govspark.llm.repetition import profile
    kept = {r.doc_id for r in profile(table(spark, SMALL, "documents")).where("kept").collect()}
    assert set(seen[1]) == kept and set(seen[2]) <= kept
    want = linked(word_sets(seen[2].items(), 5), 80)
    assert set(seen[3]) == {i for i, c in want.items() if i == c}
    copies = Counter(r.doc_id for r in rows)
    assert set(copies) <= set(seen[3]) and max(copies.values()) <= 3
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert Counter(r.doc_id for r in last) == copies and all(r.round_trip_ok for r in last)


def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "near_dedup", "mixing", "byte_bpe"]
