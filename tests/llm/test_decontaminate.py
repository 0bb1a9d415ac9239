import random
import re
from dataclasses import replace

import pytest

from govspark.llm.decontaminate import Contamination, contamination, decontaminated
from govspark.runtime import local_frame

DOC, ITEM = "doc_id long, text string", "item_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def plain(docs, items, n=10):
    """(doc_id, n_words, n_hit, item ids) by looking at every place of every text."""
    windows = {}
    for i, text in items:
        w = words(text)
        for k in range(len(w) - min(n, len(w)) + 1 if w else 0):
            windows.setdefault(tuple(w[k:k + n]), set()).add(i)
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for k in range(len(w)):
            for size in range(1, n + 1):
                ids = windows.get(tuple(w[k:k + size])) if k + size <= len(w) else None
                if ids:
                    hit.update(range(k, k + size))
                    found |= ids
        out.append((i, len(w), len(hit), tuple(sorted(str(x) for x in found if x is not None))))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r.items)) for r in df.collect()), key=repr)


def rows(seed, n_docs=60, n_items=25):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "é", "字字", "x1", "Q"]
    sentence = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", ",", "-", "\n"]) for _ in range(n))
    items = [(i, sentence(rng.choice([1, 3, 12, 14, 18]))) for i in range(n_items)]
    docs = []
    for i in range(n_docs):
        parts = [sentence(rng.randrange(0, 30))]
        for _ in range(rng.randrange(0, 4)):
            parts += [rng.choice(items)[1], sentence(rng.randrange(0, 6))]
        docs.append((i, " ".join(parts)))
    return docs, items


@pytest.mark.parametrize("how", [Contamination(), Contamination(words=4), Contamination(block_bytes=700), Contamination(entry_chars=12)])
def test_against_every_place(spark, how):
    docs, items = rows(3)
    found = contamination(local_frame(spark, docs, DOC).repartition(3), local_frame(spark, items, ITEM), how)
    assert got(found) == plain(docs, items, how.words)


def test_awkward_rows(spark, awkward, nothing):
    docs = awkward("n_hit")
    items = local_frame(spark, [(1, "two three four"), (1, "two three four"), (2, None), (3, " - "), (None, "SIX"), (5, "la " * 40), (6, "naïve")],
                        ITEM).selectExpr("item_id", "text", "1 AS hits", "2 AS key")
    plain_docs = [(r.doc_id, r.text) for r in docs.collect()]
    plain_items = [(r.item_id, r.text) for r in items.collect()]
    found = contamination(docs, items)
    assert got(found) == plain(plain_docs, plain_items) and len(plain_docs) == found.count()
    empty = items.limit(0)
    assert {r.n_hit for r in contamination(docs, empty).collect()} == {0}
    assert contamination(nothing, items).count() == 0 and contamination(nothing, empty).count() == 0
    assert decontaminated(docs, empty).count() == len(plain_docs)
    kept = decontaminated(docs, items)
    assert kept.columns == docs.columns
    assert kept.count() == sum(1 for r in plain(plain_docs, plain_items) if r[2] == 0)
    cut = decontaminated(docs, items, remove="spans")
    assert cut.columns == docs.columns and cut.count() == len(plain_docs)


def test_spans_leave_the_rest_as_written(spark):
    items = local_frame(spark, [(1, "the quick brown fox"), (2, "fox jumps")], ITEM)
    docs = local_frame(spark, [(1, "  See: The Quick-brown FOX jumps! Over it."), (2, "The quick brown fox"), (3, None), (4, "Fox: jumps fox jumps;")], DOC)
    cut = {r.doc_id: r.text for r in decontaminated(docs, items, remove="spans").collect()}
    assert cut == {1: "  See! Over it.", 2: "", 3: None, 4: ";"}
    with pytest.raises(ValueError):
        decontaminated(docs, items, remove="all")


def test_spans_leave_no_whole_test_window(spark):
    docs, items = rows(8)
    how = Contamination(words=6)
    cut = decontaminated(local_frame(spark, docs, DOC), local_frame(spark, items, ITEM), how, "spans").collect()
    lengths = {d: n - h for d, n, h, _ in plain(docs, items, how.words)}
    assert {r.doc_id: len(words(r.text)) for r in cut} == lengths


def test_one_long_text_and_many_copies(spark):
    """A text of 200,000 words of which one window in a hundred is a test item, and one passage in 3,000 equal rows."""
    passage = " ".join(f"p{i}" for i in range(12))
    long = " ".join(passage if i % 100 == 0 else f"w{i}" for i in range(200_000))
    docs = [(0, long)] + [(1, f"start {passage} end")] * 3000
    found = contamination(local_frame(spark, docs, DOC).repartition(4), local_frame(spark, [(7, passage)], ITEM))
    counts = found.groupBy("doc_id", "n_words", "n_hit", "n_items").count().collect()
    assert {tuple(r) for r in counts} == {(0, 198_000 + 24_000, 24_000, 1, 1), (1, 14, 12, 1, 3000)}


def test_main_path_is_built_in(spark):
    """No Python node in any plan of the operator."""
    docs, items = rows(1, 5, 5)
    for df in (contamination(local_frame(spark, docs, DOC), local_frame(spark, items, ITEM)),
               decontaminated(local_frame(spark, docs, DOC), local_frame(spark, items, ITEM), remove="spans")):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan
