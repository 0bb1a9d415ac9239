"""Every stage of the pipeline on awkward rows and on none: what stays, in which columns."""

from collections import Counter

import pytest

import corpus_pipeline
from tests.conftest import SMALL

STAGES = dict(corpus_pipeline.STAGES)


def ids(df):
    return Counter(r.doc_id for r in df.collect())


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
@pytest.mark.parametrize("extra", ["size", "score", "row", "kept"])
def test_columns_stay_and_nothing_is_made_up(spark, awkward, name, extra):
    if name == "toxicity" and extra != "score":
        pytest.skip("one training is enough")
    docs = awkward(extra)
    out = STAGES[name](spark, docs, SMALL)
    assert out.columns == docs.columns
    before, after = ids(docs), ids(out)
    assert set(after) <= set(before) and (name == "mixing" or all(after[i] <= before[i] for i in after))
    want = {
        "quality_rules": lambda: after[1] == after[2] == after[3] == 0 and after[7] == 0,  # no words, one word over and over
        "toxicity": lambda: after == before,
        "near_dedup": lambda: after[4] == 1 and after[None] == 1 and after[1] == after[2] == 1,
        "mixing": lambda: after[1] == after[2] == after[3] == 0,
    }[name]
    assert want()


def test_encoding_gives_a_row_for_each(spark, awkward):
    rows = STAGES["byte_bpe"](spark, awkward("n_tokens"), SMALL).collect()
    assert Counter(r.doc_id for r in rows) == ids(awkward("n_tokens"))
    assert all(r.n_tokens == 0 for r in rows if r.doc_id in (1, 2)) and all(r.n_tokens > 0 for r in rows if r.doc_id in (4, 6, 7, 8))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_no_rows(spark, nothing, name):
    assert STAGES[name](spark, nothing, SMALL).count() == 0
