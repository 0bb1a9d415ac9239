from pathlib import Path

from pyspark.sql import functions as F

from govspark.llm import quality_lm
from govspark.llm.common import stored
from tests.conftest import SMALL


def test_stored_requests_take_little_of_a_gram(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").coalesce(1)
    asked = stored(quality_lm.requests(spark.table(quality_lm.batches(docs))), "requests", "zstd")
    n = asked.select(F.sum(F.size("grams"))).first()[0]
    size = sum(Path(p.removeprefix("file://").removeprefix("file:")).stat().st_size for p in asked.inputFiles())
    assert n > 1000 and size < 3 * n  # a row per gram with its place took more than four bytes


def test_requests_of_several_rows_give_the_same_scores(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    rows = lambda: sorted(tuple(r) for r in quality_lm.score(docs, labels).select("doc_id", "n_chars", F.round("perplexity", 6), "kept").collect())
    whole = rows()
    monkeypatch.setattr(quality_lm, "ROW_GRAMS", 700)
    assert rows() == whole and len(whole) == docs.count()
