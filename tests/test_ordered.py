"""Sliced computations equal plain windows, however the rows are dealt; a burst of one key is dealt evenly."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from govspark.operators import ordered
from govspark.runtime import local_frame


@pytest.fixture(params=[1, 4, 13])
def hot(request, spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(7)
    keys = ["hot"] * 6 + ["a", "b", None]
    return local_frame(spark, [(rnd.choice(keys), rnd.randint(0, 500), i, rnd.randint(0, 9)) for i in range(300)], "k string, t long, id long, v long")


def same(a, b):
    order = sorted(a.columns)
    got = lambda d: sorted((tuple(r) for r in d.select(*order).collect()), key=str)
    assert got(a) == got(b)


@pytest.mark.parametrize("keys", [["k"], []])
def test_prior_sums(rows, hot, keys):
    w = W.partitionBy(*keys).orderBy("t", "id").rowsBetween(W.unboundedPreceding, -1)
    same(ordered.prior_sums(rows, keys, ["t", "id"], {"s": F.col("v"), "n": F.lit(1)}),
         rows.withColumns({"s": F.coalesce(F.sum("v").over(w), F.lit(0)), "n": F.count(F.lit(1)).over(w)}))


@pytest.mark.parametrize("keys", [["k"], []])
def test_previous_row(rows, hot, keys):
    w = W.partitionBy(*keys).orderBy("t", "id")
    same(ordered.previous_row(rows, keys, ["t", "id"], {"pv": "v", "pid": "id"}),
         rows.withColumns({"pv": F.lag("v").over(w), "pid": F.lag("id").over(w)}))


def test_trailing_count(rows, hot):
    w = W.partitionBy("k").orderBy("t").rangeBetween(-20, 0)
    same(ordered.trailing_count(rows, ["k"], "t", 20, "n"), rows.withColumn("n", F.count(F.lit(1)).over(w)))


@pytest.mark.parametrize("n", [1, 5, 40])
def test_nth_row(rows, n):
    w = W.partitionBy("k").orderBy("t", "id")
    same(ordered.nth_row(rows, ["k"], ["t", "id"], n),
         rows.withColumn("r", F.row_number().over(w)).filter(F.col("r") == n).select("k", "t", "id"))


def test_running_max_and_as_of(spark, rows, hot):
    w = W.partitionBy("k").orderBy("t", "id").rowsBetween(W.unboundedPreceding, 0)
    odd = F.when(F.col("v") % 2 == 1, F.col("v"))
    same(ordered.running_max(rows, ["k"], ["t", "id"], {"m": odd}), rows.withColumn("m", F.max(odd).over(w)))
    marks = [("hot", t, t * 3 % 50) for t in range(0, 500, 40)] + [("a", 100, 1)]
    found = ordered.as_of(rows, local_frame(spark, marks, "k string, t long, e long"), ["k"], "t", "e", "best")
    plain = lambda r: max((e for k, t, e in marks if k == r.k and t <= r.t), default=None)
    got = found.collect()
    assert len(got) == 300 and all(r.best == plain(r) for r in got) and found.columns == ["k", "t", "id", "v", "best"]


def test_a_burst_is_dealt_evenly(spark, hot):
    """All rows of one key at one time: no slice holds more than its share of them."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    burst = spark.range(20_000).selectExpr("'k' AS k", "7L AS t", "id", "1L AS v")
    sizes = [r["count"] for r in ordered._tag(burst, ["k"], ["t", "id"]).groupBy(ordered.SLICE).count().collect()]
    assert len(sizes) == parts and max(sizes) <= 2.5 * 20_000 / parts
    total = ordered.prior_sums(burst, ["k"], ["t", "id"], {"s": F.col("v")})
    assert total.where("s <> id").count() == 0
    assert ordered.trailing_count(burst, ["k"], "t", 20, "n").where("n <> 20000").count() == 0
    assert [tuple(r) for r in ordered.nth_row(burst, ["k"], ["t", "id"], 12_345).collect()] == [("k", 7, 12_344)]
