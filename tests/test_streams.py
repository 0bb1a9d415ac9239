"""Streams over tables of many files: results do not depend on how the rows are cut into files and micro-batches."""

import pytest
from pyspark.sql import functions as F

from govspark.plans import fixtures, registry, streams
from govspark.streaming import stateful, windows
from tests.conftest import SMALL

KEYS = ["budget_stream", "lockout_stream", "anomaly_stream", "counters_stream", "sliding_counters_stream", "session_activity", "alerts_stream",
        "audit_dedup_stream", "sql_firewall_stream", "register_sink"]


@pytest.fixture(scope="module")
def cut(spark, tmp_path_factory):
    """The events in four files, each a stretch of time: one micro-batch after the other."""
    root = tmp_path_factory.mktemp("cut")
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    for i in range(4):
        events.filter(f"event_id * 4 div {events.count()} = {i}").coalesce(1).write.mode("append").parquet(str(root / "events.parquet"))
    for t in ("customer", "orders"):
        spark.read.parquet(f"{SMALL}/{t}.parquet").write.parquet(str(root / f"{t}.parquet"))
    return str(root)


@pytest.mark.parametrize("key", KEYS)
def test_a_table_of_several_files(spark, cut, key, monkeypatch):
    query = registry.load()[key]
    rows = lambda d: sorted(map(str, query(spark, d).collect()))
    whole = rows(SMALL)
    monkeypatch.setattr(fixtures, "STREAM_OPTIONS", {"maxFilesPerTrigger": "1"})
    assert whole and rows(cut) == whole


@pytest.fixture(scope="module")
def interleaved(spark, tmp_path_factory):
    """The events in four files that all cover the whole time."""
    root = tmp_path_factory.mktemp("mixed")
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    for i in range(4):
        events.filter(f"event_id % 4 = {i}").coalesce(1).write.mode("append").parquet(str(root / "events.parquet"))
    return str(root)


def _budget(delay):
    return lambda log: stateful.budget_stream(log.select("audit_id", "user_name", "ts_us", "cost_cents"),
                                              log.sparkSession.createDataFrame([], "user_name string, daily_cents long, hourly_cents long"), 6000, 3000, delay)


def test_files_out_of_order(spark, interleaved, monkeypatch):
    monkeypatch.setattr(fixtures, "STREAM_OPTIONS", {"maxFilesPerTrigger": "1"})
    result = lambda d, delay: streams._run(spark, d, "budget", _budget(delay))
    want = {tuple(r) for r in result(SMALL, "1 day").collect()}
    log = fixtures.view(spark, interleaved, "audit")
    # A delay that covers the disorder loses nothing and changes nothing.
    patient = result(interleaved, "3650 days")
    assert {tuple(r) for r in patient.collect()} == want and windows.late(log, patient).count() == 0
    # A shorter one leaves late rows, all of them listed.
    hasty = result(interleaved, "1 hour").cache()
    late = windows.late(log, hasty)
    assert late.count() > 0 and hasty.count() + late.count() == log.count() == hasty.select("audit_id").union(late.select("audit_id")).distinct().count()
    assert hasty.groupBy("outcome").agg(F.count("*")).count() >= 1


def test_keys_share_their_calls_to_the_state_store(spark, tmp_path):
    """3,000 users: state has rows by shard, not by user, and a null of one user leaves the ids of the others whole."""
    first = (1 << 60) + 1
    log = spark.range(3000).selectExpr(f"id + {first} AS audit_id", "concat('u', id) AS user_name", "1704067200000000 + id * 1000000 AS ts_us",
                                       "CASE WHEN id % 100 > 0 THEN 5L END AS cost_cents")
    log.coalesce(2).write.parquet(str(tmp_path / "in"))
    end = spark.createDataFrame([(None, None, 4102444800000000, 0)], "audit_id long, user_name string, ts_us long, cost_cents long")
    end.write.mode("append").parquet(str(tmp_path / "in"))
    none = spark.createDataFrame([], "user_name string, daily_cents long, hourly_cents long")
    stream = stateful.budget_stream(spark.readStream.schema(log.schema).parquet(str(tmp_path / "in")), none, 10, 10, "1 day")
    q = (stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    held = [s.numRowsTotal for p in q.recentProgress for s in p.stateOperators]
    assert 0 < max(held) <= 4 * stateful.SHARDS < 3000
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).where("audit_id IS NOT NULL").collect()}
    assert got == {(first + i, f"u{i}", "admitted") for i in range(3000)}
