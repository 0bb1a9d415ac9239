"""The gate: what comes in time and what is late together are the input, batch ids are written once, streams behind it drop nothing."""

import json

import pytest
from pyspark.sql import functions as F

from govspark.plans import fixtures, registry, streams
from govspark.runtime import local_frame
from govspark.sources import audit_log
from govspark.streaming import replay, stateful, windows
from tests.conftest import SMALL

HOUR = 3_600_000_000
KEYS = ["budget_stream", "lockout_stream", "anomaly_stream", "counters_stream", "sliding_counters_stream", "session_activity", "alerts_stream",
        "audit_dedup_stream"]


@pytest.fixture(scope="module")
def gated(spark, tmp_path_factory):
    """The events in files that each cover all their time, one a micro-batch, through a gate that waits two days."""
    root = tmp_path_factory.mktemp("gated")
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    for i in range(4):
        events.filter(f"event_id % 4 = {i}").coalesce(1).write.mode("append").parquet(str(root / "raw"))
    gate = replay.Gate(events.schema, 48 * HOUR, spark)
    gate.drain(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(root / "raw")))
    tagged = gate.tagged().cache()
    for i in range(4):  # the rows that came in time, in the order of their batches
        tagged.where(f"NOT late AND batch = {i}").select(events.columns).coalesce(1).write.mode("append").parquet(str(root / "timely" / "events.parquet"))
    for t in ("customer", "orders"):
        spark.read.parquet(f"{SMALL}/{t}.parquet").write.parquet(str(root / "timely" / f"{t}.parquet"))
    return gate, tagged, str(root / "timely")


def test_late_and_timely_rows_are_the_input(spark, gated):
    gate, tagged, _ = gated
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    assert 0 < gate.late().count() < events.count() and tagged.count() == events.count()
    assert tagged.select(events.columns).exceptAll(events).isEmpty()
    micros = [(r.batch, r.late, r.t) for r in tagged.select("batch", "late", F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).collect()]
    for batch, late, t in micros:
        before = [u for b, _, u in micros if b < batch]
        assert late == (bool(before) and t < max(before) - gate.delay_us)


@pytest.mark.parametrize("key", KEYS)
def test_streams_behind_the_gate_drop_nothing(spark, gated, key, monkeypatch):
    """One file a micro-batch in the order of arrival, with the gate's delay: the result is that of all timely rows."""
    gate, _, timely = gated
    query = registry.load()[key]
    rows = lambda: sorted(map(str, query(spark, timely).collect()))
    whole = rows()
    monkeypatch.setattr(fixtures, "STREAM_OPTIONS", {"maxFilesPerTrigger": "1"})
    seconds = gate.delay_us // 1_000_000 + 2

    def unordered(df, path, ts="ts", slice_rows=0):
        for i in range(4):
            df.where(f"event_id % 4 = {i}").coalesce(1).write.mode("append").parquet(path)
        return (seconds - 2) * 1_000_000

    monkeypatch.setattr(streams.replay, "ordered_copy", unordered)
    assert whole and rows() == whole


def test_a_batch_is_written_once(spark):
    schema = "id long, ts timestamp"
    at = lambda *seconds: local_frame(spark, [(i, s) for i, s in enumerate(seconds)], "id long, s long").selectExpr("id", "timestamp_seconds(s) AS ts")
    gate = replay.Gate(at().schema, 10_000_000, spark)
    gate.write(at(100, 200), 0)
    gate.write(at(150, 195, 190, 300), 1)
    want = sorted(map(tuple, gate.tagged().where("batch >= 0").select("batch", "id", "late").collect()))
    assert want == [(0, 0, False), (0, 1, False), (1, 0, True), (1, 1, False), (1, 2, False), (1, 3, False)]
    gate.write(at(150, 195, 190, 300), 1)  # again after its mark was written
    spark._jvm.org.apache.hadoop.fs.Path(f"{gate.root}/marks/batch=1").getFileSystem(spark._jsc.hadoopConfiguration()).delete(
        spark._jvm.org.apache.hadoop.fs.Path(f"{gate.root}/marks/batch=1"), True)
    gate.write(at(150, 195, 190, 300), 1)  # and after a loss between rows and mark
    assert sorted(map(tuple, gate.tagged().where("batch >= 0").select("batch", "id", "late").collect())) == want
    gate.write(local_frame(spark, [(9, None)], "id long, s long").selectExpr("id", "timestamp_seconds(s) AS ts"), 2)
    gate.write(at(289, 290), 3)
    assert {(r.batch, r.id): r.late for r in gate.tagged().where("batch >= 2").collect()} == {(2, 9): False, (3, 0): True, (3, 1): False}


def test_a_sink_replaces_a_batch_that_comes_again(spark, tmp_path):
    write = audit_log.file_sink(str(tmp_path / "out"))
    audit_log.register_sink("files", write)
    try:
        for batch in (0, 1, 1):
            audit_log.fan_out(spark.createDataFrame([(batch,)], "id long"), batch)
    finally:
        audit_log.unregister_sink("files")
    assert sorted(json.loads(r.value)["id"] for r in spark.read.text(f"{tmp_path}/out/batch=*").collect()) == [0, 1]


def test_slices_follow_each_other_in_time(spark, tmp_path):
    """Several slices: later files hold later times only, and the delay is that of one slice."""
    events = spark.read.parquet(f"{SMALL}/events.parquet").repartition(5)
    span = events.agg((F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))).alias("s")).first().s
    widest = replay.ordered_copy(events, str(tmp_path / "o"), slice_rows=events.count() // 6)
    assert 0 < widest < span / 3
    copy = spark.read.parquet(str(tmp_path / "o"))
    assert copy.count() == events.count() and copy.exceptAll(events).isEmpty()
    files = copy.select("ts", F.col("_metadata.file_modification_time").alias("at")).groupBy("at").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).orderBy("at").collect()
    assert len(files) >= 6 and all((y.a - x.b).total_seconds() * 1_000_000 >= -widest for x, y in zip(files, files[1:]))


def test_one_key_of_a_million_rows_waits_in_bounded_state(spark, tmp_path):
    """A user with 10**6 rows: what waits is the rows of two slices at most, and the outcome is that of the batch form."""
    n, slices = 1_000_000, 10
    log = spark.range(n).selectExpr("id AS audit_id", "'u' AS user_name", "1704067200000000 + id * 100000 AS ts_us", "id % 5 AS cost_cents",
                                    "timestamp_micros(1704067200000000 + id * 100000) AS ts")
    widest = replay.ordered_copy(log, str(tmp_path / "in"), slice_rows=n // slices)
    end = spark.createDataFrame([(-1, "end", 4102444800000000, 0)], "audit_id long, user_name string, ts_us long, cost_cents long")
    end.withColumn("ts", F.timestamp_micros("ts_us")).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    budgets = spark.createDataFrame([("u", 40_000, 3_000)], "user_name string, daily_cents long, hourly_cents long")
    stream = stateful.budget_stream(source.drop("ts"), budgets, 1, 1, f"{widest // 1_000_000 + 2} seconds")
    held = []
    q = (stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    for p in q.recentProgress:
        held += [s.numRowsTotal for s in p.stateOperators]
    assert len(held) >= slices / 2 and max(held) <= 60  # packed parts of at most 10,000 rows: those of a few slices of ten, whatever has gone by
    from govspark.operators import cost
    got = spark.read.parquet(str(tmp_path / "out")).where("audit_id >= 0").groupBy("outcome").count()
    want = cost.budget_decisions(log.select("audit_id", "user_name", "ts_us", "cost_cents"), budgets, 1, 1).groupBy("outcome").count()
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
