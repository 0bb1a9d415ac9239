"""The audit log as JSON lines: reading, writing, user sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govspark import schemas


# Timestamps keep their microseconds and are written in UTC.
TIMESTAMPS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timeZone": "UTC"}


def _clean(raw: DataFrame) -> DataFrame:
    """Drop rows without user, sql or decision; default the rest."""
    required = (F.coalesce("user", F.lit("")) != "") & (F.coalesce("sql", F.lit("")) != "") & (
        F.coalesce("decision", F.lit("")) != "")
    return (raw.filter(required)
            .withColumn("database", F.coalesce(F.nullif("database", F.lit("")), F.lit("default")))
            .withColumn("decision", F.when(F.upper("decision").isin(schemas.DECISIONS), F.upper("decision")).otherwise("BLOCK"))
            .withColumn("statement_type", F.when(F.upper("statement_type").isin(schemas.STATEMENT_TYPES), F.upper("statement_type")).otherwise("UNKNOWN")))


def read_audit_log(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Batch read. Lines that are not JSON fail the required-field test and disappear with it."""
    out = _clean(spark.read.schema(schemas.AUDIT).json(path))
    return out if limit is None else out.limit(limit)


def stream_audit_log(spark: SparkSession, path: str, max_bytes: int = 256 << 20) -> DataFrame:
    """The same as a stream of newly arriving files; ``max_bytes`` bounds a micro-batch."""
    return _clean(spark.readStream.schema(schemas.AUDIT).option("maxBytesPerTrigger", max_bytes).json(path))


def write_audit_log(log: DataFrame, path: str, max_records: int = 1_000_000, mode: str = "append",
                    tasks_per_day: int | None = None) -> None:
    """JSON lines partitioned by UTC day; NULL fields are left out, files roll at ``max_records``.

    By default rows are not shuffled and every task writes the days it holds, which suits a log in time
    order. ``tasks_per_day`` gathers each day into that many tasks instead, so that a log in any other
    order does not end in one small file per task and day.
    """
    dated = log.withColumn("date", F.to_date("ts"))
    if tasks_per_day:
        dated = dated.repartition("date", F.pmod(F.hash("audit_id"), F.lit(tasks_per_day)))
    (dated.write.mode(mode).partitionBy("date")
     .options(**TIMESTAMPS, maxRecordsPerFile=max_records, ignoreNullFields=True).json(path))


def write_audit_stream(log: DataFrame, path: str, checkpoint: str):
    return (log.withColumn("date", F.to_date("ts")).writeStream.partitionBy("date").format("json").options(**TIMESTAMPS)
            .option("path", path).option("checkpointLocation", checkpoint).outputMode("append"))


_SINKS: dict[str, Callable[[DataFrame, int], None]] = {}


def register_sink(name: str, write: Callable[[DataFrame, int], None]) -> None:
    """Add a user sink: ``write(frame, batch_id)`` gets a frame with one JSON text column ``value``. A batch that was lost on
    the way comes again under the same id, which a sink must use to write it once; ``file_sink`` does."""
    _SINKS[name] = write


def unregister_sink(name: str) -> None:
    _SINKS.pop(name, None)


def file_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each micro-batch below its id, so that a batch tried again replaces itself."""
    return lambda lines, batch_id: lines.write.mode("overwrite").text(f"{path}/batch={batch_id}")


def fan_out(batch: DataFrame, batch_id: int) -> None:
    """Hand a micro-batch to every registered sink (use as ``foreachBatch``)."""
    lines = batch.select(F.to_json(F.struct("*"), {**TIMESTAMPS, "ignoreNullFields": "true"}).alias("value")).persist()
    try:
        for write in _SINKS.values():
            write(lines, batch_id)
    finally:
        lines.unpersist()
