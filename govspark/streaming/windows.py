"""Watermarked windows, sessions and de-duplication, and the helper that runs a stream to completion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govspark.runtime import shared_dir


def counters(log: DataFrame, delay: str = "1 minute", width: str = "2 seconds", slide: str | None = None) -> DataFrame:
    """Request totals per event-time window; works on a stream (append mode) and on a batch."""
    if log.isStreaming:
        log = log.withWatermark("ts", delay)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return log.groupBy(w).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col("decision") == "BLOCK").alias("blocked"),
        F.count_if("rate_limited").alias("rate_limited"), F.count_if(F.col("error_code") != "NONE").alias("errors"),
    ).select(F.unix_micros("window.start").alias("window_us"), "requests", "blocked", "rate_limited", "errors")


def session_activity(log: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of activity per user, closed by a gap without events.

    Sessions are merged inside each input partition before the shuffle, so a busy user moves as
    sessions, not as rows.
    """
    log.sparkSession.conf.set("spark.sql.sessionWindow.merge.sessions.in.local.partition", "true")
    if log.isStreaming:
        log = log.withWatermark("ts", delay)
    return log.groupBy("user_name", F.session_window("ts", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("events")).select(
        "user_name", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "events")


def dedup(log: DataFrame, delay: str = "1 day", key: str = "audit_id") -> DataFrame:
    """Drop re-delivered rows: the same id within ``delay`` of event time."""
    return log.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def drain(stream: DataFrame, purpose: str, finish: Callable[[], None] | None = None) -> DataFrame:
    """Run a stream over all available input and return what it wrote.

    With ``finish`` the input then ends: it is called to add an end mark to the source, an event far in the future, and the
    stream runs on, so that its watermark passes everything and all windows, sessions and waiting rows come out. Output and
    checkpoint live in the shared folder, so a lost executor resumes from them.
    """
    spark: SparkSession = stream.sparkSession
    root = shared_dir(spark, purpose)
    out = f"{root}/out"
    for step in (None, finish) if finish else (None,):
        if step:
            step()
        q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{root}/checkpoint")
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def late(log: DataFrame, result: DataFrame, key: str = "audit_id") -> DataFrame:
    """The rows of the batch ``log`` that a stream over it has no result for: they came after its watermark had passed them."""
    return log.join(result.select(key).distinct(), key, "left_anti")
