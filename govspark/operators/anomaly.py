"""Behaviour anomalies per user.

First-time events come from ``min`` aggregates of positions; the warm-up bound is the user's n-th
query, found by slice counts. No window ever ranges over all rows of a user.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from govspark.operators import ordered
from govspark.runtime import at_position, floor_to, position

# Contribution of each kind to the score.
WEIGHTS = {"NEW_TABLE": 0.3, "NEW_QUERY_PATTERN": 0.2, "UNUSUAL_HOUR": 0.2, "VOLUME_SPIKE": 0.4}
ANOMALOUS = 0.5
HOUR_US = 3_600_000_000
ORDER = ["ts_us", "audit_id"]
OUT = ["audit_id", "user_name", "ts_us", "anomaly", "score"]


def warm_since(log: DataFrame, after: int) -> DataFrame:
    """Per user, the position (ts_us, audit_id) of query number ``after``; later ones may be judged."""
    return ordered.nth_row(log.select("user_name", *ORDER), ["user_name"], ORDER, after).select(
        "user_name", F.struct(*ORDER).alias("_warm"))


def first_time_events(log: DataFrame, after: int = 100) -> DataFrame:
    """Tables, fingerprints (0 means unknown) and UTC hours a warmed-up user had never used before.

    One pass reduces the log to (user, tables, fingerprint, hour) combinations; only those are unfolded
    into things and reduced to each thing's first use.
    """
    hour = (floor_to("ts_us", HOUR_US) / HOUR_US % 24).cast("int")
    uses = log.groupBy("user_name", "tables", "fingerprint_hash", hour.alias("hour")).agg(F.min(position()).alias("at"))
    thing = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("thing"))
    none = F.array().cast("array<struct<kind:string,thing:string>>")
    things = uses.select("user_name", "at", F.inline_outer(F.concat(
        F.coalesce(F.transform("tables", lambda t: thing("NEW_TABLE", t)), none),
        F.when(F.col("fingerprint_hash") != 0, F.array(thing("NEW_QUERY_PATTERN", F.col("fingerprint_hash")))).otherwise(none),
        F.array(thing("UNUSUAL_HOUR", F.col("hour"))))))
    first = things.groupBy("user_name", "kind", "thing").agg(F.min("at").alias("at"))
    seen = first.withColumns(at_position("at"))
    late = seen.join(warm_since(log, after), "user_name").filter(F.struct(*ORDER) > F.col("_warm"))
    text = F.when(F.col("kind") == "NEW_QUERY_PATTERN", F.col("kind")).otherwise(F.concat_ws(":", "kind", "thing"))
    score = F.when(F.col("kind") == "NEW_TABLE", WEIGHTS["NEW_TABLE"]).when(
        F.col("kind") == "UNUSUAL_HOUR", WEIGHTS["UNUSUAL_HOUR"]).otherwise(WEIGHTS["NEW_QUERY_PATTERN"])
    return late.select("audit_id", "user_name", "ts_us", "kind", text.alias("anomaly"), score.alias("score"))


def _only(log: DataFrame, kind: str, after: int) -> DataFrame:
    return first_time_events(log, after).filter(F.col("kind") == kind).select(*OUT)


def new_tables(log: DataFrame, after: int = 100) -> DataFrame:
    return _only(log, "NEW_TABLE", after)


def new_patterns(log: DataFrame, after: int = 100) -> DataFrame:
    return _only(log, "NEW_QUERY_PATTERN", after)


def unusual_hours(log: DataFrame, after: int = 100) -> DataFrame:
    return _only(log, "UNUSUAL_HOUR", after)


def _beyond(count: Column, z: float) -> Column:
    """Is ``count`` more than ``z`` deviations above the baseline's mean?

    Compared as squares of whole numbers — (n·c − Σ)² > z²·(n·Σ² − (Σ)²) — so that a count exactly on the
    threshold is not decided by rounding.
    """
    over = F.col("baseline_windows") * count - F.col("_sum")
    spread = F.col("baseline_windows") * F.col("_squares") - F.col("_sum") * F.col("_sum")
    return F.coalesce((F.col("baseline_windows") >= 2) & (spread > 0) & (over > 0)
                      & (over.cast("double") * over > F.lit(z * z) * spread), F.lit(False))


def volume_windows(log: DataFrame, window_us: int = 300_000_000, history: int = 288, z: float = 3.0) -> DataFrame:
    """Per (user, aligned non-empty window): queries, baseline of up to ``history`` earlier windows, spike."""
    counts = log.groupBy("user_name", floor_to("ts_us", window_us).alias("window_us")).agg(
        F.count(F.lit(1)).alias("queries"))
    past = W.partitionBy("user_name").orderBy("window_us").rowsBetween(-history, -1)
    base = counts.withColumns({
        "baseline_windows": F.count(F.lit(1)).over(past), "_sum": F.sum("queries").over(past),
        "_squares": F.sum(F.col("queries") * F.col("queries")).over(past)})
    known = F.col("baseline_windows") >= 2
    deviation = F.sqrt(F.col("baseline_windows") * F.col("_squares") - F.col("_sum") * F.col("_sum")) / F.col("baseline_windows")
    return base.withColumns({
        "mean_queries": F.when(known, F.col("_sum") / F.col("baseline_windows")), "sd_queries": F.when(known, deviation),
        "spike": _beyond(F.col("queries"), z)})


def volume_spikes(log: DataFrame, window_us: int = 300_000_000, history: int = 288, z: float = 3.0) -> DataFrame:
    """Rows that arrive when their window already holds more than mean + z·sd queries."""
    hot = volume_windows(log, window_us, history, z).filter("spike").select(
        "user_name", F.col("window_us").alias("_win"), "baseline_windows", "_sum", "_squares")
    inside = log.withColumn("_win", floor_to("ts_us", window_us)).join(hot, ["user_name", "_win"])
    counted = ordered.prior_sums(inside, ["user_name", "_win"], ORDER, {"_n": F.lit(1)})
    return (counted.filter(_beyond(F.col("_n"), z))
            .select("audit_id", "user_name", "ts_us", F.lit("VOLUME_SPIKE").alias("anomaly"),
                    F.lit(WEIGHTS["VOLUME_SPIKE"]).alias("score")).select(*OUT))


def anomaly_scores(log: DataFrame, after: int = 100, window_us: int = 300_000_000,
                   history: int = 288, z: float = 3.0) -> DataFrame:
    """Score of every row with at least one anomaly: the capped sum of its parts.

    ``log``: user_name, audit_id, ts_us, tables (array), fingerprint_hash.
    """
    parts = first_time_events(log, after).select(*OUT).unionByName(volume_spikes(log, window_us, history, z))
    # At most one entry per table of a query and one of each other kind is collected per row.
    scored = parts.groupBy("audit_id", "user_name").agg(
        F.least(F.lit(1.0), F.round(F.sum("score"), 6)).alias("anomaly_score"),
        F.array_join(F.array_sort(F.collect_list("anomaly")), ",").alias("anomalies"))
    return scored.withColumn("is_anomalous", F.col("anomaly_score") >= ANOMALOUS)
