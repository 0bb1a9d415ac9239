"""Failures and load read from the log: error classes, outages, lockouts, latency, token usage, alerts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from govspark.operators import ordered
from govspark.runtime import floor_to, small_side

SECOND_US, HOUR_US = 1_000_000, 3_600_000_000

# Message parts of each failure class; infrastructure is tested first.
INFRASTRUCTURE = ["connection refused", "could not connect", "server closed", "timeout", "host not found",
                  "no route", "connection reset", "broken pipe", "could not send", "could not receive"]
TRANSIENT = ["deadlock", "lock timeout", "serialization failure", "could not obtain lock",
             "failed to acquire database connection"]


def error_class(message: Column) -> Column:
    low = F.lower(message)
    return (F.when(low.rlike("|".join(INFRASTRUCTURE)), "INFRASTRUCTURE")
            .when(low.rlike("|".join(TRANSIENT)), "TRANSIENT").otherwise("APPLICATION"))


def outage_episodes(log: DataFrame, threshold: int = 10) -> DataFrame:
    """Runs of at least ``threshold`` infrastructure failures of a database with no success between.

    A run is named by the number of successes before it; other failures neither extend nor end it.
    """
    kind = F.when(F.col("execution_success"), "SUCCESS").otherwise(error_class(F.col("error_message")))
    rows = log.select("database_name", "ts_us", "audit_id", kind.alias("_kind")).filter(
        F.col("_kind").isin("SUCCESS", "INFRASTRUCTURE"))
    runs = ordered.prior_sums(rows, ["database_name"], ["ts_us", "audit_id"], {"run": (F.col("_kind") == "SUCCESS").cast("long")})
    return (runs.filter(F.col("_kind") == "INFRASTRUCTURE").groupBy("database_name", "run").agg(
        F.count(F.lit(1)).alias("failures"), F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"))
        .filter(F.col("failures") >= threshold).drop("run"))


def lockout_candidates(auth: DataFrame, attempts: int = 5, window_us: int = 60 * SECOND_US) -> DataFrame:
    """Failures that make ``attempts`` or more within the window, per source address and per user."""
    keyed = auth.filter(~F.col("success")).select(
        "audit_id", "ts_us", F.inline_outer(F.array(
            F.struct(F.lit("ip").alias("kind"), F.col("source_ip").alias("key")),
            F.struct(F.lit("user").alias("kind"), F.col("user_name").alias("key")))))
    counted = ordered.trailing_count(keyed, ["kind", "key"], "ts_us", window_us, "failures")
    return counted.filter(F.col("failures") >= attempts)


# Upper bounds (ms) and representative values (ms) of the latency buckets.
BUCKET_BOUNDS_MS = [10, 50, 200, 1000]
BUCKET_MIDPOINTS_MS = [5, 30, 125, 600, 2000]


def latency_histogram(log: DataFrame, window_us: int = HOUR_US, original_tps: int = 1000,
                      target_ms: int = 50, throttle_ms: int = 200) -> DataFrame:
    """Per window: bucket counts, approximate p95, and the mode and rate an adaptive limiter would choose."""
    ms = floor_to("execution_time_us", 1000) / 1000
    low = [F.lit(0), *[F.lit(b) for b in BUCKET_BOUNDS_MS]]
    buckets = [F.count_if((ms >= low[i]) & (ms < BUCKET_BOUNDS_MS[i]) if i < 4 else ms >= low[i]).alias(f"b{i}")
               for i in range(5)]
    h = log.groupBy(floor_to("ts_us", window_us).alias("window_us")).agg(F.count(F.lit(1)).alias("n"), *buckets)
    need = F.floor((F.col("n") * 95 + 99) / 100)
    p95, upto = F, F.lit(0)
    for i, mid in enumerate(BUCKET_MIDPOINTS_MS):
        upto = upto + F.col(f"b{i}")
        p95 = p95.when(upto >= need, mid)
    h = h.withColumn("p95_ms", p95.otherwise(BUCKET_MIDPOINTS_MS[-1]))
    mode = F.when(F.col("p95_ms") >= throttle_ms, "PROTECT").when(F.col("p95_ms") >= target_ms, "THROTTLE").otherwise("NORMAL")
    tps = (F.when(F.col("p95_ms") >= throttle_ms, max(original_tps // 10, 1))
           .when(F.col("p95_ms") >= target_ms, max(original_tps * 4 // 10, 1)).otherwise(original_tps))
    return h.withColumn("mode", mode).withColumn("recommended_tps", tps)


def span_breakdown(log: DataFrame, spans: str = "spans") -> DataFrame:
    """Per operation: count, mean and (nearest-rank) 95th percentile of span durations.

    The exact percentile is read off a histogram of durations, so a hot operation is pre-aggregated.
    """
    each = log.select(F.inline(spans)).groupBy("op", "dur_us").agg(F.count(F.lit(1)).alias("c"))
    per_op = each.groupBy("op").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("dur_us")).alias("total_us"))
    # Histogram rows per coarse duration step, then only the step that crosses the rank is opened.
    coarse = each.groupBy("op", floor_to("dur_us", 1000).alias("step")).agg(F.sum("c").alias("sc"))
    upto = F.sum("sc").over(W.partitionBy("op").orderBy("step"))
    rank = F.ceil(F.col("n") * 95 / 100)
    crossing = (coarse.join(per_op, "op").withColumn("_upto", upto)
                .filter((F.col("_upto") >= rank) & (F.col("_upto") - F.col("sc") < rank))
                .select("op", "step", "n", "total_us", (rank - (F.col("_upto") - F.col("sc"))).alias("_need")))
    fine = each.withColumn("step", floor_to("dur_us", 1000)).join(crossing, ["op", "step"])
    seen = F.sum("c").over(W.partitionBy("op", "step").orderBy("dur_us"))
    hit = fine.withColumn("_seen", seen).filter(F.col("_seen") >= F.col("_need"))
    return hit.groupBy("op", "n", "total_us").agg(F.min("dur_us").alias("p95_us")).select(
        "op", F.col("n").alias("spans"), F.round(F.col("total_us") / F.col("n"), 6).alias("avg_us"), "p95_us")


# Tokens a request costs by priority.
PRIORITY_TOKENS = {"HIGH": 1, "NORMAL": 1, "LOW": 2, "BACKGROUND": 4}


def usage_rollup(log: DataFrame, limits: DataFrame, nodes: int = 1, window_us: int = SECOND_US) -> DataFrame:
    """Windows in which all requests (level ``global``, key ``all``), a user, database or user×database used more tokens than
    the limit.

    ``limits``: level, key (``*`` is the level's default), tokens_per_second; a node's share is limit / nodes. Levels are
    sums over the tokens of each window's users and databases, so no level moves the log's rows.
    """
    tokens = F
    for p, t in PRIORITY_TOKENS.items():
        tokens = tokens.when(F.col("priority") == p, t)
    each = log.groupBy(floor_to("ts_us", window_us).alias("window_us"), "user_name", "database_name").agg(
        F.sum(tokens.otherwise(1)).alias("tokens"))
    keyed = each.select(
        "window_us", "tokens", F.inline_outer(F.array(
            F.struct(F.lit("global").alias("level"), F.lit("all").alias("key")),
            F.struct(F.lit("user").alias("level"), F.col("user_name").alias("key")),
            F.struct(F.lit("database").alias("level"), F.col("database_name").alias("key")),
            F.struct(F.lit("user_database").alias("level"), F.concat_ws(":", "user_name", "database_name").alias("key")))))
    used = keyed.groupBy("window_us", "level", "key").agg(F.sum("tokens").alias("tokens"))
    share = F.greatest(F.floor(F.col("tokens_per_second") / nodes), F.lit(1))
    named = limits.filter("key <> '*'").select("level", "key", share.alias("_own"))
    default = limits.filter("key = '*'").select("level", share.alias("_default"))
    joined = used.join(small_side(named), ["level", "key"], "left").join(small_side(default), ["level"], "left")
    limit = F.coalesce("_own", "_default") * F.lit(window_us / SECOND_US)
    return joined.withColumn("token_limit", limit.cast("long")).filter(F.col("tokens") > F.col("token_limit")).select(
        "window_us", "level", "key", "tokens", "token_limit")


# Alert conditions → the log rows each counts; an overflow adds up what the rows say was lost before them.
ALERT_CONDITIONS = {
    "rate_limit_breach": "rate_limited",
    "policy_violation_spike": "decision = 'BLOCK'",
    "circuit_breaker_open": "error_code = 'CIRCUIT_OPEN' OR (NOT execution_success AND lower(error_message) LIKE '%connection refused%')",
    "pii_exposure_spike": "pii_exposed",
    "audit_buffer_overflow": "lost_events > 0",
    "custom_metric": "metric_hit",
}


def alert_value(condition: str) -> Column:
    """What a rule of this condition measures in a window, as an aggregate."""
    if condition == "audit_buffer_overflow":
        return F.coalesce(F.sum("lost_events"), F.lit(0))
    return F.count_if(F.coalesce(F.expr(ALERT_CONDITIONS[condition]), F.lit(False)))


def with_exposure(log: DataFrame, lineage: DataFrame) -> DataFrame:
    """Add ``pii_exposed``: did the row read a sensitive column unmasked? ``lineage``: audit_id, was_masked. The log may be a stream."""
    seen = lineage.where(~F.col("was_masked")).select("audit_id").distinct().withColumn("pii_exposed", F.lit(True))
    return log.join(seen, "audit_id", "left").withColumn("pii_exposed", F.coalesce("pii_exposed", F.lit(False)))


def with_lost_events(log: DataFrame) -> DataFrame:
    """Add ``lost_events``: how many sequence numbers are missing before the row's. Rows without one have lost none."""
    numbered = ordered.previous_row(log.where("sequence_num IS NOT NULL"), [], ["sequence_num"], {"_before": "sequence_num"})
    lost = numbered.withColumn("lost_events", F.greatest(F.coalesce(F.col("sequence_num") - F.col("_before") - 1, F.lit(0)), F.lit(0))).drop("_before")
    return lost.unionByName(log.where("sequence_num IS NULL").withColumn("lost_events", F.lit(0).cast("long")))


def alert_counts(log: DataFrame, rules: list[dict]) -> DataFrame:
    """(rule, window_us, value, threshold) for every window of each rule from the log's first to its last."""
    per_window = []
    for width in sorted({r["window_us"] for r in rules}):
        mine = [r for r in rules if r["window_us"] == width]
        counts = log.groupBy(floor_to("ts_us", width).alias("window_us")).agg(*[
            alert_value(r["condition"]).alias(r["name"]) for r in mine])
        span = counts.agg(F.min("window_us").alias("a"), F.max("window_us").alias("b")).filter("a IS NOT NULL")
        grid = span.select(F.explode(F.sequence("a", "b", F.lit(width))).alias("window_us"))
        counts = grid.join(counts, "window_us", "left").fillna(0)
        per_window.append(counts.select("window_us", F.inline_outer(F.array(*[
            F.struct(F.lit(r["name"]).alias("rule"), F.col(r["name"]).cast("long").alias("value"),
                     F.lit(float(r["threshold"])).alias("threshold")) for r in mine]))))
    return reduce(DataFrame.unionByName, per_window)


def alert_episodes(counts: DataFrame) -> DataFrame:
    """Fire when a rule's value reaches its threshold, resolve at the first window below it.

    Over ``alert_counts``: one row per rule and window, however long the log is.
    """
    w = W.partitionBy("rule").orderBy("window_us")
    breach = F.col("value") >= F.col("threshold")
    marked = counts.withColumn("_b", breach).withColumn("_p", F.coalesce(F.lag("_b").over(w), F.lit(False)))
    event = F.when(F.col("_b") & ~F.col("_p"), "fired").when(~F.col("_b") & F.col("_p"), "resolved")
    return marked.withColumn("event", event).filter(F.col("event").isNotNull()).select("rule", "window_us", "value", "event")
