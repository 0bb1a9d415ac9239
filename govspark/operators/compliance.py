"""Security summary and the three compliance reports as tidy rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govspark.operators.lineage import coverage

# Sections of each report, in order.
SECTIONS = {
    "SOC2": ["summary", "security_events", "access_controls", "audit_integrity", "pii_inventory"],
    "GDPR": ["summary", "pii_inventory", "masking_coverage", "access_controls"],
    "HIPAA": ["summary", "pii_inventory", "security_events", "access_controls", "audit_integrity"],
}
COVERAGE_GOOD, COVERAGE_FAIR = 95.0, 80.0
MAX_ANOMALIES, MAX_RATE_LIMITED = 10, 100


def security_summary(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts over the log, overall or per group (such as tenant_id)."""
    return log.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total_queries"), F.count_if(F.col("decision") == "BLOCK").alias("blocked_queries"),
        F.count_if(F.col("threat_level").isin("HIGH", "CRITICAL")).alias("injection_attempts"),
        F.count_if(F.col("anomaly_score") >= 0.5).alias("anomalies_detected"),
        F.count_if("rate_limited").alias("rate_limited_requests"), F.countDistinct("user_name").alias("tracked_users"))


def coverage_status(pct: Column) -> Column:
    return F.when(pct >= COVERAGE_GOOD, "Excellent").when(pct >= COVERAGE_FAIR, "Needs Improvement").otherwise("Critical")


def _rows(one_row: DataFrame, section: str, metrics: dict[str, tuple[Column, Column]]) -> DataFrame:
    return one_row.select(F.inline_outer(F.array(*[
        F.struct(F.lit(section).alias("section"), F.lit(m).alias("metric"), v.cast("double").alias("value"),
                 s.cast("string").alias("status")) for m, (v, s) in metrics.items()])))


def compliance_report(kind: str, log: DataFrame, lineage: DataFrame, broken_links: DataFrame) -> DataFrame:
    """(section, metric, value, status) rows. ``broken_links``: one row with ``broken``, the number of
    log rows whose hash chain does not verify."""
    none = F.lit(None)
    sec = security_summary(log)
    per_column = lineage.groupBy("database_name", "table_name", "column_name").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("was_masked").alias("masked"))
    pii = per_column.agg(F.count(F.lit(1)).alias("columns"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"),
                         F.coalesce(F.sum("masked"), F.lit(0)).alias("masked"))
    pct = F.round(coverage(F.col("masked"), F.col("total")), 6)
    warn = lambda cond: F.when(cond, "warn").otherwise("pass")
    built = {
        "summary": lambda: _rows(sec, "summary", {
            "total_queries": (F.col("total_queries"), none), "tracked_users": (F.col("tracked_users"), none)}),
        "security_events": lambda: _rows(sec, "security_events", {
            "injection_attempts": (F.col("injection_attempts"), warn(F.col("injection_attempts") > 0)),
            "anomalies_detected": (F.col("anomalies_detected"), warn(F.col("anomalies_detected") > MAX_ANOMALIES)),
            "rate_limited_requests": (F.col("rate_limited_requests"), warn(F.col("rate_limited_requests") > MAX_RATE_LIMITED)),
            "blocked_queries": (F.col("blocked_queries"), F.lit("Enforced"))}),
        "access_controls": lambda: per_column.select(
            F.lit("access_controls").alias("section"),
            F.concat_ws(".", "database_name", "table_name", "column_name").alias("metric"),
            F.col("total").cast("double").alias("value"),
            F.when(F.col("masked") == F.col("total"), "masked").otherwise("exposed").alias("status")),
        "audit_integrity": lambda: _rows(broken_links, "audit_integrity", {
            "broken_links": (F.col("broken"), F.when(F.col("broken") == 0, "Intact").otherwise("Gaps detected"))}),
        "pii_inventory": lambda: _rows(pii, "pii_inventory", {
            "pii_columns": (F.col("columns"), none), "pii_accesses": (F.col("total"), none),
            "masked": (F.col("masked"), none), "unmasked": (F.col("total") - F.col("masked"), none)}),
        "masking_coverage": lambda: _rows(pii, "masking_coverage", {
            "coverage_pct": (pct, coverage_status(pct))}),
    }
    return reduce(DataFrame.unionByName, [built[s]() for s in SECTIONS[kind]])
