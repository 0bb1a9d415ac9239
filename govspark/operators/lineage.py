"""Who read which sensitive column, and the catalog built from those events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govspark.runtime import position

_KEY = ["database_name", "table_name", "column_name"]


def lineage_summary(events: DataFrame, exact: bool = True) -> DataFrame:
    """Per database.table.column: first class seen, accesses split by mask, users, first and last access.

    The log is reduced to (column, class, user) counts first; ``exact=False`` counts users approximately
    in the same pass instead.
    """
    by = [*_KEY, "classification"] + (["user_name"] if exact else [])
    users = [] if exact else [F.approx_count_distinct("user_name").alias("users")]
    some = events.groupBy(*by).agg(
        F.min(position()).alias("at"), F.count(F.lit(1)).alias("n"), F.count_if("was_masked").alias("masked"),
        F.min("ts_us").alias("first"), F.max("ts_us").alias("last"), *users)
    if exact:
        some = some.groupBy(*_KEY, "user_name").agg(
            F.min_by("classification", "at").alias("classification"), F.min("at").alias("at"), F.sum("n").alias("n"),
            F.sum("masked").alias("masked"), F.min("first").alias("first"), F.max("last").alias("last")).withColumn("users", F.lit(1))
    return some.groupBy(*_KEY).agg(
        F.min_by("classification", "at").alias("classification"), F.sum("n").alias("total_accesses"),
        F.sum("masked").alias("masked_accesses"), (F.sum("n") - F.sum("masked")).alias("unmasked_accesses"),
        (F.sum("users") if exact else F.max("users")).cast("bigint").alias("users"),
        F.min("first").alias("first_access_us"), F.max("last").alias("last_access_us"),
    ).select(F.concat_ws(".", *_KEY).alias("column_key"), "*").drop(*_KEY)


def pii_access_report(events: DataFrame) -> DataFrame:
    """Per user and column: own counts beside the column's totals, and the overall masking coverage."""
    own = events.groupBy("user_name", *_KEY).agg(
        F.min("classification").alias("classification"), F.count(F.lit(1)).alias("access_count"),
        F.count_if("was_masked").alias("masked_count"), F.max("ts_us").alias("last_access_us"))
    totals = own.groupBy(*_KEY).agg(F.sum("access_count").alias("column_accesses"),
                                    F.sum("masked_count").alias("column_masked"))
    overall = totals.agg(coverage(F.sum("column_masked"), F.sum("column_accesses"))).scalar()
    return own.join(totals, _KEY).withColumns({
        "coverage_pct": overall, "unmasked_count": F.col("access_count") - F.col("masked_count")})


def coverage(masked: Column, total: Column) -> Column:
    return F.when(total > 0, masked / total * 100).otherwise(0.0)


def lineage_events(events: DataFrame, user: str | None = None, table: str | None = None, limit: int | None = 100) -> DataFrame:
    """Newest events of a user and/or table: the result is cut at ``limit``, all of them with None."""
    if user is not None:
        events = events.filter(F.col("user_name") == user)
    if table is not None:
        events = events.filter(F.col("table_name") == table)
    newest = events.orderBy(F.desc("ts_us"), F.desc("audit_id"))
    return newest if limit is None else newest.limit(limit)


def subject_access(events: DataFrame, user: str, limit: int | None = None) -> DataFrame:
    """Data-subject export: everything recorded about one user, newest first."""
    return lineage_events(events, user=user, limit=limit)


def catalog_columns(events: DataFrame) -> DataFrame:
    """Per table.column: the most confident class (the earliest of equals), counts, users, first and last seen.

    The log is reduced to (column, class, strategy, confidence, user) counts before anything is ranked.
    """
    key = ["table_name", "column_name"]
    some = events.groupBy(*key, "classification", "strategy", "confidence", "user_name").agg(
        F.min(position()).alias("at"), F.count(F.lit(1)).alias("n"), F.count_if("was_masked").alias("masked"),
        F.min("ts_us").alias("first"), F.max("ts_us").alias("last"))
    best = F.max_by(F.struct("classification", "strategy", "confidence"), F.struct("confidence", -F.col("at")))
    per_user = some.groupBy(*key, "user_name").agg(
        best.alias("_b"), F.max(F.struct("confidence", -F.col("at"))).alias("_r"), F.sum("n").alias("n"),
        F.sum("masked").alias("masked"), F.min("first").alias("first"), F.max("last").alias("last"))
    return per_user.groupBy(*key).agg(
        F.max_by("_b", "_r").alias("_b"), F.sum("n").alias("accesses"), F.sum("masked").alias("masked"),
        F.count(F.lit(1)).alias("users"), F.min("first").alias("first_seen_us"), F.max("last").alias("last_seen_us"),
    ).select(*key, F.col("_b.classification").alias("pii_type"), F.col("_b.strategy").alias("strategy"),
             F.col("_b.confidence").alias("confidence"), "accesses", "masked", "users", "first_seen_us", "last_seen_us")


def catalog_tables(columns: DataFrame) -> DataFrame:
    """Per table, from ``catalog_columns``: accesses, the column list, first and last seen."""
    return columns.groupBy("table_name").agg(
        F.sum("accesses").alias("accesses"), F.array_join(F.array_sort(F.collect_set("column_name")), ",").alias("columns"),
        F.min("first_seen_us").alias("first_seen_us"), F.max("last_seen_us").alias("last_seen_us"))


def catalog_with_snapshot(columns: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Seed the catalog with every column of a schema snapshot; unseen ones have no class and no access."""
    seeded = snapshot.select("table_name", "column_name").distinct()
    return seeded.join(columns, ["table_name", "column_name"], "full").withColumn(
        "accesses", F.coalesce("accesses", F.lit(0)))


def catalog_stats(columns: DataFrame) -> DataFrame:
    return columns.agg(
        F.countDistinct("table_name").alias("tables"), F.count(F.lit(1)).alias("columns"),
        F.count_if(F.col("pii_type").isNotNull() & (F.col("pii_type") != "None")).alias("pii_columns"),
        F.sum("accesses").alias("recorded"))


def catalog_search(columns: DataFrame, text: str | None = None, pii_type: str | None = None) -> DataFrame:
    """By class, and/or by a part of the table or column name in any case."""
    if pii_type is not None:
        columns = columns.filter(F.col("pii_type") == pii_type)
    if text:
        part = text.lower()
        columns = columns.filter(F.lower("table_name").contains(part) | F.lower("column_name").contains(part))
    return columns


def unclassified_columns(snapshot: DataFrame, columns: DataFrame) -> DataFrame:
    """Snapshot columns for which the catalog holds no class."""
    classified = columns.filter(F.col("pii_type").isNotNull()).select("table_name", "column_name")
    return snapshot.join(classified, ["table_name", "column_name"], "left_anti")
