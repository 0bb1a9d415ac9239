"""Reports over the audit log: named filters, counters, slow queries, index advice, sampling, text shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govspark import schemas
from govspark.functions import sqltext
from govspark.operators import ordered
from govspark.runtime import MAX_BROADCAST_ROWS, fits_broadcast, small_side


def audit_view(log: DataFrame, name: str, value=None) -> DataFrame:
    """The named filters of the log; each is a pushable predicate on stored columns."""
    filters = {
        "user_history": lambda: F.col("user_name") == value,
        "denied": lambda: F.col("decision") == "BLOCK",
        "pii_access": lambda: F.size("classifications") > 0,
        "by_table": lambda: F.array_contains("tables", value),
        "by_fingerprint": lambda: F.col("fingerprint_hash") == value,
        "rate_limited": lambda: F.col("rate_limited"),
        "failed": lambda: ~F.col("execution_success"),
    }
    return log.filter(filters[name]())


def audit_sample(log: DataFrame, select_rate: float = 1.0, other_rate: float = 1.0, deterministic: bool = True) -> DataFrame:
    """Always keep blocked, failed and writing statements; keep others at a rate.

    Deterministic sampling decides by fingerprint, so all runs of one query shape share their fate.
    """
    always = ((F.col("decision") == "BLOCK") | (F.col("error_code") != "NONE")
              | F.col("statement_type").isin(schemas.WRITE_STATEMENTS))
    rate = F.when(F.col("statement_type") == "SELECT", select_rate).otherwise(other_rate)
    if deterministic:
        kept = F.pmod(F.col("fingerprint_hash"), F.lit(10000)) < F.floor(rate * 10000)
    else:
        kept = F.rand() < rate
    return log.filter(always | (rate >= 1.0) | ((rate > 0.0) & kept))


def request_counters(log: DataFrame) -> DataFrame:
    """Totals by database, user and decision with all roll-up levels (``*`` marks a rolled-up key)."""
    rolled = log.rollup("database_name", "user_name", "decision").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if("rate_limited").alias("rate_limited"),
        F.count_if(F.col("error_code") != "NONE").alias("errors"), F.grouping_id().alias("level"))
    bits = {"database_name": 3, "user_name": 1, "decision": 0}
    keys = [F.when(F.col("level") > limit if limit else F.col("level") >= 1, "*").otherwise(F.col(c)).alias(c)
            for c, limit in bits.items()]
    return rolled.select(*keys, "requests", "rate_limited", "errors")


def slow_queries(log: DataFrame, threshold_us: int = 500_000, n: int = 100) -> DataFrame:
    """The most recent executions at or above the threshold."""
    return log.filter(F.col("execution_time_us") >= threshold_us).orderBy(F.desc("ts_us"), F.desc("audit_id")).limit(n)


def index_advice(log: DataFrame, min_count: int = 3, n: int = 50) -> DataFrame:
    """Filtered column sets per table worth an index (or a bucketing / sort order on files)."""
    each = (log.filter((F.size("columns_filtered") > 0) & (F.size("tables") > 0))
            .select(F.explode("tables").alias("table_name"), F.array_sort("columns_filtered").alias("_cols"), "execution_time_us")
            .filter(F.col("table_name") != ""))
    seen = each.groupBy("table_name", "_cols").agg(
        F.count(F.lit(1)).alias("occurrences"), F.sum("execution_time_us").alias("_t")).filter(F.col("occurrences") >= min_count)
    cols, named = F.array_join("_cols", ", "), F.array_join("_cols", "_")
    avg = F.col("_t") / F.col("occurrences")
    return seen.select(
        "table_name", F.array_join("_cols", ",").alias("filter_columns"), "occurrences", F.round(avg, 6).alias("avg_us"),
        F.concat(F.lit("CREATE INDEX idx_"), "table_name", F.lit("_"), named, F.lit(" ON "), "table_name", F.lit("("), cols, F.lit(")")).alias("suggested_ddl"),
        F.concat(F.lit("CLUSTERED BY ("), cols, F.lit(")")).alias("suggested_layout"),
    ).orderBy(F.desc("occurrences"), "table_name", "filter_columns").limit(n)


def fingerprints(log: DataFrame, sql: str = "sql_text") -> DataFrame:
    """Add ``normalized`` and ``fingerprint_hash`` to every row; a narrow projection."""
    return log.withColumn("normalized", sqltext.normalize_sql(F.col(sql))).withColumn(
        "fingerprint_hash", sqltext.fingerprint_hash(F.col("normalized")))


def fingerprint_stats(log: DataFrame, sql: str = "sql_text") -> DataFrame:
    """Per query shape: runs, mean and longest time, users, and the text of its first run.

    Counts per (shape, user) come first; the example texts are then fetched by their row ids.
    """
    some = fingerprints(log, sql).groupBy("normalized", "user_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("execution_time_us").alias("t"), F.max("execution_time_us").alias("longest"),
        F.min("audit_id").alias("first_id"))
    shapes = some.groupBy("normalized").agg(
        F.sum("n").alias("runs"), F.round(F.sum("t") / F.sum("n"), 6).alias("avg_us"), F.max("longest").alias("max_us"),
        F.count(F.lit(1)).alias("users"), F.min("first_id").alias("audit_id"))
    return log.select("audit_id", F.col(sql).alias("example")).join(shapes, "audit_id").drop("audit_id")


def firewall_learn(log: DataFrame, key: str = "normalized") -> DataFrame:
    """The allowlist: the distinct query shapes of a trusted log."""
    return log.select(key).distinct()


def firewall_check(log: DataFrame, allowlist: DataFrame, key: str = "normalized", mode: str = "enforce") -> DataFrame:
    """``enforce`` keeps known shapes; ``violations`` and ``learning`` keep the unknown ones.

    Works with a streaming ``log`` and a static allowlist. In batch, AQE picks the strategy from the
    allowlist's real size and splits a shape that fills a partition.
    """
    known = small_side(allowlist) if log.isStreaming else allowlist
    return log.join(known, key, "left_semi" if mode == "enforce" else "left_anti")


def describe_queries(log: DataFrame) -> DataFrame:
    """Add ``summary``, one English sentence per statement, from its type, tables and column lists."""
    quoted = lambda c: F.array_join(F.transform(c, lambda t: F.concat(F.lit("'"), t, F.lit("'"))), ", ")
    plain = lambda c: F.array_join(c, ", ")
    part = lambda text, c, show: F.when(F.size(c) > 0, F.concat(F.lit(text), show(c))).otherwise("")
    kind = F.col("statement_type")
    read, written = F.col("tables_read"), F.col("tables_written")
    filtered = part(", filtering by ", F.col("columns_filtered"), quoted)
    assigned = part(" columns: ", F.col("columns_written"), plain)
    body = (F.when(kind == "SELECT", F.concat(part(" reads from ", read, quoted), filtered, part(", returning: ", F.col("columns_selected"), plain)))
            .when(kind == "INSERT", F.concat(part(" writes to ", written, quoted), assigned))
            .when(kind == "UPDATE", F.concat(part(" modifies ", written, quoted), assigned, filtered))
            .when(kind == "DELETE", F.concat(part(" removes from ", written, quoted), filtered))
            .otherwise(F.when(F.size(written) > 0, part(" targets ", written, quoted)).otherwise(part(" references ", read, quoted))))
    return log.withColumn("summary", F.concat(F.lit("This "), kind, body))


def plan_costs(log: DataFrame, plan: str = "plan_text", max_cost: float = 100_000.0, max_rows: int = 1_000_000) -> DataFrame:
    """Node type, total cost and row estimate of a plan's first line, and whether they exceed the bounds."""
    text = F.col(plan)
    head = F.rtrim(F.regexp_extract(text, r"(?s)^([^(]*)[(]", 1))
    node = F.when(F.instr(head, " on ") > 0, F.substring_index(head, " on ", 1)).otherwise(head)
    return (log.withColumn("plan_type", F.regexp_replace(node, "^[ >-]+", ""))
            .withColumn("total_cost", F.coalesce(F.regexp_extract(text, r"cost=[^ )]*?[.][.]([0-9.]+)[ )]", 1).try_cast("double"), F.lit(0.0)))
            .withColumn("estimated_rows", F.coalesce(F.regexp_extract(text, r"rows=([0-9]+)[ )]", 1).try_cast("bigint"), F.lit(0)))
            .withColumn("exceeded_cost", F.col("total_cost") > max_cost)
            .withColumn("exceeded_rows", F.col("estimated_rows") > max_rows))


# --- network and place ----------------------------------------------------------------------------

def ipv4(c: Column) -> Column:
    """Dotted IPv4 → number; NULL when it is not one."""
    octet = lambda i: F.element_at(F.split(c, "[.]"), i).try_cast("bigint")
    shaped = c.rlike(r"^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+\z")
    ok = shaped & (octet(1) <= 255) & (octet(2) <= 255) & (octet(3) <= 255) & (octet(4) <= 255)
    return F.when(ok, octet(1) * 16777216 + octet(2) * 65536 + octet(3) * 256 + octet(4))


def ip_allowlist(log: DataFrame, entries: DataFrame, by: str, ip: str = "source_ip", broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Add ``ip_allowed``. ``entries``: ``by`` key and ``cidr``; a key without entries allows every address,
    an unreadable address is denied where entries exist, an unreadable entry is ignored.

    Up to ``broadcast_rows`` entries are broadcast, a key's ranges as one array, so every log row is read once. More are laid
    among the addresses in order: an address is allowed if a range that starts before it ends behind it (``ordered.running_max``).
    """
    net, bits = F.substring_index("cidr", "/", 1), F.when(F.contains("cidr", F.lit("/")), F.regexp_extract("cidr", r"/([0-9]+)\z", 1).try_cast("int")).otherwise(32)
    ranges = entries.select(by, ipv4(net).alias("_net"), bits.alias("_bits"))
    size = F.pow(F.lit(2.0), 32 - F.col("_bits")).cast("bigint")
    address = ipv4(F.col(ip))
    valid = ranges.filter(F.col("_net").isNotNull() & F.col("_bits").between(0, 32)).select(
        by, "_bits", (F.col("_net") - F.col("_net") % size).alias("_base")).distinct()
    if not fits_broadcast(entries, broadcast_rows):
        some = entries.where(F.col(by).isNotNull()).select(by).distinct().select(by, F.lit(-1).cast("bigint").alias("_at"), F.lit(-1).cast("bigint").alias("_end"))
        width = F.pow(F.lit(2.0), 32 - F.col("_bits")).cast("bigint")
        starts = valid.where(F.col(by).isNotNull()).select(by, F.col("_base").alias("_at"), (F.col("_base") + width - 1).alias("_end")).union(some)
        found = ordered.as_of(log.withColumn("_at", F.coalesce(address, F.lit(1 << 33))), starts, [by], "_at", "_end", "_reach")
        return found.withColumn("ip_allowed", F.when(F.col("_reach").isNull(), True).when(address.isNull(), False).otherwise(
            F.col("_reach") >= address)).drop("_at", "_reach")
    per_key = entries.groupBy(by).agg(F.count(F.lit(1)).alias("_entries"))
    masks = valid.groupBy(by).agg(F.collect_set(F.struct("_bits", "_base")).alias("_ranges"))
    side = per_key.join(masks, by, "left")

    def covers(r: Column) -> Column:
        width = F.pow(F.lit(2.0), 32 - r["_bits"]).cast("bigint")
        return address - F.pmod(address, width) == r["_base"]

    hit = F.coalesce(F.exists("_ranges", covers), F.lit(False))
    return (log.join(small_side(side), by, "left")
            .withColumn("ip_allowed", F.when(F.col("_entries").isNull(), True).when(address.isNull(), False).otherwise(hit))
            .drop("_entries", "_ranges"))


def residency_check(log: DataFrame, tenants: DataFrame, databases: DataFrame) -> DataFrame:
    """Add ``residency_ok``. ``tenants``: tenant_id, allowed_regions (array); ``databases``: database_name, region.
    An unknown tenant, database or an empty list is allowed."""
    out = log.join(small_side(tenants.select("tenant_id", "allowed_regions")), "tenant_id", "left").join(
        small_side(databases.select("database_name", "region")), "database_name", "left")
    ok = (F.col("allowed_regions").isNull() | (F.size("allowed_regions") == 0) | F.col("region").isNull()
          | F.array_contains("allowed_regions", F.col("region")))
    return out.withColumn("residency_ok", ok).drop("allowed_regions", "region")
