"""Registered queries: reports, behaviour, integrity and cost over the audit log."""

from __future__ import annotations

from pyspark.sql import functions as F

from govspark.operators import anomaly, compliance, cost, integrity, lineage, logs, ordered, reliability
from govspark.plans.fixtures import table, view
from govspark.plans.registry import QUERIES, query
from govspark.runtime import local_frame, shared_dir
from govspark.sources import audit_log

DAY, HOUR = 86_400_000_000, 3_600_000_000


# --- reading and writing the log ------------------------------------------------------------------

def as_audit(spark, d):
    """The audit view in the AUDIT layout (columns it has no value for stay absent)."""
    a = view(spark, d, "audit")
    return a.select(
        "audit_id", "sequence_num", F.col("ts").cast("timestamp").alias("ts"), F.col("user_name").alias("user"), F.array("role").alias("roles"),
        "tenant_id", "source_ip", F.when(F.col("k") % 9 != 0, F.col("database_name")).alias("database"),
        F.when(F.col("k") % 31 != 0, F.col("sql_text")).alias("sql"), "fingerprint_hash",
        F.when(F.col("k") % 12 == 0, "FROB").otherwise(F.col("statement_type")).alias("statement_type"),
        F.split("table_list", ",").alias("tables"), F.when(F.col("k") % 14 == 0, "MAYBE").otherwise(F.col("decision")).alias("decision"),
        "matched_policy", "execution_time_us")


_READ = """SELECT audit_id, user_name AS "user", CASE WHEN k % 9 <> 0 THEN database_name ELSE 'default' END AS "database", sql_text AS "sql",
 CASE WHEN k % 12 = 0 THEN 'UNKNOWN' ELSE statement_type END AS statement_type, CASE WHEN k % 14 = 0 THEN 'BLOCK' ELSE decision END AS decision,
 role, execution_time_us, ts_us FROM {audit} WHERE k % 31 <> 0"""


@query("read_audit_log", _READ)
def read_audit_log(spark, d):
    path = shared_dir(spark, "audit-log")
    audit_log.write_audit_log(as_audit(spark, d), path)
    r = audit_log.read_audit_log(spark, path)
    return r.select("audit_id", "user", "database", "sql", "statement_type", "decision", F.element_at("roles", 1).alias("role"),
                    "execution_time_us", F.unix_micros("ts").alias("ts_us"))


@query("write_audit_log", """SELECT cast(ts AS date)::VARCHAR AS day, count(*) AS rows_written, count(*) FILTER (WHERE k % 9 = 0) AS without_database,
 cast(sum(execution_time_us) AS bigint) AS total_us FROM {audit} GROUP BY 1""")
def write_audit_log(spark, d):
    path = shared_dir(spark, "audit-out")
    audit_log.write_audit_log(as_audit(spark, d), path, max_records=5000)
    return spark.read.json(path, schema="database string, execution_time_us bigint, date date").groupBy(F.col("date").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("rows_written"), F.count_if(F.col("database").isNull()).alias("without_database"),
        F.sum("execution_time_us").alias("total_us"))


# --- named views and counters ---------------------------------------------------------------------

def _log(spark, d):
    parts = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, ","))
    return view(spark, d, "audit").withColumn("tables", parts("table_list")).withColumn("columns_filtered", parts("filter_list")).withColumn(
        "classifications", F.when(F.col("k") % 5 == 0, F.array(F.lit("PII.Email"))).otherwise(F.array().cast("array<string>")))


@query("audit_views", """SELECT 'user_history' AS view_name, audit_id FROM {audit} WHERE user_name = 'u3'
 UNION ALL SELECT 'denied', audit_id FROM {audit} WHERE decision = 'BLOCK' UNION ALL SELECT 'pii_access', audit_id FROM {audit} WHERE k % 5 = 0
 UNION ALL SELECT 'by_table', audit_id FROM {audit} WHERE table_list LIKE '%orders%' UNION ALL SELECT 'by_fingerprint', audit_id FROM {audit} WHERE fingerprint_hash = 42
 UNION ALL SELECT 'rate_limited', audit_id FROM {audit} WHERE rate_limited UNION ALL SELECT 'failed', audit_id FROM {audit} WHERE NOT execution_success""")
def audit_views(spark, d):
    log, out = _log(spark, d), None
    for name, value in (("user_history", "u3"), ("denied", None), ("pii_access", None), ("by_table", "orders"), ("by_fingerprint", 42),
                        ("rate_limited", None), ("failed", None)):
        part = logs.audit_view(log, name, value).select(F.lit(name).alias("view_name"), "audit_id")
        out = part if out is None else out.unionByName(part)
    return out


@query("request_counters", """SELECT coalesce(database_name, '*') AS database_name, coalesce(user_name, '*') AS user_name, coalesce(decision, '*') AS decision,
 count(*) AS requests, count(*) FILTER (WHERE rate_limited) AS rate_limited, count(*) FILTER (WHERE error_code <> 'NONE') AS errors
 FROM {audit} GROUP BY ROLLUP (database_name, user_name, decision)""")
def request_counters(spark, d):
    return logs.request_counters(view(spark, d, "audit"))


@query("slow_queries", "SELECT audit_id, user_name, execution_time_us, ts_us FROM {audit} WHERE execution_time_us >= 150000 ORDER BY ts_us DESC, audit_id DESC LIMIT 100")
def slow_queries(spark, d):
    return logs.slow_queries(view(spark, d, "audit"), 150_000, 100).select("audit_id", "user_name", "execution_time_us", "ts_us")


@query("index_advice", """SELECT tbl AS table_name, cols AS filter_columns, count(*) AS occurrences, round(sum(execution_time_us) / count(*), 6) AS avg_us,
 concat('CREATE INDEX idx_', tbl, '_', replace(cols, ',', '_'), ' ON ', tbl, '(', replace(cols, ',', ', '), ')') AS suggested_ddl,
 concat('CLUSTERED BY (', replace(cols, ',', ', '), ')') AS suggested_layout
 FROM (SELECT unnest(string_split(table_list, ',')) AS tbl, CASE filter_list WHEN 'status,id' THEN 'id,status' ELSE filter_list END AS cols, execution_time_us
   FROM {audit} WHERE table_list <> '' AND filter_list <> '') x GROUP BY 1, 2 HAVING count(*) >= 3 ORDER BY occurrences DESC, 1, 2 LIMIT 50""")
def index_advice(spark, d):
    return logs.index_advice(_log(spark, d))


# --- lineage, catalog, compliance -----------------------------------------------------------------

@query("lineage_summary", """SELECT concat(database_name, '.', table_name, '.', column_name) AS column_key, arg_min(classification, audit_id) AS classification,
 count(*) AS total_accesses, count(*) FILTER (WHERE was_masked) AS masked_accesses, count(*) FILTER (WHERE NOT was_masked) AS unmasked_accesses,
 count(DISTINCT user_name) AS users, min(ts_us) AS first_access_us, max(ts_us) AS last_access_us FROM {lineage} GROUP BY database_name, table_name, column_name""")
def lineage_summary(spark, d):
    return lineage.lineage_summary(view(spark, d, "lineage"))


@query("pii_access_report", """SELECT o.*, t.column_accesses, t.column_masked, g.coverage_pct, access_count - masked_count AS unmasked_count
 FROM (SELECT user_name, database_name, table_name, column_name, min(classification) AS classification, count(*) AS access_count,
   count(*) FILTER (WHERE was_masked) AS masked_count, max(ts_us) AS last_access_us FROM {lineage} GROUP BY 1, 2, 3, 4) o
 JOIN (SELECT database_name AS dn, table_name AS tn, column_name AS cn, count(*) AS column_accesses, count(*) FILTER (WHERE was_masked) AS column_masked FROM {lineage} GROUP BY 1, 2, 3) t
 ON o.database_name = t.dn AND o.table_name = t.tn AND o.column_name = t.cn,
 (SELECT round(count(*) FILTER (WHERE was_masked) / count(*) * 100, 6) AS coverage_pct FROM {lineage}) g""")
def pii_access_report(spark, d):
    return lineage.pii_access_report(view(spark, d, "lineage")).withColumn("coverage_pct", F.round("coverage_pct", 6))


@query("lineage_events", "SELECT audit_id, user_name, table_name, column_name FROM {lineage} WHERE user_name = 'u3' AND table_name = 'orders' ORDER BY ts_us DESC, audit_id DESC LIMIT 100")
def lineage_events(spark, d):
    return lineage.lineage_events(view(spark, d, "lineage"), "u3", "orders").select("audit_id", "user_name", "table_name", "column_name")


@query("subject_access", "SELECT audit_id, table_name, column_name, classification, was_masked FROM {lineage} WHERE user_name = 'u5'")
def subject_access(spark, d):
    return lineage.subject_access(view(spark, d, "lineage"), "u5").select("audit_id", "table_name", "column_name", "classification", "was_masked")


_CATALOG = {
    "catalog": """SELECT table_name, column_name, arg_max(classification, confidence * 1000000000000 - audit_id) AS pii_type,
 arg_max(strategy, confidence * 1000000000000 - audit_id) AS strategy, cast(max(confidence) AS double) AS confidence, count(*) AS accesses,
 count(*) FILTER (WHERE was_masked) AS masked, count(DISTINCT user_name) AS users, min(ts_us) AS first_seen_us, max(ts_us) AS last_seen_us
 FROM {lineage} GROUP BY table_name, column_name""",
    "seeds": """SELECT DISTINCT p_brand AS table_name, concat('col_', cast(p_partkey AS string)) AS column_name FROM part
 UNION SELECT DISTINCT table_name, column_name FROM {lineage}""",
}


def _catalog(spark, d):
    return lineage.catalog_columns(view(spark, d, "lineage")).withColumn("confidence", F.col("confidence").cast("double"))


def _seeded(spark, d):
    snapshot = table(spark, d, "part").select(F.col("p_brand").alias("table_name"), F.concat(F.lit("col_"), F.col("p_partkey").cast("string")).alias("column_name"))
    return lineage.catalog_with_snapshot(_catalog(spark, d), snapshot)


@query("catalog_columns", "SELECT * FROM {catalog}", _CATALOG)
def catalog_columns(spark, d):
    return _catalog(spark, d)


@query("catalog_tables", """SELECT table_name, cast(sum(accesses) AS bigint) AS accesses, string_agg(column_name, ',' ORDER BY column_name) AS columns,
 min(first_seen_us) AS first_seen_us, max(last_seen_us) AS last_seen_us FROM {catalog} GROUP BY table_name""", _CATALOG)
def catalog_tables(spark, d):
    return lineage.catalog_tables(_catalog(spark, d))


@query("catalog_stats", """SELECT count(DISTINCT s.table_name) AS tables, count(*) AS columns, count(c.pii_type) AS pii_columns, cast(coalesce(sum(c.accesses), 0) AS bigint) AS recorded
 FROM {seeds} s LEFT JOIN {catalog} c ON s.table_name = c.table_name AND s.column_name = c.column_name""", _CATALOG)
def catalog_stats(spark, d):
    return lineage.catalog_stats(_seeded(spark, d))


@query("catalog_search", """SELECT 'text' AS search, table_name, column_name FROM {seeds} WHERE lower(table_name) LIKE '%#1%' OR lower(column_name) LIKE '%#1%'
 UNION ALL SELECT 'type', table_name, column_name FROM {catalog} WHERE pii_type = 'PII.Email'""".replace("#1", "l_11"), _CATALOG)
def catalog_search(spark, d):
    seeded = _seeded(spark, d)
    by_text = lineage.catalog_search(seeded, text="L_11").select(F.lit("text").alias("search"), "table_name", "column_name")
    return by_text.unionByName(lineage.catalog_search(seeded, pii_type="PII.Email").select(F.lit("type").alias("search"), "table_name", "column_name"))


@query("unclassified_columns", """SELECT table_name, column_name FROM {snapshot_a} s WHERE NOT EXISTS (SELECT 1 FROM part p
 WHERE p.p_brand = s.table_name AND concat('col_', cast(p.p_partkey AS string)) = s.column_name AND p.p_type LIKE '%STEEL%')""")
def unclassified_columns(spark, d):
    known = table(spark, d, "part").select(F.col("p_brand").alias("table_name"), F.concat(F.lit("col_"), F.col("p_partkey").cast("string")).alias("column_name"),
                                           F.when(F.col("p_type").contains("STEEL"), "PII.Email").alias("pii_type"))
    return lineage.unclassified_columns(view(spark, d, "snapshot_a"), known).select("table_name", "column_name")


_SUMMARY = """count(*) AS total_queries, count(*) FILTER (WHERE decision = 'BLOCK') AS blocked_queries,
 count(*) FILTER (WHERE threat_level IN ('HIGH', 'CRITICAL')) AS injection_attempts, count(*) FILTER (WHERE anomaly_score >= 0.5) AS anomalies_detected,
 count(*) FILTER (WHERE rate_limited) AS rate_limited_requests, count(DISTINCT user_name) AS tracked_users"""


@query("security_summary", f"""SELECT s.*, l.pii_accesses, l.coverage_pct FROM (SELECT {_SUMMARY} FROM {{audit}}) s,
 (SELECT count(*) AS pii_accesses, round(count(*) FILTER (WHERE was_masked) / count(*) * 100, 6) AS coverage_pct FROM {{lineage}}) l""")
def security_summary(spark, d):
    events = view(spark, d, "lineage")
    return compliance.security_summary(view(spark, d, "audit")).withColumns({
        "pii_accesses": events.agg(F.count(F.lit(1))).scalar(),
        "coverage_pct": events.agg(F.round(lineage.coverage(F.count_if("was_masked"), F.count(F.lit(1))), 6)).scalar()})


@query("tenant_rollup", f"SELECT tenant_id, {_SUMMARY} FROM {{audit}} GROUP BY tenant_id")
def tenant_rollup(spark, d):
    return compliance.security_summary(view(spark, d, "audit"), ["tenant_id"])


_SECTION = {
    "sec": f"SELECT {_SUMMARY} FROM {{audit}}",
    "cols": "SELECT concat(database_name, '.', table_name, '.', column_name) AS metric, count(*) AS total, count(*) FILTER (WHERE was_masked) AS masked FROM {lineage} GROUP BY 1",
    "pii": "SELECT count(*) AS n, cast(sum(total) AS double) AS total, cast(sum(masked) AS double) AS masked FROM {cols}",
    "summary": """SELECT 'summary' AS section, 'total_queries' AS metric, cast(total_queries AS double) AS value, NULL AS status FROM {sec}
 UNION ALL SELECT 'summary', 'tracked_users', tracked_users, NULL FROM {sec}""",
    "security_events": """SELECT 'security_events' AS section, 'injection_attempts' AS metric, cast(injection_attempts AS double) AS value, CASE WHEN injection_attempts > 0 THEN 'warn' ELSE 'pass' END AS status FROM {sec}
 UNION ALL SELECT 'security_events', 'anomalies_detected', anomalies_detected, CASE WHEN anomalies_detected > 10 THEN 'warn' ELSE 'pass' END FROM {sec}
 UNION ALL SELECT 'security_events', 'rate_limited_requests', rate_limited_requests, CASE WHEN rate_limited_requests > 100 THEN 'warn' ELSE 'pass' END FROM {sec}
 UNION ALL SELECT 'security_events', 'blocked_queries', blocked_queries, 'Enforced' FROM {sec}""",
    "access_controls": "SELECT 'access_controls' AS section, metric, cast(total AS double) AS value, CASE WHEN masked = total THEN 'masked' ELSE 'exposed' END AS status FROM {cols}",
    "audit_integrity": """SELECT 'audit_integrity' AS section, 'broken_links' AS metric, cast(r.n + g.n AS double) AS value, CASE WHEN r.n + g.n = 0 THEN 'Intact' ELSE 'Gaps detected' END AS status FROM
 (SELECT count(*) AS n FROM (SELECT k, lag(k) OVER (PARTITION BY user_id % 16, sequence_num - sequence_num % 1024 ORDER BY sequence_num) AS before FROM {audit}) x WHERE k <> 13 AND (k IN (55, 97) OR before IN (13, 55))) r,
 (SELECT count(*) AS n FROM (SELECT removed, final, lag(final, 1, 0) OVER (PARTITION BY chain_id ORDER BY segment) AS before FROM (SELECT user_id % 16 AS chain_id, sequence_num - sequence_num % 1024 AS segment,
   count(*) FILTER (WHERE k = 13) AS removed, arg_max(k, sequence_num) AS final FROM {audit} GROUP BY 1, 2) s) c WHERE removed > 0 OR final = 55 OR before IN (13, 55)) g""",
    "pii_inventory": """SELECT 'pii_inventory' AS section, 'pii_columns' AS metric, cast(n AS double) AS value, NULL AS status FROM {pii}
 UNION ALL SELECT 'pii_inventory', 'pii_accesses', total, NULL FROM {pii} UNION ALL SELECT 'pii_inventory', 'masked', masked, NULL FROM {pii}
 UNION ALL SELECT 'pii_inventory', 'unmasked', total - masked, NULL FROM {pii}""",
    "masking_coverage": """SELECT 'masking_coverage' AS section, 'coverage_pct' AS metric, round(masked / total * 100, 6) AS value,
 CASE WHEN masked / total * 100 >= 95 THEN 'Excellent' WHEN masked / total * 100 >= 80 THEN 'Needs Improvement' ELSE 'Critical' END AS status FROM {pii}""",
}


def _register_reports() -> None:
    for kind, sections in compliance.SECTIONS.items():
        sql = " UNION ALL ".join(f"SELECT * FROM {{{s}}}" for s in sections)

        def report(spark, d, kind=kind):
            broken = integrity.broken(_tampered(spark, d), integrity.anchors(_sealed(spark, d), "chain_id"), "chain_id")
            return compliance.compliance_report(kind, view(spark, d, "audit"), view(spark, d, "lineage"), broken)
        query(f"compliance_report_{kind.lower()}", sql, _SECTION)(report)
    every = " UNION ALL ".join(f"SELECT '{kind}' AS report, * FROM {{{s}}}" for kind, sections in compliance.SECTIONS.items() for s in sections)

    def reports(spark, d):
        out = None
        for kind in compliance.SECTIONS:
            one = QUERIES[f"compliance_report_{kind.lower()}"](spark, d).select(F.lit(kind).alias("report"), "*")
            out = one if out is None else out.unionByName(one)
        return out
    query("compliance_report", every, _SECTION)(reports)


# --- behaviour ------------------------------------------------------------------------------------

AFTER = 20  # warm-up queries; small so that the small scale factors have warmed-up users

_SEEN = {
    "numbered": "SELECT *, row_number() OVER (PARTITION BY user_name ORDER BY ts_us, audit_id) AS n FROM {audit}",
    "touched": """SELECT audit_id, user_name, ts_us, n, unnest(string_split(table_list, ',')) AS tbl FROM {numbered} WHERE table_list <> ''""",
    "new_table": f"""SELECT audit_id, user_name, ts_us, concat('NEW_TABLE:', tbl) AS anomaly, 0.3 AS score FROM (
  SELECT DISTINCT *, min(n) OVER (PARTITION BY user_name, tbl) AS first_n FROM {{touched}}) x WHERE n = first_n AND n > {AFTER}""",
    "new_pattern": f"""SELECT audit_id, user_name, ts_us, 'NEW_QUERY_PATTERN' AS anomaly, 0.2 AS score FROM (
  SELECT *, min(n) OVER (PARTITION BY user_name, fingerprint_hash) AS first_n FROM {{numbered}} WHERE fingerprint_hash <> 0) x WHERE n = first_n AND n > {AFTER}""",
    "new_hour": f"""SELECT audit_id, user_name, ts_us, concat('UNUSUAL_HOUR:', cast(h AS string)) AS anomaly, 0.2 AS score FROM (
  SELECT *, min(n) OVER (PARTITION BY user_name, h) AS first_n FROM (SELECT *, extract(hour FROM ts) AS h FROM {{numbered}}) y) x WHERE n = first_n AND n > {AFTER}""",
    "windows": f"""SELECT user_name, ts_us - ts_us % {DAY} AS window_us, count(*) AS queries FROM {{audit}} GROUP BY 1, 2""",
    "baselines": """SELECT *, count(*) OVER w AS baseline_windows, avg(queries) OVER w AS m, stddev_pop(queries) OVER w AS s,
  cast(sum(queries) OVER w AS bigint) AS total, cast(sum(queries * queries) OVER w AS bigint) AS squares FROM {windows}
  WINDOW w AS (PARTITION BY user_name ORDER BY window_us ROWS BETWEEN 288 PRECEDING AND 1 PRECEDING)""",
    "volume": f"""SELECT audit_id, user_name, ts_us, 'VOLUME_SPIKE' AS anomaly, 0.4 AS score FROM (
  SELECT a.audit_id, a.user_name, a.ts_us, b.baseline_windows AS w, b.total, b.squares, row_number() OVER (PARTITION BY a.user_name, b.window_us ORDER BY a.ts_us, a.audit_id) - 1 AS c
  FROM {{audit}} a JOIN {{baselines}} b ON a.user_name = b.user_name AND a.ts_us - a.ts_us % {DAY} = b.window_us
  WHERE b.baseline_windows >= 2) x WHERE w * c > total AND (w * c - total) * (w * c - total) > 2.25 * (w * squares - total * total) AND w * squares > total * total""",
    "parts": "SELECT * FROM {new_table} UNION ALL SELECT * FROM {new_pattern} UNION ALL SELECT * FROM {new_hour} UNION ALL SELECT * FROM {volume}",
}


def _profile(spark, d):
    return _log(spark, d).select("audit_id", "user_name", "ts_us", F.array_distinct("tables").alias("tables"), "fingerprint_hash")


@query("anomaly_new_table", "SELECT audit_id, user_name, ts_us, anomaly, cast(score AS double) AS score FROM {new_table}", _SEEN)
def anomaly_new_table(spark, d):
    return anomaly.new_tables(_profile(spark, d), AFTER)


@query("anomaly_new_pattern", "SELECT audit_id, user_name, ts_us, anomaly, cast(score AS double) AS score FROM {new_pattern}", _SEEN)
def anomaly_new_pattern(spark, d):
    return anomaly.new_patterns(_profile(spark, d), AFTER)


@query("anomaly_unusual_hour", "SELECT audit_id, user_name, ts_us, anomaly, cast(score AS double) AS score FROM {new_hour}", _SEEN)
def anomaly_unusual_hour(spark, d):
    return anomaly.unusual_hours(_profile(spark, d), AFTER)


@query("anomaly_volume", """SELECT user_name, window_us, queries, baseline_windows, CASE WHEN baseline_windows >= 2 THEN round(m, 6) END AS mean_queries,
 CASE WHEN baseline_windows >= 2 THEN round(s, 6) END AS sd_queries, coalesce(baseline_windows >= 2 AND baseline_windows * squares > total * total AND baseline_windows * queries > total
 AND (baseline_windows * queries - total) * (baseline_windows * queries - total) > 2.25 * (baseline_windows * squares - total * total), false) AS spike FROM {baselines}""", _SEEN)
def anomaly_volume(spark, d):
    out = anomaly.volume_windows(view(spark, d, "audit"), DAY, 288, 1.5)
    return out.select("user_name", "window_us", "queries", "baseline_windows", F.round("mean_queries", 6).alias("mean_queries"),
                      F.round("sd_queries", 6).alias("sd_queries"), "spike")


@query("anomaly_score", """SELECT audit_id, user_name, cast(least(1.0, round(sum(score), 6)) AS double) AS anomaly_score, string_agg(anomaly, ',' ORDER BY anomaly) AS anomalies,
 sum(score) >= 0.5 AS is_anomalous FROM {parts} GROUP BY audit_id, user_name""", _SEEN)
def anomaly_score(spark, d):
    return anomaly.anomaly_scores(_profile(spark, d), AFTER, DAY, 288, 1.5)


# --- integrity ------------------------------------------------------------------------------------

SEGMENT = 1024

_CHAINS = {
    "links": f"""SELECT user_id % 16 AS chain_id, sequence_num, sequence_num - sequence_num % {SEGMENT} AS segment,
  concat_ws('|', cast(sequence_num AS string), cast(ts_us AS string), user_name, sql_text, decision) AS body,
  row_number() OVER (PARTITION BY user_id % 16, sequence_num - sequence_num % {SEGMENT} ORDER BY sequence_num) AS n FROM {{audit}}""",
}
_SEAL_SQL = """WITH RECURSIVE sealed AS (
 SELECT chain_id, segment, sequence_num, n, '' AS previous_hash, sha256(concat(body, '|')) AS record_hash FROM {links} WHERE n = 1
 UNION ALL SELECT l.chain_id, l.segment, l.sequence_num, l.n, s.record_hash, sha256(concat(l.body, '|', s.record_hash))
 FROM sealed s JOIN {links} l ON l.chain_id = s.chain_id AND l.segment = s.segment AND l.n = s.n + 1)
"""


def _chained(spark, d):
    return view(spark, d, "audit").select((F.col("user_id") % 16).alias("chain_id"), "sequence_num", "ts_us", "user_name", "sql_text", "decision", "k")


def _sealed(spark, d):
    return integrity.seal(_chained(spark, d), "chain_id", SEGMENT)


def _tampered(spark, d):
    """A sealed log in which rows with k = 97 were edited, k = 13 removed, k = 55 never sealed."""
    s = _sealed(spark, d).filter("k <> 13")
    return (s.withColumn("sql_text", F.when(F.col("k") == 97, F.concat("sql_text", F.lit(" "))).otherwise(F.col("sql_text")))
            .withColumn("record_hash", F.when(F.col("k") != 55, F.col("record_hash"))))


@query("hash_chain_seal", _SEAL_SQL + "SELECT chain_id, segment, sequence_num, previous_hash, record_hash FROM sealed", _CHAINS)
def hash_chain_seal(spark, d):
    return _sealed(spark, d).select("chain_id", "segment", "sequence_num", "previous_hash", "record_hash")


_VERIFY_SQL = _SEAL_SQL + """, kept AS (SELECT s.*, a.k, lag(CASE WHEN a.k <> 55 THEN s.record_hash END) OVER (PARTITION BY s.chain_id, s.segment ORDER BY s.sequence_num) AS prior
  FROM sealed s JOIN {audit} a ON a.sequence_num = s.sequence_num WHERE a.k <> 13)
SELECT chain_id, sequence_num, CASE WHEN k = 55 THEN 'unsealed' WHEN k = 97 THEN 'bad_hash' WHEN previous_hash <> coalesce(prior, '') THEN 'bad_link' ELSE 'ok' END AS status FROM kept"""


@query("hash_chain_verify", _VERIFY_SQL, _CHAINS)
def hash_chain_verify(spark, d):
    return integrity.verify(_tampered(spark, d), "chain_id").select("chain_id", "sequence_num", "status")


@query("hash_chain_anchors", _SEAL_SQL + """, segs AS (SELECT chain_id, segment, count(*) AS n, arg_max(record_hash, sequence_num) AS last_hash FROM sealed GROUP BY 1, 2)
SELECT chain_id, segment, n AS rows, last_hash, sha256(concat(segment, '|', n, '|', last_hash, '|', lag(last_hash, 1, '') OVER (PARTITION BY chain_id ORDER BY segment))) AS anchor_hash FROM segs""", _CHAINS)
def hash_chain_anchors(spark, d):
    return integrity.anchors(_sealed(spark, d), "chain_id")


@query("hash_chain_tails", f"""WITH segs AS (SELECT user_id % 16 AS chain_id, sequence_num - sequence_num % {SEGMENT} AS segment, count(*) AS n FROM {{audit}} GROUP BY 1, 2)
SELECT chain_id, segment, CASE WHEN segment <> max(segment) OVER (PARTITION BY chain_id) THEN 'ok' WHEN n = 1 THEN 'missing_segment' ELSE 'changed' END AS status FROM segs""")
def hash_chain_tails(spark, d):
    """Every chain's last row is cut off after sealing; only the anchors tell."""
    sealed = _sealed(spark, d)
    final = sealed.groupBy("chain_id").agg(F.max("sequence_num").alias("final"))
    cut = sealed.join(final, "chain_id").filter("sequence_num < final").drop("final")
    return integrity.verify_anchors(cut, integrity.anchors(sealed, "chain_id"), "chain_id")


@query("hash_tree_roots", _SEAL_SQL + """, folded AS (SELECT chain_id, segment, list(record_hash ORDER BY n) AS h FROM sealed GROUP BY 1, 2 UNION ALL
 SELECT chain_id, segment, list_transform(range(1, (len(h) + 1) // 2 + 1), lambda i: CASE WHEN 2 * i <= len(h) THEN sha256(concat(h[2 * i - 1], h[2 * i])) ELSE h[2 * i - 1] END) FROM folded WHERE len(h) > 1)
SELECT chain_id, segment, h[1] AS root_hash FROM folded WHERE len(h) = 1""", _CHAINS)
def hash_tree_roots(spark, d):
    return integrity.tree_roots(integrity.hash_tree(_sealed(spark, d), "chain_id"), "chain_id")


@query("sequence_gaps", """SELECT prev + 1 AS gap_start, sequence_num - 1 AS gap_end, sequence_num - prev - 1 AS missing FROM (
 SELECT sequence_num, lag(sequence_num) OVER (ORDER BY sequence_num) AS prev FROM {audit} WHERE event_type <> 'signup') x WHERE sequence_num - prev > 1""")
def sequence_gaps(spark, d):
    return integrity.sequence_gaps(view(spark, d, "audit").filter("event_type <> 'signup'"), [])


# --- failures and load ----------------------------------------------------------------------------

@query("outage_episodes", """SELECT database_name, count(*) AS failures, min(ts_us) AS start_us, max(ts_us) AS end_us FROM (
 SELECT *, count(*) FILTER (WHERE execution_success) OVER (PARTITION BY database_name ORDER BY ts_us, audit_id) AS run FROM {audit}) x
 WHERE NOT execution_success AND lower(error_message) LIKE '%connection refused%' GROUP BY database_name, run HAVING count(*) >= 2""")
def outage_episodes(spark, d):
    return reliability.outage_episodes(view(spark, d, "audit"), 2)


@query("lockout_candidates", f"""SELECT * FROM (SELECT audit_id, ts_us, kind, key, count(*) OVER (PARTITION BY kind, key ORDER BY ts_us RANGE BETWEEN {6 * HOUR} PRECEDING AND CURRENT ROW) AS failures
 FROM (SELECT audit_id, ts_us, 'ip' AS kind, source_ip AS key FROM {{auth_log}} WHERE NOT success UNION ALL SELECT audit_id, ts_us, 'user', user_name FROM {{auth_log}} WHERE NOT success) a) x
 WHERE failures >= 3""")
def lockout_candidates(spark, d):
    return reliability.lockout_candidates(view(spark, d, "auth_log"), 3, 6 * HOUR).select("audit_id", "ts_us", "kind", "key", "failures")


@query("latency_histogram", f"""SELECT window_us, n, b0, b1, b2, b3, b4, p95_ms, CASE WHEN p95_ms >= 200 THEN 'PROTECT' WHEN p95_ms >= 50 THEN 'THROTTLE' ELSE 'NORMAL' END AS mode,
 CASE WHEN p95_ms >= 200 THEN 100 WHEN p95_ms >= 50 THEN 400 ELSE 1000 END AS recommended_tps FROM (
 SELECT *, CASE WHEN b0 >= need THEN 5 WHEN b0 + b1 >= need THEN 30 WHEN b0 + b1 + b2 >= need THEN 125 WHEN b0 + b1 + b2 + b3 >= need THEN 600 ELSE 2000 END AS p95_ms FROM (
 SELECT ts_us - ts_us % {HOUR} AS window_us, count(*) AS n, (count(*) * 95 + 99) // 100 AS need, count(*) FILTER (WHERE execution_time_us < 10000) AS b0,
 count(*) FILTER (WHERE execution_time_us >= 10000 AND execution_time_us < 50000) AS b1, count(*) FILTER (WHERE execution_time_us >= 50000 AND execution_time_us < 200000) AS b2,
 count(*) FILTER (WHERE execution_time_us >= 200000 AND execution_time_us < 1000000) AS b3, count(*) FILTER (WHERE execution_time_us >= 1000000) AS b4 FROM {{audit}} GROUP BY 1) h) p""")
def latency_histogram(spark, d):
    return reliability.latency_histogram(view(spark, d, "audit"))


@query("span_breakdown", """SELECT op, count(*) AS spans, round(sum(dur_us) / count(*), 6) AS avg_us, min(dur_us) FILTER (WHERE rn >= ceil(n * 95 / 100.0)) AS p95_us FROM (
 SELECT *, row_number() OVER (PARTITION BY op ORDER BY dur_us) AS rn, count(*) OVER (PARTITION BY op) AS n FROM (
 SELECT 'execute' AS op, execution_time_us AS dur_us FROM {audit} UNION ALL SELECT 'parse', k * 10 FROM {audit} UNION ALL SELECT 'policy', cost_cents % 977 FROM {audit} WHERE k % 2 = 0) s) x GROUP BY op""")
def span_breakdown(spark, d):
    span = lambda op, us: F.struct(F.lit("s").alias("id"), F.lit(op).alias("op"), us.cast("bigint").alias("dur_us"))
    spans = F.array_compact(F.array(span("execute", F.col("execution_time_us")), span("parse", F.col("k") * 10),
                                    F.when(F.col("k") % 2 == 0, span("policy", F.col("cost_cents") % 977))))
    return reliability.span_breakdown(view(spark, d, "audit").select(spans.alias("spans")))


_TOKENS = "CASE priority WHEN 'LOW' THEN 2 WHEN 'BACKGROUND' THEN 4 ELSE 1 END"


@query("usage_rollup", f"""SELECT window_us, level, key, tokens, token_limit FROM (SELECT window_us, level, key, cast(sum(tokens) AS bigint) AS tokens,
 cast(CASE level WHEN 'database' THEN CASE key WHEN 'testdb' THEN 5 ELSE 4 END WHEN 'user' THEN 2 ELSE 1 END AS bigint) AS token_limit FROM (
 SELECT ts_us - ts_us % 1000000 AS window_us, 'user' AS level, user_name AS key, {_TOKENS} AS tokens FROM {{audit}}
 UNION ALL SELECT ts_us - ts_us % 1000000, 'database', database_name, {_TOKENS} FROM {{audit}}
 UNION ALL SELECT ts_us - ts_us % 1000000, 'user_database', concat(user_name, ':', database_name), {_TOKENS} FROM {{audit}}) x GROUP BY 1, 2, 3) y WHERE tokens > token_limit""")
def usage_rollup(spark, d):
    limits = local_frame(spark, [("user", "*", 5), ("database", "*", 8), ("database", "testdb", 10), ("user_database", "*", 1)],
                                   "level string, key string, tokens_per_second int")
    return reliability.usage_rollup(view(spark, d, "audit"), limits, nodes=2)


@query("usage_rollup_global", f"""SELECT window_us, 'global' AS level, 'all' AS key, tokens, cast(3 AS bigint) AS token_limit FROM (
 SELECT ts_us - ts_us % 1000000 AS window_us, cast(sum({_TOKENS}) AS bigint) AS tokens FROM {{audit}} GROUP BY 1) y WHERE tokens > 3""")
def usage_rollup_global(spark, d):
    limits = local_frame(spark, [("global", "*", 6)], "level string, key string, tokens_per_second int")
    return reliability.usage_rollup(view(spark, d, "audit"), limits, nodes=2)


RULES = [
    {"name": "rate_limits", "condition": "rate_limit_breach", "threshold": 7, "window_us": 12 * HOUR, "cooldown_us": 12 * HOUR},
    {"name": "denials", "condition": "policy_violation_spike", "threshold": 8, "window_us": 6 * HOUR, "cooldown_us": 24 * HOUR},
    {"name": "breaker", "condition": "circuit_breaker_open", "threshold": 6, "window_us": 6 * HOUR, "cooldown_us": 12 * HOUR},
    {"name": "pii", "condition": "pii_exposure_spike", "threshold": 12, "window_us": 12 * HOUR, "cooldown_us": 12 * HOUR},
    {"name": "overflow", "condition": "audit_buffer_overflow", "threshold": 19, "window_us": 6 * HOUR, "cooldown_us": 12 * HOUR},
    {"name": "custom", "condition": "custom_metric", "threshold": 9, "window_us": 6 * HOUR, "cooldown_us": 12 * HOUR},
]
_MEASURES = {"rate_limits": "count(*) FILTER (WHERE rate_limited)", "denials": "count(*) FILTER (WHERE decision = 'BLOCK')",
             "breaker": "count(*) FILTER (WHERE lower(error_message) LIKE '%connection refused%')", "pii": "count(*) FILTER (WHERE exposed)",
             "overflow": "cast(sum(lost) AS bigint)", "custom": "count(*) FILTER (WHERE cost_cents > 9000)"}
# The log without its signups: what they leave are gaps in the sequence numbers.
ALERT_SQL = {
    "alert_log": """SELECT a.*, coalesce(sequence_num - lag(sequence_num) OVER (ORDER BY sequence_num) - 1, 0) AS lost, audit_id IN (SELECT audit_id FROM {lineage} WHERE NOT was_masked) AS exposed
  FROM {audit} a WHERE event_type <> 'signup'""",
    "rule_counts": " UNION ALL ".join(f"SELECT '{r['name']}' AS rule, ts_us - ts_us % {r['window_us']} AS window_us, {_MEASURES[r['name']]} AS value, {r['threshold']} AS threshold FROM {{alert_log}} GROUP BY 2" for r in RULES),
}


def alert_log(log, lineage_rows):
    """The log with what alert conditions ask for: exposure by lineage, a metric of its own."""
    kept = log.where("event_type <> 'signup'").select(
        "audit_id", "sequence_num", "ts_us", F.col("ts").cast("timestamp").alias("ts"), "rate_limited", "decision", "error_code", "execution_success", "error_message",
        (F.col("cost_cents") > 9000).alias("metric_hit"))
    return reliability.with_exposure(kept, lineage_rows)


@query("alert_episodes", """SELECT rule, window_us, value, CASE WHEN breach THEN 'fired' ELSE 'resolved' END AS event FROM (
 SELECT *, value >= threshold AS breach, lag(value >= threshold, 1, false) OVER (PARTITION BY rule ORDER BY window_us) AS before FROM {rule_counts}) x WHERE breach <> before""", ALERT_SQL)
def alert_episodes(spark, d):
    return reliability.alert_episodes(reliability.alert_counts(reliability.with_lost_events(alert_log(view(spark, d, "audit"), view(spark, d, "lineage"))), RULES))


# --- cost -----------------------------------------------------------------------------------------

BUDGET_SQL = {
    "budgets": """SELECT concat('u', cast(c_custkey AS string)) AS user_name, 15000 + 1000 * (c_nationkey % 5) AS daily_cents,
  CASE WHEN c_nationkey % 4 = 0 THEN 0 ELSE 9000 END AS hourly_cents FROM customer""",
    "limited": f"""SELECT a.audit_id, a.user_name, a.ts_us, a.cost_cents, coalesce(b.daily_cents, 20000) AS daily, coalesce(b.hourly_cents, 8000) AS hourly,
  a.ts_us - a.ts_us % {DAY} AS d, a.ts_us - a.ts_us % {HOUR} AS h, row_number() OVER (PARTITION BY a.user_name ORDER BY a.ts_us, a.audit_id) AS n
  FROM {{audit}} a LEFT JOIN {{budgets}} b ON a.user_name = b.user_name""",
}
BUDGET_RUN = """WITH RECURSIVE admitted AS (
 SELECT audit_id, user_name, d, h, n, cost_cents AS day_cost, cost_cents AS hour_cost, 'admitted' AS outcome FROM {limited} WHERE n = 1
 UNION ALL SELECT l.audit_id, l.user_name, l.d, l.h, l.n,
  CASE WHEN l.d = p.d THEN p.day_cost ELSE 0 END + CASE WHEN ((l.daily > 0 AND CASE WHEN l.d = p.d THEN p.day_cost ELSE 0 END >= l.daily)
    OR (l.hourly > 0 AND CASE WHEN l.h = p.h THEN p.hour_cost ELSE 0 END >= l.hourly)) THEN 0 ELSE l.cost_cents END,
  CASE WHEN l.h = p.h THEN p.hour_cost ELSE 0 END + CASE WHEN ((l.daily > 0 AND CASE WHEN l.d = p.d THEN p.day_cost ELSE 0 END >= l.daily)
    OR (l.hourly > 0 AND CASE WHEN l.h = p.h THEN p.hour_cost ELSE 0 END >= l.hourly)) THEN 0 ELSE l.cost_cents END,
  CASE WHEN l.daily > 0 AND CASE WHEN l.d = p.d THEN p.day_cost ELSE 0 END >= l.daily THEN 'daily_exceeded'
    WHEN l.hourly > 0 AND CASE WHEN l.h = p.h THEN p.hour_cost ELSE 0 END >= l.hourly THEN 'hourly_exceeded' ELSE 'admitted' END
 FROM admitted p JOIN {limited} l ON l.user_name = p.user_name AND l.n = p.n + 1)
"""


def budgets(spark, d):
    return table(spark, d, "customer").select(
        F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("user_name"), (15000 + 1000 * (F.col("c_nationkey") % 5)).alias("daily_cents"),
        F.when(F.col("c_nationkey") % 4 == 0, 0).otherwise(9000).alias("hourly_cents"))


@query("cost_by_user", f"""SELECT x.*, CASE WHEN period = 'day' THEN round(cost_cents / coalesce(b.daily_cents, 20000) * 100, 6) END AS budget_pct FROM (
 SELECT user_name, 'day' AS period, ts_us - ts_us % {DAY} AS start_us, cast(sum(cost_cents) AS bigint) AS cost_cents, count(*) AS queries FROM {{audit}} GROUP BY 1, 3
 UNION ALL SELECT user_name, 'hour', ts_us - ts_us % {HOUR}, cast(sum(cost_cents) AS bigint), count(*) FROM {{audit}} GROUP BY 1, 3) x LEFT JOIN {{budgets}} b ON x.user_name = b.user_name""", BUDGET_SQL)
def cost_by_user(spark, d):
    return cost.cost_by_user(view(spark, d, "audit"), budgets(spark, d), 20000)


@query("budget_breach", BUDGET_RUN + "SELECT audit_id, user_name, outcome FROM admitted", BUDGET_SQL)
def budget_breach(spark, d):
    log = view(spark, d, "audit").select("audit_id", "user_name", "ts_us", "cost_cents")
    return cost.budget_decisions(log, budgets(spark, d), 20000, 8000).select("audit_id", "user_name", "outcome")


@query("top_cost_queries", """SELECT audit_id, user_name, cost_cents, CASE WHEN length(s) > 200 THEN concat(left(s, 200), '...') ELSE s END AS sql_preview
 FROM (SELECT *, CASE WHEN k % 2 = 0 THEN repeat(sql_text, 9) ELSE sql_text END AS s FROM {audit}) x ORDER BY cost_cents DESC, audit_id LIMIT 50""")
def top_cost_queries(spark, d):
    log = view(spark, d, "audit").withColumn("sql_text", F.when(F.col("k") % 2 == 0, F.repeat("sql_text", F.lit(9))).otherwise(F.col("sql_text")))
    return cost.top_cost_queries(log)


_register_reports()
