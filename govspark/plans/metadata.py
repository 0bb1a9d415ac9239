"""Registered queries: schemas, classification of columns, ledgers, synthetic rows, user extensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from govspark.operators import classify, snapshots, synthetic
from govspark.plans.fixtures import table, view
from govspark.plans.registry import query
from govspark.plans.text import TESTS_SQL
from govspark.runtime import local_frame, shared_dir
from govspark.sources import audit_log

_SNAPSHOT_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"]
_COUNTS = " ".join(f"WHEN '{t}' THEN (SELECT count(*) FROM {t})" for t in _SNAPSHOT_TABLES)


@query("schema_snapshot", f"""SELECT 'main' AS schema_name, table_name, column_name, cast(ordinal_position AS int) AS ordinal,
 CASE data_type WHEN 'INTEGER' THEN 'int' WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE data_type END AS data_type,
 true AS nullable, CASE table_name {_COUNTS} END AS table_rows FROM (SELECT DISTINCT table_name, column_name, ordinal_position, data_type FROM information_schema.columns) c
 WHERE table_name IN ({', '.join(repr(t) for t in _SNAPSHOT_TABLES)})""")
def schema_snapshot(spark, d):
    """The snapshot beside each table's row count (counted from the tables)."""
    tables = {t: table(spark, d, t) for t in _SNAPSHOT_TABLES}
    counts = None
    for t, df in tables.items():
        n = df.agg(F.count(F.lit(1)).alias("table_rows")).select(F.lit(t).alias("table_name"), "table_rows")
        counts = n if counts is None else counts.unionByName(n)
    return snapshots.schema_snapshot(spark, tables).join(counts, "table_name")


def _case(column: str, mapping: dict[str, str], default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + f" ELSE '{default}' END"


@query("type_map", f"""SELECT table_name, column_name, data_type, {_case('data_type', {'integer': 'INTEGER', 'bigint': 'BIGINT', 'text': 'TEXT', 'varchar': 'VARCHAR', 'numeric': 'NUMERIC'}, 'UNKNOWN')} AS neutral_type,
 {_case('data_type', {'integer': 'int', 'bigint': 'bigint', 'numeric': 'decimal(38,10)'}, 'string')} AS spark_type FROM (
 SELECT table_name, column_name, CASE WHEN ordinal = 3 THEN 'hstore' ELSE data_type END AS data_type FROM {{snapshot_b}}) s""")
def type_map(spark, d):
    snapshot = view(spark, d, "snapshot_b").withColumn("data_type", F.when(F.col("ordinal") == 3, "hstore").otherwise(F.col("data_type")))
    return snapshots.map_types(snapshot.select("table_name", "column_name", "data_type"))


@query("schema_drift", """SELECT coalesce(a.table_name, b.table_name) AS table_name, coalesce(a.column_name, b.column_name) AS column_name, a.data_type AS old_type, b.data_type AS new_type,
 CASE WHEN a.data_type IS NULL THEN 'COLUMN_ADDED' WHEN b.data_type IS NULL THEN 'COLUMN_DROPPED' ELSE 'COLUMN_ALTERED' END AS change
 FROM {snapshot_a} a FULL JOIN {snapshot_b} b ON a.table_name = b.table_name AND a.column_name = b.column_name WHERE a.data_type IS DISTINCT FROM b.data_type""")
def schema_drift(spark, d):
    return snapshots.schema_drift(view(spark, d, "snapshot_a"), view(spark, d, "snapshot_b"))


@query("column_history", """SELECT event_id, user_name, column_name, operation, rows_affected FROM {column_changes} WHERE table_name = 'orders' AND column_name = 'c1' ORDER BY ts_us DESC, event_id DESC LIMIT 100""")
def column_history(spark, d):
    return snapshots.newest(view(spark, d, "column_changes"), 100, table_name="orders", column_name="c1").select(
        "event_id", "user_name", "column_name", "operation", "rows_affected")


@query("ddl_history", """SELECT ddl_id, audit_id, table_name, change_type, status FROM {ddl_log} WHERE table_name = 'orders' AND database_name = 'testdb' ORDER BY ts_us DESC, audit_id DESC LIMIT 100""")
def ddl_history(spark, d):
    return snapshots.newest(view(spark, d, "ddl_log"), 100, table_name="orders", database_name="testdb").select("ddl_id", "audit_id", "table_name", "change_type", "status")


@query("ddl_pending", """SELECT ddl_id, table_name, change_type, user_name, ts_us AS changed_us FROM (SELECT *, row_number() OVER (PARTITION BY ddl_id ORDER BY ts_us DESC, audit_id DESC) AS rn FROM {ddl_log}) x
 WHERE rn = 1 AND status = 'pending'""")
def ddl_pending(spark, d):
    return snapshots.ddl_pending(view(spark, d, "ddl_log")).select("ddl_id", "table_name", "change_type", "user_name", "changed_us")


_AS_OF = 1704067200000000 + 20 * 86_400_000_000
_STATE = f"""SELECT *, decided_us + CASE WHEN requested_hours <= 0 THEN 24 ELSE least(requested_hours, 168) END * 3600000000 AS until_us,
 decided_us IS NOT NULL AND decided_us <= {_AS_OF} AS decided FROM {{access_requests}} WHERE created_us <= {_AS_OF}"""


@query("access_requests", f"""SELECT request_id, user_name, state, CASE WHEN state IN ('APPROVED', 'EXPIRED') THEN until_us END AS valid_until_us FROM (
 SELECT *, CASE WHEN NOT decided THEN 'PENDING' WHEN status = 'APPROVED' AND {_AS_OF} > until_us THEN 'EXPIRED' ELSE status END AS state FROM {{states}}) x
 WHERE NOT (state IN ('DENIED', 'EXPIRED') AND created_us < {_AS_OF} - 168 * 3600000000)""", {"states": _STATE})
def access_requests(spark, d):
    return snapshots.access_requests_as_of(view(spark, d, "access_requests"), _AS_OF).select("request_id", "user_name", "state", "valid_until_us")


@query("active_grants", f"""SELECT database_name, table_name, count(*) FILTER (WHERE state = 'APPROVED') AS active_grants, count(*) FILTER (WHERE state = 'PENDING') AS pending, count(*) AS requests FROM (
 SELECT *, CASE WHEN NOT decided THEN 'PENDING' WHEN status = 'APPROVED' AND {_AS_OF} > until_us THEN 'EXPIRED' ELSE status END AS state FROM {{states}}) x
 WHERE NOT (state IN ('DENIED', 'EXPIRED') AND created_us < {_AS_OF} - 168 * 3600000000) GROUP BY 1, 2""", {"states": _STATE})
def active_grants(spark, d):
    return snapshots.active_grants(view(spark, d, "access_requests"), _AS_OF)


# --- classification -------------------------------------------------------------------------------

_CLASSES = """SELECT 'phone' AS "column", 'PII.Phone' AS pii_type, 0.9::DOUBLE AS confidence, 'ColumnName' AS strategy UNION ALL """
_ONE = """SELECT '{c}' AS "column", CASE {tests} END AS pii_type, 0.8::DOUBLE AS confidence, 'RegexValue' AS strategy FROM people"""
_OPEN = ["c_name", "c_mktsegment", "contact", "code_a", "code_b", "misc"]


def _classify_sql(columns: list[str]) -> str:
    parts = []
    for c in columns:
        tests = " ".join(f"WHEN count(*) FILTER (WHERE coalesce({test(c)}, false)) >= (count(*) + 1) // 2 THEN '{cls}'" for cls, test in TESTS_SQL.items())
        parts.append(f"""SELECT '{c}' AS "column", CASE {tests} END AS pii_type, 0.8::DOUBLE AS confidence, 'RegexValue' AS strategy FROM {{people}}""")
    return " UNION ALL ".join(parts)


@query("classify_columns", _CLASSES + f"SELECT * FROM ({_classify_sql(_OPEN)}) x WHERE pii_type IS NOT NULL")
def classify_columns(spark, d):
    return classify.classify_columns(view(spark, d, "people"))


_NAMES = "CASE c_custkey % 8 WHEN 0 THEN 'Email_' WHEN 1 THEN 'client_ip_address_' WHEN 2 THEN 'monthly_pay_' WHEN 3 THEN 'home_phone_' WHEN 4 THEN 'ssn' WHEN 5 THEN 'zipcode_' WHEN 6 THEN 'x_' ELSE 'user_password_' END"


@query("classify_names", f"""SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'PII.Email' WHEN 1 THEN 'PII.IpAddress' WHEN 2 THEN 'Sensitive.Salary' WHEN 3 THEN 'PII.Phone'
 WHEN 4 THEN 'PII.SSN' WHEN 5 THEN 'PII.Address' WHEN 7 THEN 'Sensitive.Password' END AS by_name,
 CASE WHEN c_custkey % 8 IN (0) AND c_nationkey % 3 = 0 THEN 'PII.Email' WHEN c_custkey % 8 = 4 AND c_nationkey % 3 <> 2 THEN 'PII.SSN'
 WHEN c_custkey % 8 = 3 AND c_nationkey % 3 = 0 THEN 'PII.Phone' END AS by_type FROM customer""")
def classify_names(spark, d):
    name = F.when(F.col("c_custkey") % 8 == 0, "Email_")
    for i, n in enumerate(["client_ip_address_", "monthly_pay_", "home_phone_", "ssn", "zipcode_", "x_", "user_password_"], 1):
        name = name.when(F.col("c_custkey") % 8 == i, n)
    full = F.when(name == "ssn", name).otherwise(F.concat(name, F.col("c_custkey").cast("string")))
    family = F.when(F.col("c_nationkey") % 3 == 0, "text").when(F.col("c_nationkey") % 3 == 1, "integer").otherwise("other")
    named = table(spark, d, "customer").select("c_custkey", full.alias("name"), family.alias("family"))
    return named.select("c_custkey", classify.name_class(F.col("name")).alias("by_name"), classify.type_class(F.col("name"), F.col("family")).alias("by_type"))


@query("derived_column_class", """SELECT audit_id, CASE WHEN k % 4 = 0 THEN 'PII.Phone' WHEN k % 4 = 1 THEN 'PII.SSN' ELSE 'PII.Email' END AS pii_type, 0.9::DOUBLE AS confidence, 'DerivedColumn' AS strategy
 FROM {audit} WHERE k % 5 <> 0 AND k % 4 <> 3""")
def derived_column_class(spark, d):
    k = F.col("k")
    base = local_frame(spark, [("a", "PII.Email"), ("b", "PII.Phone"), ("c", "PII.SSN"), ("z", "None")], "column string, pii_type string")
    sources = F.when(k % 4 == 0, F.array(F.lit("a"), F.lit("b"))).when(k % 4 == 1, F.array(F.lit("c"), F.lit("a"), F.lit("b"))).when(k % 4 == 2, F.array(F.lit("a"))).otherwise(F.array(F.lit("z"), F.lit("q")))
    expr = F.when(k % 5 == 0, "MAX(a)").otherwise("concat(upper(a), b)")
    projections = view(spark, d, "audit").select("audit_id", expr.alias("expr"), sources.alias("sources"))
    return classify.derived_classes(projections, base, ["audit_id"])


_GENERATED = [("email", "text", "PII.Email"), ("phone", "text", "PII.Phone"), ("ssn", "text", "PII.SSN"), ("card", "text", "PII.CreditCard"), ("address", "text", "PII.Address"),
              ("passport", "text", "PII.Passport"), ("ip", "inet", "PII.IpAddress"), ("salary", "numeric", "Sensitive.Salary"), ("password", "text", "Sensitive.Password"),
              ("n", "integer", None), ("big", "bigint", None), ("small", "smallint", None), ("flag", "boolean", None), ("price", "numeric", None), ("day", "date", None),
              ("at", "timestamp with time zone", None), ("id", "uuid", None), ("doc", "jsonb", None), ("note", "text", None)]


@query("synthetic_data", """SELECT concat('user', i + 1, '@example.com') AS email, concat('555-', lpad(cast((i + 100) % 10000 AS varchar), 4, '0')) AS phone, concat('000-00-', lpad(cast((i + 1) % 10000 AS varchar), 4, '0')) AS ssn,
 concat('4111111111', lpad(cast(i % 1000000 AS varchar), 6, '0')) AS card, concat(i + 100, ' Maple St, Springfield, IL 62704') AS address, concat('P', lpad(cast((i + 1) % 100000000 AS varchar), 8, '0')) AS passport,
 concat('192.168.', (i // 256) % 256, '.', i % 256) AS ip, cast(30000 + (i * 1000) % 170000 AS varchar) AS salary, concat('$2b$12$synthetic_hash_', CASE WHEN i > 999999 THEN cast(i AS varchar) ELSE lpad(cast(i AS varchar), 6, '0') END) AS password,
 cast(i + 1 AS varchar) AS n, cast(i + 1 AS varchar) AS big, cast(i % 32000 + 1 AS varchar) AS small, CASE WHEN i % 2 = 0 THEN 'true' ELSE 'false' END AS flag, printf('%.2f', i * 1.5 + 0.5) AS price,
 concat('2024-', lpad(cast((i // 28) % 12 + 1 AS varchar), 2, '0'), '-', lpad(cast(i % 28 + 1 AS varchar), 2, '0')) AS day, concat('2024-', lpad(cast((i // 28) % 12 + 1 AS varchar), 2, '0'), '-', lpad(cast(i % 28 + 1 AS varchar), 2, '0')) AS at,
 concat('00000000-0000-0000-0000-', lpad(cast(i AS varchar), 12, '0')) AS id, concat('{"key": "value_', i, '"}') AS doc, concat('note_', i + 1) AS note FROM (SELECT o_orderkey AS i FROM orders) x""")
def synthetic_data(spark, d):
    """A synthetic stand-in for every order."""
    return synthetic.synthetic_data(table(spark, d, "orders").select("o_orderkey"), _GENERATED, "o_orderkey")


# --- user extensions ------------------------------------------------------------------------------

@query("register_classifier", """SELECT 'c_mktsegment' AS "column", 'Custom.Segment' AS pii_type, 0.75::DOUBLE AS confidence, 'Plugin' AS strategy FROM customer
 HAVING count(*) FILTER (WHERE c_mktsegment = upper(c_mktsegment) AND length(c_mktsegment) > 4) * 2 >= count(*)""")
def register_classifier(spark, d):
    classify.register_classifier("Custom.Segment", lambda name, c: c.cast("string").rlike(r"^[A-Z]{5,}\z"), 0.75)
    try:
        return classify.classify_columns(table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"))
    finally:
        classify.unregister_classifier("Custom.Segment")


@query("register_sink", "SELECT audit_id, user_name, ts_us FROM {audit} WHERE decision = 'BLOCK'")
def register_sink(spark, d):
    path, checkpoint = shared_dir(spark, "sink-out"), shared_dir(spark, "sink-checkpoint")
    audit_log.register_sink("files", audit_log.file_sink(path))
    try:
        control = shared_dir(spark, "control")
        table(spark, d, "events").limit(0).write.parquet(control)
        stream = view(spark, d, "audit", control).filter("decision = 'BLOCK'").select("audit_id", "user_name", "ts_us")
        stream.writeStream.foreachBatch(audit_log.fan_out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        audit_log.unregister_sink("files")
    return spark.read.schema("audit_id bigint, user_name string, ts_us bigint").json(f"{path}/batch=*")
