"""Audit-shaped views derived from the given tables, in SQL that Spark and DuckDB both accept.

``{name}`` stands for a table or another view; ``@US(x)`` is microseconds since the epoch.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from govspark.runtime import ensure_utc

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]

VIEWS = {
    # One log row per event.
    "audit": """
SELECT event_id AS audit_id, event_id AS sequence_num, ts, @US(ts) AS ts_us, user_id, k,
  concat('u', cast(user_id AS string)) AS user_name,
  concat('t', cast(user_id % 5 AS string)) AS tenant_id,
  concat('s', cast(user_id AS string), '-', cast(event_id % 3 AS string)) AS session_id,
  concat('10.', cast(user_id % 3 AS string), '.', cast(user_id % 7 AS string), '.', cast(event_id % 250 AS string)) AS source_ip,
  CASE WHEN user_id % 2 = 0 THEN 'testdb' ELSE 'salesdb' END AS database_name,
  CASE user_id % 4 WHEN 0 THEN 'analyst' WHEN 1 THEN 'developer' WHEN 2 THEN 'auditor' ELSE 'admin' END AS role,
  CASE event_type WHEN 'purchase' THEN 'INSERT' WHEN 'signup' THEN 'UPDATE' ELSE 'SELECT' END AS statement_type,
  CASE k % 5 WHEN 0 THEN 'customer' WHEN 1 THEN 'orders' WHEN 2 THEN 'lineitem' WHEN 3 THEN 'supplier' ELSE 'part' END AS table_name,
  CASE WHEN k % 11 = 0 THEN '' WHEN k % 7 = 0 THEN concat(CASE k % 5 WHEN 0 THEN 'customer' WHEN 1 THEN 'orders'
    WHEN 2 THEN 'lineitem' WHEN 3 THEN 'supplier' ELSE 'part' END, ',orders') ELSE
    CASE k % 5 WHEN 0 THEN 'customer' WHEN 1 THEN 'orders' WHEN 2 THEN 'lineitem' WHEN 3 THEN 'supplier' ELSE 'part' END END AS table_list,
  CASE WHEN k % 3 = 0 THEN 'status,id' WHEN k % 3 = 1 THEN 'id' ELSE '' END AS filter_list,
  cast(k AS bigint) AS fingerprint_hash,
  concat('SELECT * FROM t', cast(k % 5 AS string), ' WHERE id = ', cast(event_id AS string)) AS sql_text,
  CASE WHEN event_type = 'error' THEN 'DATABASE_ERROR' ELSE 'NONE' END AS error_code,
  CASE WHEN event_type <> 'error' THEN '' WHEN k % 3 = 0 THEN 'Connection refused by host'
       WHEN k % 3 = 1 THEN 'deadlock detected' ELSE 'syntax error at or near' END AS error_message,
  event_type <> 'error' AS execution_success, event_type,
  cast(round(value * 1000) AS bigint) AS execution_time_us,
  cast(round(value * 100) AS bigint) AS cost_cents,
  CASE WHEN k % 13 = 0 THEN 'BLOCK' ELSE 'ALLOW' END AS decision,
  CASE WHEN k % 13 = 0 THEN 'default_deny' ELSE concat('rule-', cast(k % 9 AS string)) END AS matched_policy,
  k % 17 = 0 AS rate_limited,
  CASE WHEN k % 19 = 0 THEN 'HIGH' WHEN k % 23 = 0 THEN 'MEDIUM' ELSE 'NONE' END AS threat_level,
  CASE WHEN k % 29 = 0 THEN 0.7 WHEN k % 10 = 0 THEN 0.2 ELSE 0.0 END AS anomaly_score,
  CASE k % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'NORMAL' WHEN 2 THEN 'LOW' ELSE 'BACKGROUND' END AS priority
FROM (SELECT *, cast(regexp_extract(props, '([0-9]+)', 1) AS int) AS k FROM {events}) e""",

    # Access to one sensitive column per SELECT on a table that has one.
    "lineage": """
SELECT audit_id, ts_us, user_name, database_name, table_name, tenant_id,
  CASE table_name WHEN 'customer' THEN 'c_name' WHEN 'orders' THEN 'o_totalprice' ELSE 's_name' END AS column_name,
  CASE table_name WHEN 'customer' THEN 'PII.Email' WHEN 'orders' THEN 'Sensitive.Salary' ELSE 'PII.Phone' END AS classification,
  CASE table_name WHEN 'customer' THEN 0.9 WHEN 'orders' THEN 0.8 ELSE 0.85 END + CASE WHEN k % 2 = 0 THEN 0.05 ELSE 0.0 END AS confidence,
  CASE WHEN k % 2 = 0 THEN 'ColumnName' ELSE 'RegexValue' END AS strategy,
  k % 3 = 0 AS was_masked
FROM {audit} WHERE statement_type = 'SELECT' AND table_name IN ('customer', 'orders', 'supplier')""",

    # SQL texts: plain, commented, quoted, listed, and injected ones.
    "sql_log": """
SELECT audit_id, ts_us, user_name, execution_time_us, CASE audit_id % 20
  WHEN 0 THEN concat('SELECT name FROM ', table_name, ' WHERE id = ', cast(k AS string), ' OR 1=1 -- x')
  WHEN 1 THEN concat('SELECT id FROM ', table_name, ' WHERE a = ', cast(k AS string), ' UNION ALL SELECT password FROM users')
  WHEN 2 THEN concat('SELECT id FROM ', table_name, '; DROP TABLE ', table_name)
  WHEN 3 THEN concat('SELECT /* note ', cast(k AS string), ' */ id FROM ', table_name, ' WHERE x IN (', cast(k AS string), ', ', cast(k + 1 AS string), ')')
  WHEN 4 THEN concat('select Id, Name from ', upper(table_name), ' where city = ''O''''Hare ', cast(k AS string), '''')
  WHEN 5 THEN concat('SELECT id FROM ', table_name, ' WHERE id = ', cast(k AS string), ' AND pg_sleep(5) > 0')
  WHEN 6 THEN concat('UN/**/ION SE/**/LECT ', cast(k AS string), ' FROM ', table_name)
  WHEN 7 THEN concat('SELECT id FROM ', table_name, ' WHERE a=''z'' OR ''x''=''x''')
  WHEN 8 THEN concat('%53ELECT id FROM ', table_name, ' WHERE id = %31 OR %31%3D%31')
  WHEN 9 THEN concat('SELECT id FROM ', table_name, ' WHERE id = ', cast(k AS string), ' &#85;NION SELECT pw FROM u')
  WHEN 10 THEN concat('SELECT extractvalue(1, ', cast(k AS string), ') FROM ', table_name)
  WHEN 11 THEN concat('SELECT 0x53454C45435420 , ', cast(k AS string), ' FROM ', table_name)
  WHEN 12 THEN concat('INSERT INTO ', table_name, ' (id, v) VALUES (', cast(k AS string), ', ', cast(k AS string), '.5)')
  WHEN 13 THEN concat('UPDATE ', table_name, ' SET v = ', cast(k AS string), ' WHERE id IN (SELECT id FROM t2 WHERE q = (', cast(k AS string), '))')
  WHEN 14 THEN concat('CREATE INDEX ix', cast(k AS string), ' ON ', table_name, '(id)')
  WHEN 15 THEN concat('ALTER TABLE IF EXISTS ', table_name, ' ADD COLUMN c', cast(k AS string), ' int')
  WHEN 16 THEN concat('DROP TABLE ', table_name, ';')
  WHEN 17 THEN concat('SELECT "Col A" FROM ', table_name, ' WHERE note = ''-- ok'' AND id=', cast(k AS string))
  ELSE concat('SELECT * FROM ', table_name, ' WHERE id = ', cast(k AS string)) END AS sql_text
FROM {audit}""",

    # Sign-in attempts: errors fail, signups succeed.
    "auth_log": """
SELECT audit_id, ts_us, user_name, concat('10.0.0.', cast(k % 20 AS string)) AS source_ip,
  event_type = 'signup' AS success FROM {audit} WHERE event_type IN ('error', 'signup')""",

    # Schema-change requests and their states, one id per 7 events.
    "ddl_log": """
SELECT cast((audit_id - audit_id % 7) / 7 AS bigint) AS ddl_id, audit_id, ts_us, user_name, database_name, table_name,
  CASE k % 6 WHEN 0 THEN 'DROP_TABLE' WHEN 1 THEN 'CREATE_TABLE' ELSE 'ALTER_TABLE' END AS change_type,
  CASE audit_id % 7 WHEN 0 THEN 'pending' WHEN 3 THEN 'approved' WHEN 5 THEN CASE WHEN k % 2 = 0 THEN 'applied' ELSE 'rejected' END
    ELSE 'pending' END AS status
FROM {audit} WHERE audit_id % 7 IN (0, 3, 5) AND k % 4 <> 3""",

    "column_changes": """
SELECT audit_id AS event_id, ts_us, user_name, database_name, table_name,
  concat('c', cast(k % 8 AS string)) AS column_name, statement_type AS operation, audit_id AS rows_affected
FROM {audit} WHERE statement_type IN ('INSERT', 'UPDATE')""",

    # Temporary access requests, one per signup.
    "access_requests": """
SELECT audit_id AS request_id, user_name, database_name, table_name, ts_us AS created_us,
  CASE WHEN k % 4 < 2 THEN 'APPROVED' WHEN k % 4 = 2 THEN 'DENIED' ELSE 'PENDING' END AS status,
  CASE WHEN k % 4 < 3 THEN ts_us + 600000000 END AS decided_us,
  CASE WHEN k % 10 = 0 THEN 400 WHEN k % 10 = 1 THEN 0 ELSE k % 48 + 1 END AS requested_hours
FROM {audit} WHERE event_type = 'signup'""",

    # Two column snapshots: parts are columns, brands are tables; the newer drops, adds and retypes some.
    "snapshot_a": """
SELECT 'main' AS schema_name, p_brand AS table_name, concat('col_', cast(p_partkey AS string)) AS column_name,
  cast(p_size AS int) AS ordinal, CASE p_size % 4 WHEN 0 THEN 'integer' WHEN 1 THEN 'text' WHEN 2 THEN 'varchar' ELSE 'numeric' END AS data_type,
  p_partkey % 2 = 0 AS nullable FROM {part} WHERE p_partkey % 10 <> 0""",
    "snapshot_b": """
SELECT 'main' AS schema_name, p_brand AS table_name, concat('col_', cast(p_partkey AS string)) AS column_name,
  cast(p_size AS int) AS ordinal, CASE WHEN p_partkey % 6 = 0 THEN 'bigint' ELSE
    CASE p_size % 4 WHEN 0 THEN 'integer' WHEN 1 THEN 'text' WHEN 2 THEN 'varchar' ELSE 'numeric' END END AS data_type,
  p_partkey % 3 = 0 AS nullable FROM {part} WHERE p_partkey % 7 <> 0""",

    # A customer table with personal data in its texts.
    "people": """
SELECT c_custkey, c_name, c_acctbal, c_mktsegment,
  concat('user', cast(c_custkey AS string), '@example.com') AS contact,
  concat('(555) 012-', cast(1000 + c_custkey % 9000 AS string)) AS phone,
  concat(cast(100 + c_custkey % 500 AS string), '-45-', cast(1000 + c_custkey % 9000 AS string)) AS code_a,
  CASE WHEN c_custkey % 4 = 0 THEN '4111 1111 1111 1111' ELSE '5500-0000-0000-0004' END AS code_b,
  CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN concat('u', cast(c_custkey AS string), '@x.org') ELSE 'n/a' END AS misc
FROM {customer}""",
}

_NAME = re.compile(r"\{([a-z_]\w*)\}")


#: How much of a table one micro-batch admits.
STREAM_OPTIONS = {"maxBytesPerTrigger": str(256 << 20)}


def table(spark: SparkSession, sf_dir: str, name: str, control: str | None = None) -> DataFrame:
    """A table, or with ``control`` the stream of its files and of the end marks written below ``control``."""
    path = f"{sf_dir}/{name}.parquet"
    batch = spark.read.parquet(path)
    if control is None:
        return batch
    source = lambda at: spark.readStream.schema(batch.schema).options(**STREAM_OPTIONS).parquet(at)
    # A stream takes a plain path for a folder; as a glob it may also be a table of one file.
    return source(f"{sf_dir}/{name}.[p]arquet").union(source(control))


def view(spark: SparkSession, sf_dir: str, name: str, control: str | None = None) -> DataFrame:
    """A table or derived view as a DataFrame, or as a stream of the table's files."""
    ensure_utc(spark)
    if name in TABLES:
        return table(spark, sf_dir, name, control)
    return derive(spark, sf_dir, VIEWS[name], control)


def derive(spark: SparkSession, sf_dir: str, sql: str, control: str | None = None) -> DataFrame:
    inputs = {n: view(spark, sf_dir, n, control) for n in dict.fromkeys(_NAME.findall(sql))}
    sql = re.sub(r"@US\((\w+)\)", r"unix_micros(cast(\1 AS timestamp))", sql)
    return spark.sql(sql, **inputs)


def oracle(sql: str, extra: dict[str, str] | None = None) -> str:
    """DuckDB text of ``sql``: every ``{view}`` it needs becomes a common table expression."""
    ctes: dict[str, str] = {}
    sources = {**VIEWS, **(extra or {})}

    def need(text: str) -> None:
        for n in dict.fromkeys(_NAME.findall(text)):
            if n not in TABLES and n not in ctes:
                need(sources[n])
                ctes[n] = sources[n]

    need(sql)
    plain = lambda t: re.sub(r"@US\((\w+)\)", r"epoch_us(\1)", _NAME.sub(r"\1", t)).strip()
    if not ctes:
        return plain(sql)
    head = ",\n".join(f"{n} AS ({plain(t)})" for n, t in ctes.items())
    body = plain(sql)
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{body[len('WITH RECURSIVE '):]}"
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
