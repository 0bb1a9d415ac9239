"""Data model: the audit log, policies, and the fixed enumerations."""

from __future__ import annotations

from pyspark.sql import types as T

# Statement types and their categories.
STATEMENT_TYPES = [
    "UNKNOWN", "SELECT", "INSERT", "UPDATE", "DELETE", "CREATE_TABLE", "ALTER_TABLE", "DROP_TABLE",
    "CREATE_INDEX", "DROP_INDEX", "TRUNCATE", "BEGIN", "COMMIT", "ROLLBACK", "SET", "SHOW",
    "PREPARE", "EXECUTE_STMT", "DEALLOCATE", "COPY",
]
WRITE_STATEMENTS = ["INSERT", "UPDATE", "DELETE", "CREATE_TABLE", "ALTER_TABLE", "DROP_TABLE", "TRUNCATE"]
DML_STATEMENTS = ["INSERT", "UPDATE", "DELETE"]
DDL_STATEMENTS = ["CREATE_TABLE", "ALTER_TABLE", "DROP_TABLE", "CREATE_INDEX", "DROP_INDEX", "TRUNCATE"]
TXN_STATEMENTS = ["BEGIN", "COMMIT", "ROLLBACK"]

# Decisions, error codes, PII classes (in rising order of precedence), masks, threat levels.
DECISIONS = ["ALLOW", "BLOCK", "ERROR"]
ERROR_CODES = [
    "NONE", "PARSE_ERROR", "ACCESS_DENIED", "RATE_LIMITED", "CIRCUIT_OPEN", "DATABASE_ERROR",
    "INTERNAL_ERROR", "INVALID_REQUEST", "RESULT_TOO_LARGE", "SQLI_BLOCKED", "QUERY_TIMEOUT",
    "QUERY_TOO_EXPENSIVE", "FIREWALL_BLOCKED", "RESIDENCY_BLOCKED", "COPY_NOT_SUPPORTED",
    "COST_BUDGET_EXCEEDED",
]
PII_TYPES = [
    "None", "PII.Email", "PII.Phone", "PII.SSN", "PII.CreditCard", "PII.Address", "PII.Passport",
    "PII.IpAddress", "Sensitive.Salary", "Sensitive.Password", "Custom",
]
MASKING_ACTIONS = ["NONE", "REDACT", "PARTIAL", "HASH", "NULLIFY"]
THREAT_LEVELS = ["NONE", "LOW", "MEDIUM", "HIGH", "CRITICAL"]

_S, _L, _B, _D = T.StringType(), T.LongType(), T.BooleanType(), T.DoubleType()
_SA = T.ArrayType(T.StringType())

AUDIT = T.StructType([T.StructField(n, t) for n, t in [
    ("audit_id", _L), ("sequence_num", _L), ("ts", T.TimestampType()), ("received_at", T.TimestampType()),
    ("user", _S), ("roles", _SA), ("tenant_id", _S), ("source_ip", _S), ("session_id", _S),
    ("database", _S), ("sql", _S), ("fingerprint_hash", _L), ("normalized", _S), ("statement_type", _S),
    ("tables", _SA), ("columns", _SA), ("columns_filtered", _SA), ("decision", _S),
    ("matched_policy", _S), ("block_reason", _S), ("rule_specificity", T.IntegerType()),
    ("execution_attempted", _B), ("execution_success", _B), ("error_code", _S), ("error_message", _S),
    ("rows_affected", _L), ("rows_returned", _L), ("classifications", _SA), ("masked_columns", _SA),
    ("total_duration_us", _L), ("parse_time_us", _L), ("policy_time_us", _L), ("execution_time_us", _L),
    ("classification_time_us", _L), ("proxy_overhead_us", _L), ("rate_limited", _B),
    ("rate_limit_level", _S), ("circuit_breaker_tripped", _B), ("cache_hit", _B), ("trace_id", _S),
    ("threat_level", _S), ("injection_patterns", _SA), ("anomaly_score", _D), ("anomalies", _SA),
    ("shadow_blocked", _B), ("shadow_policy", _S), ("priority", _S), ("query_cost", _D),
    ("spans", T.ArrayType(T.StructType([
        T.StructField("id", _S), T.StructField("op", _S), T.StructField("dur_us", _L)]))),
    ("record_hash", _S), ("previous_hash", _S),
]])

POLICY = T.StructType([
    T.StructField("name", _S), T.StructField("priority", T.IntegerType()), T.StructField("action", _S),
    T.StructField("users", _SA), T.StructField("roles", _SA), T.StructField("exclude_roles", _SA),
    T.StructField("database", _S), T.StructField("schema", _S), T.StructField("table", _S),
    T.StructField("columns", _SA), T.StructField("operations", _SA),
    T.StructField("masking_action", _S), T.StructField("mask_prefix", T.IntegerType()),
    T.StructField("mask_suffix", T.IntegerType()), T.StructField("shadow", _B),
    T.StructField("valid_from", T.TimestampType()), T.StructField("valid_until", T.TimestampType()),
    T.StructField("reason", _S), T.StructField("load_order", T.IntegerType()),
])
