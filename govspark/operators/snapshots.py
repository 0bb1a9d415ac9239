"""Schema snapshots: taking them, mapping their types, comparing them; change ledgers; access requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from govspark.runtime import local_frame, small_side

# Vendor type names → neutral type.
POSTGRESQL_TYPES = {
    "integer": "INTEGER", "int4": "INTEGER", "serial": "INTEGER", "oid": "INTEGER",
    "smallint": "SMALLINT", "int2": "SMALLINT",
    "bigint": "BIGINT", "int8": "BIGINT", "bigserial": "BIGINT",
    "real": "REAL", "float4": "REAL", "double precision": "DOUBLE_PRECISION", "float8": "DOUBLE_PRECISION",
    "numeric": "NUMERIC", "decimal": "NUMERIC", "money": "MONEY",
    "text": "TEXT", "varchar": "VARCHAR", "character varying": "VARCHAR", "char": "CHAR", "character": "CHAR",
    "boolean": "BOOLEAN", "bool": "BOOLEAN",
    "date": "DATE", "time": "TIME", "time without time zone": "TIME", "timetz": "TIME", "time with time zone": "TIME",
    "timestamp": "TIMESTAMP", "timestamp without time zone": "TIMESTAMP",
    "timestamptz": "TIMESTAMP_TZ", "timestamp with time zone": "TIMESTAMP_TZ", "interval": "INTERVAL",
    "bytea": "BLOB", "json": "JSON", "jsonb": "JSONB", "uuid": "UUID", "inet": "INET", "cidr": "INET",
    "xml": "XML", "array": "ARRAY", "ARRAY": "ARRAY",
    "macaddr": "VENDOR_SPECIFIC", "point": "VENDOR_SPECIFIC", "line": "VENDOR_SPECIFIC", "lseg": "VENDOR_SPECIFIC",
    "box": "VENDOR_SPECIFIC", "path": "VENDOR_SPECIFIC", "polygon": "VENDOR_SPECIFIC", "circle": "VENDOR_SPECIFIC",
    "tsvector": "VENDOR_SPECIFIC", "tsquery": "VENDOR_SPECIFIC",
}
MYSQL_TYPES = {
    "tinyint": "SMALLINT", "smallint": "SMALLINT", "int": "INTEGER", "mediumint": "INTEGER", "bigint": "BIGINT",
    "float": "REAL", "double": "DOUBLE_PRECISION", "decimal": "NUMERIC", "char": "CHAR", "varchar": "VARCHAR",
    "blob": "BLOB", "tinyblob": "BLOB", "mediumblob": "BLOB", "longblob": "BLOB", "date": "DATE", "time": "TIME",
    "datetime": "TIMESTAMP", "timestamp": "TIMESTAMP", "json": "JSON", "year": "INTEGER", "bit": "VENDOR_SPECIFIC",
    "enum": "VARCHAR", "set": "VARCHAR", "geometry": "VENDOR_SPECIFIC",
}
# Neutral type → Spark type; every other neutral type is a string.
SPARK_TYPES = {
    "SMALLINT": "smallint", "INTEGER": "int", "BIGINT": "bigint", "REAL": "float", "DOUBLE_PRECISION": "double",
    "NUMERIC": "decimal(38,10)", "MONEY": "decimal(19,2)", "BOOLEAN": "boolean", "DATE": "date",
    "TIMESTAMP": "timestamp_ntz", "TIMESTAMP_TZ": "timestamp", "INTERVAL": "interval day to second",
    "BLOB": "binary", "ARRAY": "array<string>",
}


def schema_snapshot(spark: SparkSession, tables: dict[str, DataFrame], schema_name: str = "main") -> DataFrame:
    """(schema, table, column, ordinal, type, nullable) of frames; reads metadata only."""
    rows = [(schema_name, t, f.name, i, f.dataType.simpleString(), f.nullable)
            for t, df in tables.items() for i, f in enumerate(df.schema.fields, 1)]
    return local_frame(spark, rows, "schema_name string, table_name string, column_name string, ordinal int, "
                                       "data_type string, nullable boolean")


def map_types(snapshot: DataFrame, vendor: str = "postgresql") -> DataFrame:
    """Add neutral_type and spark_type by vendor type name."""
    names = POSTGRESQL_TYPES if vendor == "postgresql" else MYSQL_TYPES
    spark = snapshot.sparkSession
    mapping = local_frame(spark, [(k, v, SPARK_TYPES.get(v, "string")) for k, v in names.items()],
                                    "data_type string, _neutral string, _spark string")
    return (snapshot.join(small_side(mapping), "data_type", "left")
            .withColumn("neutral_type", F.coalesce("_neutral", F.lit("UNKNOWN")))
            .withColumn("spark_type", F.coalesce("_spark", F.lit("string"))).drop("_neutral", "_spark"))


def schema_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """Columns added, dropped or retyped between two snapshots (nullability is not drift)."""
    key = ["table_name", "column_name"]
    a = old.select(*key, F.col("data_type").alias("old_type"))
    b = new.select(*key, F.col("data_type").alias("new_type"))
    change = (F.when(F.col("old_type").isNull(), "COLUMN_ADDED").when(F.col("new_type").isNull(), "COLUMN_DROPPED")
              .when(F.col("old_type") != F.col("new_type"), "COLUMN_ALTERED"))
    return a.join(b, key, "full").withColumn("change", change).filter(F.col("change").isNotNull())


def newest(events: DataFrame, limit: int = 100, **filters) -> DataFrame:
    """Newest-first change events filtered by equality (table_name, column_name, database_name, …)."""
    for c, v in filters.items():
        if v is not None:
            events = events.filter(F.col(c) == v)
    tie = "event_id" if "event_id" in events.columns else "audit_id"
    return events.orderBy(F.desc("ts_us"), F.desc(tie)).limit(limit)


def ddl_states(ledger: DataFrame) -> DataFrame:
    """Last state of every change request."""
    last = F.max_by(F.struct("status", "table_name", "change_type", "user_name"), F.struct("ts_us", "audit_id"))
    return ledger.groupBy("ddl_id").agg(last.alias("_l"), F.max("ts_us").alias("changed_us")).select("ddl_id", "_l.*", "changed_us")


def ddl_pending(ledger: DataFrame) -> DataFrame:
    return ddl_states(ledger).filter(F.col("status") == "pending")


# Fixed values of temporary access: default and longest duration, and how long settled requests are kept.
DEFAULT_HOURS, MAX_HOURS, KEEP_HOURS = 24, 168, 168
HOUR_US = 3_600_000_000


def grant_hours(requested: Column) -> Column:
    return F.when(F.coalesce(requested, F.lit(0)) <= 0, DEFAULT_HOURS).otherwise(F.least(requested, F.lit(MAX_HOURS)))


def access_requests_as_of(requests: DataFrame, as_of_us: int) -> DataFrame:
    """State of every request at a moment; denied and expired ones are purged a week after creation.

    Requests made later are unknown, decisions made later leave a request PENDING.
    """
    as_of = F.lit(as_of_us)
    until = F.col("decided_us") + grant_hours(F.col("requested_hours")) * HOUR_US
    decided = F.coalesce(F.col("decided_us") <= as_of, F.lit(False))
    state = (F.when(~decided, "PENDING").when((F.col("status") == "APPROVED") & (as_of > until), "EXPIRED")
             .otherwise(F.col("status")))
    out = requests.filter(F.col("created_us") <= as_of).withColumn("state", state).withColumn(
        "valid_until_us", F.when(F.col("state").isin("APPROVED", "EXPIRED"), until))
    purged = F.col("state").isin("DENIED", "EXPIRED") & (F.col("created_us") < as_of - KEEP_HOURS * HOUR_US)
    return out.filter(~purged)


def active_grants(requests: DataFrame, as_of_us: int) -> DataFrame:
    """Requests per state and grants in force per table at a moment."""
    now = access_requests_as_of(requests, as_of_us)
    return now.groupBy("database_name", "table_name").agg(
        F.count_if(F.col("state") == "APPROVED").alias("active_grants"), F.count_if(F.col("state") == "PENDING").alias("pending"),
        F.count(F.lit(1)).alias("requests"))


def grants(requests: DataFrame) -> DataFrame:
    """Approved requests as validity intervals (input of ``policy.grant_coverage``)."""
    return requests.filter(F.col("status") == "APPROVED").select(
        "request_id", F.col("user_name").alias("user"), F.col("database_name").alias("database"),
        F.col("table_name").alias("table"), F.array().cast("array<string>").alias("statement_types"),
        F.col("decided_us").alias("valid_from_us"),
        (F.col("decided_us") + grant_hours(F.col("requested_hours")) * HOUR_US).alias("valid_until_us"))
