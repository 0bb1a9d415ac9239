"""Synthetic rows: every value is a function of the row's index, its column's class and its type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Type names of each generator family; any other type is text.
FAMILIES = {
    "integer": ["integer", "int4", "int", "serial"], "bigint": ["bigint", "int8", "bigserial"],
    "smallint": ["smallint", "int2"], "boolean": ["boolean", "bool"],
    "numeric": ["numeric", "decimal", "float8", "double precision", "real", "float4"],
    "date": ["date"], "uuid": ["uuid"], "json": ["json", "jsonb"],
}


def type_family(data_type: str) -> str:
    for family, names in FAMILIES.items():
        if data_type in names:
            return family
    return "date" if "timestamp" in data_type else "text"


def _padded(i: Column, width: int) -> Column:
    return F.when(F.length(i.cast("string")) >= width, i.cast("string")).otherwise(F.lpad(i.cast("string"), width, "0"))


def synthetic_value(i: Column, name: str, data_type: str, pii_type: str | None) -> Column:
    """The value of row index ``i`` (from 0) as text."""
    s = lambda c: c.cast("string")
    third = lambda c: F.floor(c).cast("bigint")
    # Fixed formats of the generated values.
    by_class = {
        "PII.Email": lambda: F.concat(F.lit("user"), s(i + 1), F.lit("@example.com")),
        "PII.Phone": lambda: F.concat(F.lit("555-"), _padded((i + 100) % 10000, 4)),
        "PII.SSN": lambda: F.concat(F.lit("000-00-"), _padded((i + 1) % 10000, 4)),
        "PII.CreditCard": lambda: F.concat(F.lit("4111111111"), _padded(i % 1000000, 6)),
        "PII.Address": lambda: F.concat(s(i + 100), F.lit(" Maple St, Springfield, IL 62704")),
        "PII.Passport": lambda: F.concat(F.lit("P"), _padded((i + 1) % 100000000, 8)),
        "PII.IpAddress": lambda: F.concat(F.lit("192.168."), s(third(i / 256) % 256), F.lit("."), s(i % 256)),
        "Sensitive.Salary": lambda: s(30000 + (i * 1000) % 170000),
        "Sensitive.Password": lambda: F.concat(F.lit("$2b$12$synthetic_hash_"), _padded(i, 6)),
    }
    by_family = {
        "integer": lambda: s(i + 1), "bigint": lambda: s(i + 1), "smallint": lambda: s(i % 32000 + 1),
        "boolean": lambda: F.when(i % 2 == 0, "true").otherwise("false"),
        "numeric": lambda: s((i * F.lit(1.5) + F.lit(0.5)).cast("decimal(38,2)")),
        "date": lambda: F.concat(F.lit("2024-"), _padded(third(i / 28) % 12 + 1, 2), F.lit("-"), _padded(i % 28 + 1, 2)),
        "uuid": lambda: F.concat(F.lit("00000000-0000-0000-0000-"), _padded(i, 12)),
        "json": lambda: F.concat(F.lit('{"key": "value_'), s(i), F.lit('"}')),
        "text": lambda: F.concat(F.lit(name + "_"), s(i + 1)),
    }
    return (by_class.get(pii_type) or by_family[type_family(data_type)])()


def synthetic_data(index: DataFrame, columns: list[tuple[str, str, str | None]], i: str = "id") -> DataFrame:
    """One row per row of ``index`` (``spark.range(n)`` or any frame with a long column ``i``)."""
    return index.select(*[synthetic_value(F.col(i), n, t, cls).alias(n) for n, t, cls in columns])
