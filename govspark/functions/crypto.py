"""Column encryption: AES-256-GCM as text ``ENC:v1:<key id>:<base64(iv, ciphertext, tag)>``.

Log lines are text ``AENC:v1:<key id>:<base64(...)>`` in the same way. Keys come in as a table (key_id, key
binary, active), one row per key id and one of them active. They are read by scalar subqueries, so no key is ever a literal
of a query plan; a table that breaks these rules fails the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX = "ENC:v1:"
AUDIT_PREFIX = "AENC:v1:"


def _body(c: Column, key: Column) -> Column:
    return F.base64(F.aes_encrypt(c.cast("string").cast("binary"), key, F.lit("GCM")))


def _strip_lines(c: Column) -> Column:
    # Spark's base64 may chunk long output; the format has no line breaks.
    return F.regexp_replace(c, r"\s", "")


def _active(keys: DataFrame) -> Column:
    """(key_id, key) of the active key as one scalar subquery; fails unless exactly one key is active."""
    found = F.collect_list(F.when(F.col("active"), F.struct("key_id", "key")))
    checked = F.when(F.size(found) == 1, F.get(found, F.lit(0))).otherwise(
        F.raise_error(F.concat(F.size(found).cast("string"), F.lit(" active keys; there must be one"))))
    return keys.agg(checked.alias("active")).scalar()


def _ring(keys: DataFrame) -> Column:
    """Keys by id as one map, a scalar subquery; a repeated id fails. A ring of keys is as large as the rotations made."""
    return keys.agg(F.map_from_entries(F.collect_list(F.struct("key_id", "key"))).alias("ring")).scalar()


def _sealed(c: Column, prefix: str, active: Column) -> Column:
    return F.when(c.isNotNull(), F.concat(F.lit(prefix), active["key_id"], F.lit(":"), _strip_lines(_body(c, active["key"]))))


def _opened(c: Column, prefix: str, ring: Column) -> Column:
    """The plain text by the key that the value names; NULL if it is not of the form, its key is unknown or does not fit."""
    key_id, body = _parts(c, prefix)
    raw = F.try_to_binary(body, F.lit("base64"))
    return F.when(F.length(raw) >= 28, F.try_aes_decrypt(raw, F.try_element_at(ring, key_id), F.lit("GCM"))).cast("string")


def _parts(c: Column, prefix: str = PREFIX) -> tuple[Column, Column]:
    pattern = rf"^{prefix}([^:]*):([A-Za-z0-9+/=]+)\z"
    return F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2)


def encrypt_columns(df: DataFrame, columns: list[str], keys: DataFrame) -> DataFrame:
    """Encrypt under the active key; NULL stays NULL. The initialisation vector is random per value."""
    active = _active(keys)
    return df.withColumns({c: _sealed(F.col(c), PREFIX, active) for c in columns})


def decrypt_columns(df: DataFrame, columns: list[str], keys: DataFrame) -> DataFrame:
    """Decrypt by the key id each value names; anything not decryptable passes through unchanged."""
    ring = _ring(keys)
    return df.withColumns({c: F.coalesce(_opened(F.col(c), PREFIX, ring), F.col(c)) for c in columns})


def rotate_keys(df: DataFrame, columns: list[str], keys: DataFrame) -> DataFrame:
    """Re-encrypt the values whose key is not the active one; values under the active key keep their text."""
    active = _active(keys)["key_id"]
    out = df
    for c in columns:
        kept = out.withColumn("_old", F.col(c))
        # What cannot be opened is left alone, not wrapped a second time.
        opened = decrypt_columns(kept, [c], keys).withColumn("_opened", F.col(c) != F.col("_old"))
        stale = F.col("_opened") & (_parts(F.col("_old"))[0] != active)
        out = encrypt_columns(opened, [c], keys).withColumn(
            c, F.when(stale, F.col(c)).otherwise(F.col("_old"))).drop("_old", "_opened")
    return out


def encrypt_audit(log: DataFrame, keys: DataFrame) -> DataFrame:
    """Whole log rows as encrypted JSON lines (column ``line``) that name their key."""
    return log.select(_sealed(F.to_json(F.struct("*")), AUDIT_PREFIX, _active(keys)).alias("line"))


def open_audit(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """``line`` as plain JSON where its key is known; every other line, plain or unreadable, passes through as it is."""
    return lines.withColumn("line", F.coalesce(_opened(F.col("line"), AUDIT_PREFIX, _ring(keys)), F.col("line")))


def decrypt_audit(lines: DataFrame, keys: DataFrame, schema) -> DataFrame:
    """Lines back to rows, whichever key of the ring wrote them. A line that is not JSON after opening stays a row: its
    fields are NULL and ``_unopened`` holds the line."""
    opened = open_audit(lines, keys).select("line", F.from_json("line", schema).alias("r"))
    unread = ~F.ltrim("line").startswith("{")
    return opened.select("r.*", F.when(unread, F.col("line")).alias("_unopened"))
