"""Masks as plain column expressions; NULL stays NULL, only NULLIFY yields one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the masks.
REDACTED = "***REDACTED***"
FILLER = "***"
DEFAULT_PREFIX = 3
DEFAULT_SUFFIX = 3


def mask_redact(c: Column) -> Column:
    return F.when(c.isNotNull(), F.lit(REDACTED))


def mask_partial(c: Column, prefix: int = DEFAULT_PREFIX, suffix: int = DEFAULT_SUFFIX) -> Column:
    """Keep ``prefix`` and ``suffix`` characters; a value with nothing left to hide is redacted."""
    s = c.cast("string")
    n = F.char_length(s)
    kept = F.concat(F.substring(s, 1, prefix), F.lit(FILLER),
                    F.right(s, F.lit(suffix)))
    return F.when(n <= prefix + suffix, F.lit(REDACTED)).otherwise(kept)


def mask_hash(c: Column) -> Column:
    return F.substring(F.sha2(c.cast("string"), 256), 1, 16)


def mask_nullify(c: Column, data_type: str = "string") -> Column:
    return F.lit(None).cast(data_type)


def apply_mask(c: Column, action: str, prefix: int | None = None, suffix: int | None = None) -> Column:
    """The mask named by a policy, as a string column (NONE leaves the column as it is)."""
    action = (action or "NONE").upper()
    if action == "REDACT":
        return mask_redact(c)
    if action == "PARTIAL":
        return mask_partial(c, DEFAULT_PREFIX if prefix is None else prefix,
                            DEFAULT_SUFFIX if suffix is None else suffix)
    if action == "HASH":
        return mask_hash(c)
    if action == "NULLIFY":
        return mask_nullify(c)
    return c
