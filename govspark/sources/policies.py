"""Policy records → validated POLICY rows."""

from __future__ import annotations

import json
import os
import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from govspark import schemas
from govspark.functions.masking import DEFAULT_PREFIX, DEFAULT_SUFFIX
from govspark.runtime import local_frame

# Raw records as written in configuration; every field is optional.
RAW = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("priority", T.IntegerType()),
    T.StructField("action", T.StringType()),
    *[T.StructField(n, T.ArrayType(T.StringType())) for n in ("users", "roles", "exclude_roles")],
    *[T.StructField(n, T.StringType()) for n in ("database", "schema", "table")],
    T.StructField("columns", T.ArrayType(T.StringType())),
    T.StructField("statement_types", T.ArrayType(T.StringType())),
    T.StructField("masking_action", T.StringType()), T.StructField("masking_prefix_len", T.IntegerType()),
    T.StructField("masking_suffix_len", T.IntegerType()), T.StructField("shadow", T.BooleanType()),
    T.StructField("valid_from", T.TimestampType()), T.StructField("valid_until", T.TimestampType()),
    T.StructField("reason", T.StringType()), T.StructField("load_order", T.IntegerType()),
])


def _list(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def _blank_to_null(name: str) -> Column:
    return F.when(F.col(name) != "", F.col(name))


def policy_error(simulate: bool = False) -> Column:
    """Why a raw record is rejected, NULL when it is valid. Checks run in this order."""
    kinds = F.transform(_list("statement_types"), F.upper)
    unknown = F.filter(kinds, lambda k: ~k.isin(schemas.STATEMENT_TYPES[1:]))
    mask = F.upper(F.coalesce(F.col("masking_action"), F.lit("NONE")))
    out = F
    if not simulate:
        out = out.when(F.coalesce(F.col("name"), F.lit("")) == "", "Policy must have a name")
        out = out.when(~F.upper(F.coalesce(F.col("action"), F.lit("BLOCK"))).isin("ALLOW", "BLOCK"), "Invalid action")
    out = out.when(F.size(unknown) > 0, "Invalid statement type")
    out = out.when(~mask.isin(schemas.MASKING_ACTIONS), "Invalid masking action")
    out = out.when(F.coalesce(F.col("priority"), F.lit(0)) < 0, "Policy priority must be non-negative")
    if not simulate:
        out = out.when(F.size(_list("users")) + F.size(_list("roles")) == 0,
                       "Policy must specify at least one user or role")
    return out.otherwise(F.lit(None).cast("string"))


def validate_policies(raw: DataFrame, simulate: bool = False) -> DataFrame:
    """Valid POLICY rows of ``raw`` (schema RAW). ``simulate`` applies the looser rules of replay input:
    unnamed policies get ``sim-policy-<load_order>``, no user means every user, unknown actions block."""
    order = F.coalesce(F.col("load_order"), F.lit(0))
    action = F.upper(F.coalesce(F.col("action"), F.lit("BLOCK")))
    name, users = F.col("name"), _list("users")
    if simulate:
        name = F.coalesce(_blank_to_null("name"), F.concat(F.lit("sim-policy-"), order.cast("string")))
        action = F.when(action.isin(schemas.DECISIONS), action).otherwise("BLOCK")
        users = F.when(F.size(users) == 0, F.array(F.lit("*"))).otherwise(users)
    return raw.filter(policy_error(simulate).isNull()).select(
        name.alias("name"), F.coalesce("priority", F.lit(0)).alias("priority"), action.alias("action"),
        users.alias("users"), _list("roles").alias("roles"), _list("exclude_roles").alias("exclude_roles"),
        _blank_to_null("database").alias("database"), _blank_to_null("schema").alias("schema"),
        _blank_to_null("table").alias("table"), _list("columns").alias("columns"),
        F.transform(_list("statement_types"), F.upper).alias("operations"),
        F.upper(F.coalesce(F.col("masking_action"), F.lit("NONE"))).alias("masking_action"),
        F.coalesce("masking_prefix_len", F.lit(DEFAULT_PREFIX)).alias("mask_prefix"),
        F.coalesce("masking_suffix_len", F.lit(DEFAULT_SUFFIX)).alias("mask_suffix"),
        F.coalesce("shadow", F.lit(False)).alias("shadow"), "valid_from", "valid_until",
        F.coalesce("reason", F.lit("")).alias("reason"), order.alias("load_order"))


def load_policies(spark: SparkSession, source, simulate: bool = False) -> DataFrame:
    """``source``: list of dicts, path of a JSON or TOML file with a ``policies`` list on any storage that Spark reads, or a DataFrame
    with schema RAW (a policy table of any size)."""
    if isinstance(source, DataFrame):
        return validate_policies(source, simulate)
    if isinstance(source, (str, os.PathLike)):
        text = spark.read.text(str(source), wholetext=True).first()["value"]
        source = (tomllib.loads(text) if str(source).endswith(".toml") else json.loads(text))["policies"]
    rows = [{**p, "load_order": i} for i, p in enumerate(source)]
    rows = [tuple(r.get(f.name) for f in RAW.fields) for r in rows]
    return validate_policies(local_frame(spark, rows, RAW), simulate)
