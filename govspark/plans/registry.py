"""Registered queries and the SQL each must agree with."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from govspark.plans import fixtures

MODULES = ["governed", "activity", "text", "metadata", "streams"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None, extra: dict[str, str] | None = None):
    """Register ``fn(spark, sf_dir)`` under ``key`` with its SQL twin over the same tables."""
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            fixtures.ensure_utc(spark)
            return fn(spark, sf_dir)
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = fixtures.oracle(sql, extra)
        return fn
    return register


def load() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Import every module that registers queries and return them."""
    for name in MODULES:
        importlib.import_module(f"govspark.plans.{name}")
    return QUERIES
