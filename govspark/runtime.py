"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# A side is broadcast only when a counted check proves it holds at most this many rows.
MAX_BROADCAST_ROWS = 20_000

_fallback_dir: str | None = None


def ensure_utc(spark: SparkSession) -> SparkSession:
    """Every day, hour and window in this package is a UTC one."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for state or intermediate tables, in the place the cluster names.

    ``spark.checkpoint.dir`` must be storage every executor reaches; only when it is unset
    (tests, local mode) a machine-local folder stands in for it.
    """
    global _fallback_dir
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if _fallback_dir is None:
            _fallback_dir = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        root = _fallback_dir
    return os.path.join(root, f"{purpose}-{uuid.uuid4().hex}")


def local_frame(spark: SparkSession, rows: list[tuple], schema) -> DataFrame:
    """A small driver-side list as a DataFrame whose size the optimizer knows (a local relation)."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    columns = [pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(to_arrow_schema(schema))]
    return spark.createDataFrame(pa.Table.from_arrays(columns, names=schema.names), schema)


def spread(df: DataFrame) -> DataFrame:
    """For work that is heavy per row: use all cores when the input comes in fewer splits than there are.

    Inputs of a cluster's size have more splits than cores and are left where they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if not df.isStreaming and df.rdd.getNumPartitions() < cores else df


def fits_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; reads no more than that plus one."""
    return df.limit(max_rows + 1).count() <= max_rows


def small_side(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` when a count proves it small; otherwise leave the join strategy to AQE."""
    return F.broadcast(df) if fits_broadcast(df, max_rows) else df


def micros(col) -> F.Column:
    return F.unix_micros(F.col(col) if isinstance(col, str) else col)


def floor_to(col, width: int) -> F.Column:
    """Largest multiple of ``width`` not above the (non-negative) long column."""
    c = F.col(col) if isinstance(col, str) else col
    return (c - c % F.lit(width)).cast("long")


# Room for an id behind a timestamp inside one decimal.
_ID_SPAN = 10 ** 19


def position(ts_us: str = "ts_us", row_id: str = "audit_id") -> F.Column:
    """(ts_us, id) as one decimal that orders like the pair; unlike a struct it fits a hash aggregate."""
    return (F.col(ts_us).cast("decimal(18,0)") * F.expr(f"{_ID_SPAN}BD") + F.col(row_id)).cast("decimal(38,0)")


def at_position(name: str, ts_us: str = "ts_us", row_id: str = "audit_id") -> dict[str, F.Column]:
    """The pair back from a ``position``."""
    return {row_id: (F.col(name) % F.expr(f"{_ID_SPAN}BD")).cast("bigint"), ts_us: F.expr(f"{name} div {_ID_SPAN}BD")}
