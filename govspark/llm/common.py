"""What the operators share: reading tables, shared work folders, and running numpy code over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from govspark.runtime import shared_dir

#: ASCII white space; words are the maximal runs of other characters, as ``bytes.split`` finds them.
SPACES = b" \t\n\r\x0b\x0c"

#: A word in Spark's and DuckDB's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that one numpy pass works on; bounds a task's memory whatever a batch holds.
PASS_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str, compression: str = "snappy") -> DataFrame:
    """``df`` written once to the shared folder and read back: later jobs and lost executors start from the files."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def over_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` for functions that yield columns (lists or arrays) for slices of a batch."""
    target = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in fn(batch):
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def slices(texts: list, limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together stay near ``limit`` bytes; a longer text is a range of its own."""
    return _ranges([len(t) if t is not None else 0 for t in texts], limit)


def unpacked(batch: pa.RecordBatch, limit: int) -> Iterator[list[list]]:
    """The columns of a batch as lists, for rows whose ``text`` together stay near ``limit`` characters: the texts of one range
    at a time become Python objects."""
    sizes = pc.utf8_length(batch.column("text")).to_pylist()
    for a, b in _ranges([n or 0 for n in sizes], limit):
        yield [c.to_pylist() for c in batch.slice(a, b - a).columns]


def _ranges(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, n in enumerate(sizes):
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every input bit reaches every output bit (fixed multipliers)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x
