"""Tables as streams in the order of time, and a gate that tells rows that come in time from late ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from govspark.runtime import local_frame, shared_dir

#: Rows of a slice of a replayed table. A stream over ordered slices holds about one slice in state, whatever the table's size.
SLICE_ROWS = 50_000_000
SECOND_US = 1_000_000


def ordered_copy(df: DataFrame, path: str, ts: str = "ts", slice_rows: int = SLICE_ROWS) -> int:
    """Write ``df`` to ``path`` as slices of time, each slice's files after those of all earlier times, and return the
    widest slice in microseconds: with a watermark delay above it no row of a stream over ``path`` is late, however
    few files a micro-batch takes.

    A file stream takes files in the order in which they were written. Slices hold about ``slice_rows`` rows; rows of one
    time stay in one slice. Rows without a time come first."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.count()
    slices = max(1, -(-rows // slice_rows))
    cuts = []
    if slices > 1:
        shares = [i / slices for i in range(1, slices)]
        cuts = sorted(set(df.agg(F.percentile_approx(at, shares, 10 * slices)).first()[0]))
    place = sum((F.coalesce(at > c, F.lit(False)).cast("int") for c in cuts), F.lit(0))
    spread = shared_dir(df.sparkSession, "slices")
    spans = df.groupBy(place.alias("slice")).agg((F.max(at) - F.min(at)).alias("span")).collect()
    widest = max([r["span"] or 0 for r in spans], default=0)
    if not cuts:
        df.sortWithinPartitions(ts).write.mode("append").parquet(path)
        return widest
    df.withColumn("_slice", place).write.partitionBy("_slice").parquet(spread)
    parts = df.sparkSession.read.parquet(spread)
    for i in range(len(cuts) + 1):
        parts.where(F.col("_slice") == i).select(df.columns).sortWithinPartitions(ts).write.mode("append").parquet(path)
    return widest


class Gate:
    """One streaming query with two outputs: rows that come in time, and late ones in a table of their own.

    A row is late if its time ``ts`` is more than ``delay_us`` before the newest time of all earlier micro-batches. Each batch is
    written below its id, once: a batch that is retried after a loss finds its rows or writes them anew, and the mark of the
    newest time is kept beside them. A stream over ``on_time`` with ``delay`` as its watermark delay drops no row, so its
    result and ``late`` together are the whole input. Rows without a time are in time."""

    def __init__(self, schema, delay_us: int, spark: SparkSession, purpose: str = "gate"):
        self.spark, self.schema, self.delay_us, self.root = spark, schema, delay_us, shared_dir(spark, purpose)
        nothing = spark.createDataFrame([], schema)
        for late in ("true", "false"):  # so that both outputs can be read before the first batch
            nothing.write.parquet(f"{self.root}/rows/batch=-1/late={late}")

    @property
    def delay(self) -> str:
        return f"{self.delay_us // SECOND_US + 2} seconds"

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """Take a micro-batch (use as ``foreachBatch``)."""
        spark, rows, mark = batch.sparkSession, f"{self.root}/rows/batch={batch_id}", f"{self.root}/marks/batch={batch_id}"
        if self._exists(f"{mark}/_SUCCESS"):
            return
        newest = None
        if batch_id > 0:
            newest = spark.read.schema("newest long, batch long").parquet(f"{self.root}/marks").where(F.col("batch") < batch_id).agg(F.max("newest")).first()[0]
        at = F.unix_micros(F.col("ts").cast("timestamp"))
        if self._exists(f"{rows}/_SUCCESS"):
            high = spark.read.schema(self.schema).parquet(rows).agg(F.max(at)).first()[0]
        else:
            late = F.lit(False) if newest is None else F.coalesce(at < newest - self.delay_us, F.lit(False))
            seen = Observation()
            batch.withColumn("late", late).observe(seen, F.max(at).alias("high")).write.mode("overwrite").partitionBy("late").parquet(rows)
            high = seen.get["high"]
        newest = max((t for t in (newest, high) if t is not None), default=None)
        local_frame(spark, [(newest,)], "newest long").write.mode("overwrite").parquet(mark)

    def drain(self, stream: DataFrame) -> None:
        """Pass all that ``stream`` has now through the gate; may be called again when there is more."""
        (stream.writeStream.foreachBatch(self.write).option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True)
         .start().awaitTermination())

    def on_time(self) -> DataFrame:
        """The stream of the rows that came in time, batch by batch."""
        return self.spark.readStream.schema(self.schema).parquet(f"{self.root}/rows/batch=*/late=false")

    def tagged(self) -> DataFrame:
        """All rows so far, with ``batch`` and ``late``."""
        return self.spark.read.schema(self.spark.createDataFrame([], self.schema).schema.add("late", "boolean").add("batch", "long")) \
            .parquet(f"{self.root}/rows")

    def late(self) -> DataFrame:
        return self.tagged().where("late").drop("late", "batch")
