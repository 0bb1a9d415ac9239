"""Per-key sequential computations that survive a hot key.

A plain ``Window.partitionBy(key)`` puts a whole key into one task. Here all rows are dealt to partitions of equal size by
ranges of (key, order), which Spark samples; the partition is a row's slice. However many rows a key has, and however many
of them share one time, a slice holds no more than a partition's share. Windows run inside (key, slice), one summary row per
slice is carried across slices, and the two are joined on (key, slice). The only per-key window left runs over the
summary rows. The dealt rows are written once to the shared folder, since ranges sampled twice may differ.

The key is packed into one struct so that NULL keys group and join like any other value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from govspark.runtime import shared_dir

KEY, SLICE = "_key", "_slice"
PART = [KEY, SLICE]


def _keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumn(KEY, F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0))


def _tag(df: DataFrame, keys: list[str], order: list[str], bounded: bool = False) -> DataFrame:
    """Add key and slice; slices of a key rise with its order. ``bounded`` keys are known to be small: one slice each."""
    keyed = _keyed(df, keys)
    if bounded:
        return keyed.withColumn(SLICE, F.lit(0))
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartitionByRange(parts, KEY, *order).withColumn(SLICE, F.spark_partition_id())
    path = shared_dir(spark, "slices")
    dealt.write.parquet(path)
    return spark.read.schema(dealt.schema).parquet(path)


def prior_sums(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], bounded: bool = False) -> DataFrame:
    """Add, per row, the sum of each expression over the key's earlier rows. ``order`` must be unique within a key."""
    tagged = _tag(df.withColumns({f"_v_{n}": e for n, e in sums.items()}), keys, order, bounded)
    local = W.partitionBy(*PART).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    inside = {n: F.coalesce(F.sum(f"_v_{n}").over(local), F.lit(0)) for n in sums}
    if bounded:
        return tagged.withColumns(inside).drop(*PART, *[f"_v_{n}" for n in sums])
    across = W.partitionBy(KEY).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    totals = tagged.groupBy(*PART).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    offsets = totals.select(*PART, *[
        F.coalesce(F.sum(f"_t_{n}").over(across), F.lit(0)).alias(f"_o_{n}") for n in sums])
    out = tagged.join(offsets, PART).withColumns({
        n: inside[n] + F.col(f"_o_{n}") for n in sums})
    return out.drop(*PART, *[f"_v_{n}" for n in sums], *[f"_o_{n}" for n in sums])


def previous_row(df: DataFrame, keys: list[str], order: list[str], values: dict[str, str], bounded: bool = False) -> DataFrame:
    """Add columns of the key's preceding row: ``values`` maps new name → source column."""
    tagged = _tag(df, keys, order, bounded)
    payload = F.struct(*[F.col(c).alias(n) for n, c in values.items()])
    local = W.partitionBy(*PART).orderBy(*order)
    if bounded:
        out = tagged.withColumn("_prev", F.lag(payload).over(local))
        return out.withColumns({n: F.col(f"_prev.{n}") for n in values}).drop(*PART, "_prev")
    last = tagged.groupBy(*PART).agg(F.max_by(payload, F.struct(*order)).alias("_last"))
    carried = last.select(*PART, F.lag("_last").over(W.partitionBy(KEY).orderBy(SLICE)).alias("_carry"))
    out = tagged.join(carried, PART).withColumn(
        "_prev", F.coalesce(F.lag(payload).over(local), F.col("_carry")))
    return out.withColumns({n: F.col(f"_prev.{n}") for n in values}).drop(*PART, "_prev", "_carry")


def running_max(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """Add, per row, the largest value of each expression (NULLs aside) over the key's rows up to and with this one."""
    tagged = _tag(df.withColumns({f"_v_{n}": e for n, e in values.items()}), keys, order)
    local = W.partitionBy(*PART).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    across = W.partitionBy(KEY).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    tops = tagged.groupBy(*PART).agg(*[F.max(f"_v_{n}").alias(f"_t_{n}") for n in values])
    carried = tops.select(*PART, *[F.max(f"_t_{n}").over(across).alias(f"_o_{n}") for n in values])
    out = tagged.join(carried, PART).withColumns({n: F.greatest(F.max(f"_v_{n}").over(local), F.col(f"_o_{n}")) for n in values})
    return out.drop(*PART, *[f"_v_{n}" for n in values], *[f"_o_{n}" for n in values])


def as_of(rows: DataFrame, marks: DataFrame, keys: list[str], at: str, value: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the largest ``value`` of the marks (keys, at, value) of the row's key at or before its ``at``."""
    both = marks.withColumn("_mark", F.lit(0)).unionByName(rows.withColumn("_mark", F.lit(1)), allowMissingColumns=True)
    found = running_max(both, keys, [at, "_mark"], {name: F.col(value)})
    return found.where("_mark = 1").drop("_mark", value)


def trailing_count(df: DataFrame, keys: list[str], ts_us: str, window_us: int, name: str) -> DataFrame:
    """Add the number of the key's rows in ``[t - window, t]`` (the row itself included).

    Rows of one time are counted as one row of a summary, so a burst is one of its rows, and the summary's times are cut into
    intervals of a window: each is also history of the next one. The summary is joined back to the rows under salt."""
    keyed = _keyed(df, keys)
    times = keyed.groupBy(KEY, ts_us).agg(F.count(F.lit(1)).alias("_n"))
    place = F.floor(F.col(ts_us) / window_us)
    copy = lambda at, own: F.struct(at.alias("at"), F.lit(own).alias("own"))
    both = times.withColumn("_s", F.explode(F.array(copy(place, True), copy(place + 1, False))))
    w = W.partitionBy(KEY, F.col("_s.at")).orderBy(ts_us).rangeBetween(-window_us, 0)
    counts = both.withColumn(name, F.sum("_n").over(w)).where("_s.own").select(KEY, ts_us, name)
    salts = 16
    dealt = counts.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return keyed.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts))).join(dealt, [KEY, ts_us, "_salt"]).drop(KEY, "_salt").select(
        *df.columns, name)


def nth_row(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The ``n``-th row (1-based) of each key as ``keys + order``; keys with fewer rows are absent.

    Only counts per slice are carried, and only the slice in which the running count crosses ``n`` is ranked.
    """
    tagged = _tag(df.select(*keys, *order), keys, order)
    counts = tagged.groupBy(*PART).agg(F.count(F.lit(1)).alias("_c"))
    crossing = (counts.withColumn("_upto", F.sum("_c").over(W.partitionBy(KEY).orderBy(SLICE)))
                .filter((F.col("_upto") >= n) & (F.col("_upto") - F.col("_c") < n))
                .select(*PART, (F.lit(n) - (F.col("_upto") - F.col("_c"))).alias("_rank")))
    rank = F.row_number().over(W.partitionBy(*PART).orderBy(*order))
    return (tagged.join(crossing, PART).withColumn("_rn", rank)
            .filter(F.col("_rn") == F.col("_rank")).select(*keys, *order))
