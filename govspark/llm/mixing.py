"""Mixing sources to target weights along a time-varying curriculum.

Every source gets a target number of words from its weight, capped at a multiple of its size. Its documents, in a seeded
order and repeated as often as the target asks, form a queue of words; the source's weight schedule over training time is
integrated to its cumulative demand, and the inverse of that demand gives each copy the time at which its middle is wanted.
Copies range-sorted by that position are the training order.

Only sources, and pieces of sources, are ever aggregated; documents are placed by prefix sums. A source is cut into 4,096
pieces by its order, so a source that holds most rows is spread like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from govspark.llm.common import WORD, table

#: Weights of the sources in their order, repeating.
WEIGHTS = (1, 2, 3)
#: Largest multiple of a source's size, and so of a document's, that the mix takes.
MAX_REPEATS = 3
#: Weight schedules over training time in the order of the sources, repeating: values at evenly spaced times, linear
#: between them. Only their shape counts, since the target fixes their integral.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source_key, source_size, place, target from source, source_key, source_size: one row per source.

    Sources count by code point, null last. They share all words by weight; a source that would pass ``max_repeats`` times
    its size stops there and the others share the rest. Filling in order of room per weight finds them in one pass: a source
    is full if its room is at most what the sources from it on would get."""
    ordered = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double")
    whole, filling = Window.partitionBy(), Window.orderBy("ratio", "place")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    room = F.lit(float(max_repeats)) * F.col("source_size")
    shared = (ordered.withColumn("weight", weight).withColumn("room", room).withColumn("ratio", F.col("room") / F.col("weight"))
              .withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("room").over(before), F.lit(0.0)))
                          / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
              .withColumn("full", F.col("ratio") <= F.col("level")))
    # Among the sources that are not full, the first in filling order has the level that holds for all of them.
    first = F.min(F.when(~F.col("full"), F.struct("ratio", "place", "level"))).over(whole)["level"]
    return shared.select("source_key", "source_size", "place",
                         F.when(F.col("full"), F.col("room")).otherwise(first * F.col("weight")).alias("target"))


def _with_schedules(sources: DataFrame, schedules: Sequence[Sequence[float]]) -> DataFrame:
    """Adds ``rate`` (values of the schedule) and ``done`` (its integral up to each of those times, ending at 1)."""
    area = [[0.0] for _ in schedules]
    for sums, values in zip(area, schedules):
        for a, b in zip(values, values[1:]):
            sums.append(sums[-1] + (a + b) / 2 / (len(values) - 1))
    pick = lambda rows: F.element_at(F.array(*(F.array(*map(F.lit, r)) for r in rows)), (F.col("place") % len(rows) + 1).cast("int"))
    scale = lambda rows: [[v / a[-1] for v in r] for r, a in zip(rows, area)]
    return sources.withColumns({"rate": pick(scale(schedules)), "done": pick(scale(area))})


def _time_of(share) -> F.Column:
    """Inverse of the cumulative demand: the time in [0, 1] at which ``share`` of a source's target is used up."""
    share = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
    steps = F.size("rate") - 1
    at = F.least(F.size(F.filter("done", lambda d: d <= share)), steps)  # 1-based segment
    low, high = F.element_at("rate", at), F.element_at("rate", at + 1)
    rest = (share - F.element_at("done", at)) * steps
    root = F.sqrt(F.greatest(low * low + 2 * (high - low) * rest, F.lit(0.0)))
    return (at - 1 + F.when(rest > 0, 2 * rest / (low + root)).otherwise(0.0)) / steps


def plan(df: DataFrame, cut: bool = True, seed: int = 0, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS,
         schedules: Sequence[Sequence[float]] = SCHEDULES) -> DataFrame:
    """One row per row of ``df``: row (struct of its columns), size, source_size,
    target, taken, positions (array of double, one per copy).

    Every source is walked through in an order fixed by ``seed`` and doc_id as often as its target asks. With ``cut`` the
    walk ends on the word that meets the target; without, a copy is taken whole if half of it or more lies within. Null
    texts have size 0 and are never taken, as is any row without words; null sources are one source; rows that repeat are
    separate documents; an empty table gives no rows. The same rows in any partitioning give the same plan."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")))
    rows = df.select(F.struct(*df.columns).alias("row"), F.col("doc_id").alias("_id"), F.col("source").alias("source"),
                     F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("source_key"),
                     F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                     key.alias("key")).withColumn("piece", F.substring("key", 1, 3))
    pieces = rows.groupBy("source_key", "piece").agg(F.first("source").alias("source"), F.sum("size").alias("words"))
    sources = targets(pieces.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("words").alias("source_size")),
                      weights, max_repeats)
    start = F.coalesce(F.sum("words").over(Window.partitionBy("source_key").orderBy("piece").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select("source_key", "piece", start.alias("start")).join(_with_schedules(sources, schedules), "source_key")
    inside = Window.partitionBy("source_key", "piece").orderBy("key", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.drop("source").join(pieces, ["source_key", "piece"]).withColumn(
        "start", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    wanted = F.round("target") if cut else F.col("target")
    rounds = F.when(F.col("source_size") > 0, F.floor(wanted / F.col("source_size"))).otherwise(0)
    rest = wanted - F.col("rounds") * F.col("source_size") - F.col("start")
    last = F.least(F.greatest(rest, F.lit(0.0)), F.col("size")) if cut else F.when(2 * rest >= F.col("size"), F.col("size")).otherwise(0)
    placed = placed.withColumn("rounds", rounds).withColumn("last", last.cast("long"))
    copies = F.when(F.col("size") > 0, F.col("rounds") + F.when(F.col("last") > 0, 1).otherwise(0)).otherwise(0).cast("int")
    words = lambda i: F.when(i < F.col("rounds"), F.col("size")).otherwise(F.col("last"))
    middle = lambda i: (i * F.col("source_size") + F.col("start") + words(i) / 2.0) / F.col("target")
    numbers = F.when(copies > 0, F.sequence(F.lit(0), copies - 1)).otherwise(F.array().cast("array<int>"))
    placed = placed.withColumn("positions", F.transform(numbers, lambda i: _time_of(middle(i))))
    return placed.select("row", "size", "source_size", "target", (F.col("rounds") * F.col("size") + F.col("last")).alias("taken"),
                         "positions")


def training_order(df: DataFrame, **options) -> DataFrame:
    """The rows of ``df`` with their own columns, one for each copy the mix takes, range-sorted by training position."""
    placed = plan(df, cut=False, **options).select("row", F.explode("positions").alias("position"))
    return placed.orderBy("position").select("row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = plan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return planned.select("row.doc_id", "size", "source_size", "target", "taken", F.size("positions").alias("copies"),
                          F.get("positions", F.lit(0)).alias("first_position")).orderBy(F.col("first_position").asc_nulls_last(), "doc_id")
