"""Quality by an interpolated modified Kneser-Ney model over characters.

The model is a set of count tables of 1- to ``ORDER``-grams, made from all trusted texts: counts of the longest grams, and for
shorter ones the number of different characters before them. All of it stays in Spark, spread by gram. To score, each batch of
documents asks for its distinct grams once; a join with the count tables answers with log-probabilities, one row per batch
and gram, and the batch sums them per document. A document is kept if its perplexity is at most its language's quantile among
trusted documents that it was not trained on, with some room.

Batches are the splits of the input, cut to bounded size. Their texts are written once, compressed and bucketed by split, so
only grams and probabilities are shuffled, never texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govspark.llm.common import slices, stored, table
from govspark.runtime import shared_dir

ORDER = 4
#: Share of a language's trusted documents that its perplexity threshold admits, and the room it leaves above their quantile,
#: as a factor, since another sample's quantile is not the same.
ADMITTED, ROOM = 0.995, 1.25
#: One trusted document in so many sets thresholds instead of training, as those trained on are easier to predict.
HELD_OUT = 4
#: Characters of a batch, about; a longer text is a batch of its own.
BATCH_CHARS = 5 << 19
#: Grams in a row of the stored requests, and the bits of a place beside a batch's number.
ROW_GRAMS, PLACE_BITS = 1 << 16, 40
#: Numbers in a table that ranks grams.
DENSE = 1 << 22
_EDGE = "\n"  # no other character becomes it
_space = regex.compile(r"\s+")
_separators = regex.compile(r"[\x1c-\x1f]")


def plain(text: str | None) -> str:
    """What the model reads: lower case, white space as single blanks, edges marked."""
    text = text or ""
    # Only these four are white space to Python alone.
    single = _space.sub(" ", text).strip() if _separators.search(text) else " ".join(text.split())
    return _EDGE * (ORDER - 1) + single.lower() + _EDGE


def _ranked(key: np.ndarray, size: int) -> tuple[int, np.ndarray]:
    """How many values ``key``, of numbers below ``size``, has, and the rank of each of its numbers among them."""
    if size > DENSE:
        found, at = np.unique(key, return_inverse=True)
        return len(found), at.astype(np.int32)
    rank = np.zeros(size, dtype=np.int32)
    rank[key] = 1
    found = np.flatnonzero(rank)
    rank[found] = np.arange(len(found), dtype=np.int32)
    return len(found), rank[key]


def grams(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct grams of prepared texts in their order, the gram of each place, and the number of places of each text.

    A gram's number is its characters' ranks as digits. A table of all numbers there could be ranks them without a sort, for
    beginnings of grams too, where whole grams would need a larger table; numbers beyond any table are sorted once."""
    joined = "".join(texts)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    characters, last = _ranked(np.frombuffer(joined.encode("utf-32-le"), np.uint32), 0x110000)
    size, at = characters, last
    for i in range(1, ORDER):
        if size * characters > (DENSE if size <= DENSE else 1 << 62):
            size, at = _ranked(at, size)
        size *= characters
        at = at[:-1].astype(np.int32 if size < 1 << 31 else np.int64, copy=False) * characters + last[i:]
    inside = np.ones(len(at), dtype=bool)
    inside[(np.cumsum(lengths)[:-1, None] - np.arange(1, ORDER)).ravel()] = False  # not across two texts
    n, at = _ranked(at[inside], size)
    example = np.empty(n, dtype=np.int64)
    example[at] = np.flatnonzero(inside)
    return [joined[i:i + ORDER] for i in example.tolist()], at, lengths - ORDER + 1


def _packed(texts: list[str]) -> bytes:
    return zstandard.ZstdCompressor(level=6).compress("\x00".join(t.replace("\x00", " ") for t in texts).encode())


def _unpacked(payload: bytes) -> list[str]:
    return zstandard.ZstdDecompressor().decompress(payload).decode().split("\x00")


def batches(docs: DataFrame) -> str:
    """The name of a table of split, batch, doc_ids, langs, payload: the documents in batches, written bucketed by split."""
    spark = docs.sparkSession

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, number = TaskContext.get().partitionId(), 0
        for part in parts:
            ids, langs, texts = (part.column(c).to_pylist() for c in ("doc_id", "lang", "text"))
            for a, b in slices(texts, BATCH_CHARS):
                row = [[split], [number], [ids[a:b]], [langs[a:b]], [_packed([plain(t) for t in texts[a:b]])]]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(row, kinds)], names=names)
                number += 1

    names = ["split", "batch", "doc_ids", "langs", "payload"]
    kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.binary()]
    packed = docs.select("doc_id", "lang", "text").mapInArrow(
        run, "split int, batch int, doc_ids array<long>, langs array<string>, payload binary")
    name = f"lm_batches_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed.write.option("path", shared_dir(spark, name)).option("compression", "none").bucketBy(buckets, "split").saveAsTable(name)
    return name


def _renewed(df: DataFrame) -> DataFrame:
    """The same columns under new identities, for a cogroup with the table they come from."""
    return df.select(*(F.col(c).alias(c) for c in df.columns))


def count_grams(packed: DataFrame, chosen: DataFrame) -> DataFrame:
    """gram, n over the documents that ``chosen`` (split, batch, places) names; places count from 0 within a batch."""
    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        places = {(r.split, r.batch): r.places for r in right.itertuples()}
        out = []
        for row in left.itertuples():
            if (row.split, row.batch) in places:
                texts = _unpacked(row.payload)
                found, at, _ = grams([texts[i] for i in places[row.split, row.batch]])
                out.append(pd.DataFrame({"gram": found, "n": np.bincount(at)}))
        return pd.concat(out) if out else pd.DataFrame({"gram": [], "n": []}).astype({"gram": str, "n": "int64"})

    counted = packed.select("split", "batch", "payload").groupBy("split").cogroup(_renewed(chosen).groupBy("split")).applyInPandas(run, "gram string, n long")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"))


def model(counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1 to ``ORDER`` two tables: (gram, own), the discounted share of a gram in its context, and
    (context, spare), the mass that the discounts of a context leave to the next lower order."""
    tables, orders = counts, []
    for k in range(ORDER, 0, -1):
        seen = tables.agg(*(F.sum(F.when(F.col("n") == i, 1).otherwise(0)).alias(f"n{i}") for i in range(1, 5))).first()
        n = [float(seen[f"n{i}"] or 0) for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        # Modified discounts; where too few grams tell, a plain discount.
        d = [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05), i - 0.05) if n[i - 1] and n[i] else min(y, i - 0.05) for i in (1, 2, 3)]
        discount = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        context = F.substring("gram", 1, k - 1)
        rows = tables.select("gram", "n", context.alias("context"), discount.alias("d"))
        totals = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum("d").alias("left"))
        own = rows.join(totals, "context").select("gram", ((F.col("n") - F.col("d")) / F.col("total")).alias("own"))
        orders.insert(0, (own, totals.select("context", (F.col("left") / F.col("total")).alias("spare"))))
        tables = tables.groupBy(F.substring("gram", 2, k - 1).alias("gram")).agg(F.count("*").alias("n"))
    return orders


def log_probabilities(wanted: DataFrame, orders: list[tuple[DataFrame, DataFrame]], characters: int) -> DataFrame:
    """gram, log_p for distinct grams: own shares joined from the longest to the shortest suffix, weighed by spare masses.

    A context never seen leaves all mass to the lower order; below order 1 every character, seen or not, is as likely."""
    rows = wanted.select("gram", F.lit(0.0).alias("p"), F.lit(1.0).alias("weight"))
    for k in range(ORDER, 0, -1):
        own, spare = orders[k - 1]
        suffix = F.substring("gram", ORDER - k + 1, k)
        rows = rows.withColumn("suffix", suffix).withColumn("context", F.substring("suffix", 1, k - 1))
        rows = rows.join(own.withColumnRenamed("gram", "suffix"), "suffix", "left").join(spare, "context", "left").select(
            "gram", (F.col("p") + F.col("weight") * F.coalesce("own", F.lit(0.0))).alias("p"),
            (F.col("weight") * F.coalesce("spare", F.lit(1.0))).alias("weight"))
    return rows.select("gram", F.ln(F.col("p") + F.col("weight") / (characters + 1)).alias("log_p"))


def requests(packed: DataFrame) -> DataFrame:
    """split, batch, first, grams: the distinct grams of each batch in their order, in rows of bounded size; ``first`` is the
    place of a row's first. Neighbours share their beginnings, so they are stored in a fraction of their size."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for split, batch, payload in zip(*(part.column(c).to_pylist() for c in ("split", "batch", "payload"))):
                found = grams(_unpacked(payload))[0]
                for a in range(0, len(found), ROW_GRAMS):
                    yield pa.RecordBatch.from_arrays([pa.array([split], pa.int32()), pa.array([batch], pa.int32()), pa.array([a], pa.int64()),
                                                      pa.array([found[a:a + ROW_GRAMS]], pa.list_(pa.string()))], names=["split", "batch", "first", "grams"])

    return packed.select("split", "batch", "payload").mapInArrow(run, "split int, batch int, first long, grams array<string>")


def perplexities(packed: DataFrame, asked: DataFrame, orders: list[tuple[DataFrame, DataFrame]], characters: int) -> DataFrame:
    """doc_id, lang, n_chars (scored characters), perplexity of every document of the batches."""
    known = log_probabilities(asked.select(F.explode("grams").alias("gram")).distinct(), orders, characters)
    # Batch and place are one number, as both are sent with every gram.
    places = asked.select("split", "batch", "first", F.posexplode("grams").alias("pos", "gram")).select(
        "split", (F.shiftleft(F.col("batch").cast("long"), PLACE_BITS) + F.col("first") + F.col("pos")).alias("place"), "gram")
    answers = places.join(known, "gram").select("split", "place", F.col("log_p").cast("float").alias("log_p"))

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("place")
        cuts = np.searchsorted(right["place"].to_numpy(), left["batch"].to_numpy(np.int64) << PLACE_BITS)
        out = []
        for row, start in zip(left.itertuples(), cuts):
            found, at, sizes = grams(_unpacked(row.payload))
            log_p = right["log_p"].to_numpy(np.float64)[start:start + len(found)]
            total = np.add.reduceat(log_p[at], np.cumsum(sizes) - sizes)
            out.append(pd.DataFrame({"doc_id": pd.array(row.doc_ids, dtype="Int64") if None in row.doc_ids else row.doc_ids,
                                     "lang": row.langs, "n_chars": sizes, "perplexity": np.exp(-total / sizes)}))
        return pd.concat(out) if out else pd.DataFrame({"doc_id": [], "lang": [], "n_chars": [], "perplexity": []})

    return packed.groupBy("split").cogroup(_renewed(answers).groupBy("split")).applyInPandas(run, "doc_id long, lang string, n_chars long, perplexity double")


def score(docs: DataFrame, labels: DataFrame, admitted: float = ADMITTED) -> DataFrame:
    """doc_id, lang, n_chars, perplexity, threshold, kept of every row of ``docs``.

    Trusted documents are those that ``labels`` gives quality 1. A language without trusted documents, also null, takes the
    quantile of all trusted ones; without any trusted document the model is uniform and all are kept. Null and empty texts
    are scored by their edge alone and judged like others; repeated and null doc_id are scored row by row."""
    spark, name = docs.sparkSession, batches(docs)
    trusted = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    apart = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0
    places = spark.table(name).select("split", "batch", F.posexplode("doc_ids").alias("place", "doc_id")).join(trusted.where(~apart), "doc_id")
    chosen = places.groupBy("split", "batch").agg(F.sort_array(F.collect_list("place")).alias("places"))
    counts = stored(count_grams(spark.table(name), chosen), "grams")
    orders = model(counts)
    characters = counts.select(F.substring("gram", ORDER, 1)).distinct().count()
    scored = stored(perplexities(spark.table(name), stored(requests(spark.table(name)), "requests", "zstd"), orders, characters), "perplexities")
    good = scored.join(trusted.where(apart), "doc_id")
    limit = ROOM * F.percentile_approx("perplexity", admitted, 10_000)
    by_lang = {r["lang"]: r["t"] for r in good.groupBy("lang").agg(limit.alias("t")).collect()}  # one row per language
    overall = good.agg(limit.alias("t")).first()["t"]
    threshold = F.lit(overall if overall is not None else float("inf"))
    for lang, t in by_lang.items():
        if lang is not None:
            threshold = F.when(F.col("lang") == lang, t).otherwise(threshold)
    return scored.select("doc_id", "lang", "n_chars", "perplexity", threshold.alias("threshold"), (F.col("perplexity") <= threshold).alias("kept"))


def op2_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
