"""Benchmark decontamination with DataFrame functions only.

1. The test items' n-grams (an item shorter than ``words`` words is one n-gram) are written once with a 64-bit key each; the
   seed of the keys is raised until no two n-grams share one, so a key names one n-gram.
2. The set of (key, n-gram) is broadcast in blocks of at most about ``block_bytes`` bytes by count of its text: one block
   unless the test set is large, in which case the training texts are scanned once a block. A scan makes every window of a
   text, looks its key up, and verifies a hit on the words themselves; all inside one generated stage.
3. Hits are combined per document before they are shuffled, so a passage that a third of all documents hold costs a row a
   document. Covered words are the union of the hits' spans; items are joined to the distinct n-grams that a document holds.

A document may then be dropped, or lose the covered words with the separators before them (``decontaminated``).
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from govspark.llm.common import stored, table

#: What lies between words, which are maximal runs of digits, letters and all characters beyond ASCII, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The places behind a word and before a separator.
BEHIND_WORD = r"(?<=[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])(?=[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])"
_KEYS = ["row_key", "doc_id", "text_key", "copies", "n_words", "hits"]


@dataclass(frozen=True)
class Contamination:
    """Windows of ``words`` words; at most about ``block_bytes`` bytes of n-grams are broadcast at once."""

    words: int = 10
    block_bytes: int = 48 << 20
    #: N-grams of more characters stand in the broadcast as their SHA-256, so that an entry is bounded.
    entry_chars: int = 512


def words_of(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    # Split, for regexp_extract_all copies the whole text at every match.
    return F.array_remove(F.split(lower, BETWEEN), "")


def _gram(words: Column, how: Contamination) -> Column:
    text = F.array_join(words, " ")
    return F.when(F.length(text) > how.entry_chars, F.concat(F.lit(" "), F.sha2(text, 256))).otherwise(text)


def test_grams(items: DataFrame, how: Contamination) -> tuple[DataFrame, int]:
    """(key, size, gram, item_id), one row per item and distinct n-gram of it, and the seed of the keys."""
    words = items.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(how.words))
    spots = words.withColumn("size", size).select(
        "item_id", "words", "size", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)).alias("at"))
    part = F.slice("words", F.col("at"), F.col("size"))
    seed = 0
    while True:
        keyed = spots.select(F.xxhash64(F.lit(seed), part).alias("key"), "size", _gram(part, how).alias("gram"), "item_id")
        grams = stored(keyed.distinct(), "grams")
        shared = grams.groupBy("key").agg(F.min("gram").alias("low"), F.max("gram").alias("high")).where("low <> high")
        if shared.isEmpty():
            return grams, seed
        seed += 1


def scan(docs: DataFrame, items: DataFrame, how: Contamination = Contamination()) -> tuple[DataFrame, DataFrame]:
    """The documents with their hits, and the n-grams with their items.

    Documents: row_key, doc_id, text_key (MD5 of the text), copies (rows of this input partition that are equal), n_words,
    hits (start and end of each occurrence, counted in words from 1, and its n-gram's key)."""
    grams, seed = test_grams(items, how)
    entries = grams.select("key", "gram", "size").distinct()
    total, sizes = entries.agg(F.sum(F.octet_length("gram") + 64), F.collect_set("size")).first()
    blocks = max(1, -(-(total or 0) // how.block_bytes))
    sizes = sorted(sizes) or [how.words]
    text = F.coalesce(F.col("text"), F.lit(""))
    # A row that is equal to another of its partition is counted, so that many copies are one row from here on.
    rows = docs.select(F.spark_partition_id().alias("part"), "doc_id", F.md5(text).alias("text_key"), words_of(F.col("text")).alias("words"))
    if len(sizes) > 1:
        rows = rows.withColumn("size", F.explode(F.array(*map(F.lit, sizes))))
    else:
        rows = rows.withColumn("size", F.lit(sizes[0]))
    found = None
    for block in range(blocks):
        # Spot 0 stands for the document itself, in one block and for one size only.
        first = F.when((F.col("size") == sizes[0]) & F.lit(block == 0), 0).otherwise(1)
        last = F.size("words") - F.col("size") + 1
        spots = rows.where((last >= first) | (first == 0)).select(
            "*", F.explode(F.sequence(first, F.greatest(last, first))).alias("at"))
        part = F.slice("words", F.greatest(F.col("at"), F.lit(1)), F.col("size"))
        here = (F.col("at") > 0) & (F.size("words") >= F.col("at") + F.col("size") - 1)
        spots = spots.withColumn("key", F.when(here, F.xxhash64(F.lit(seed), part)))
        side = entries.where(F.pmod("key", F.lit(blocks)) == block).select(F.col("key").alias("gram_key"), "gram")
        # Joined on the key alone, so that words are put together for windows that hit only.
        met = spots.join(F.broadcast(side), F.col("key") == F.col("gram_key"), "left")
        same = F.col("gram_key").isNotNull() & (_gram(part, how) == F.col("gram"))
        met = met.where((F.col("at") == 0) | same).select(
            "part", "doc_id", "text_key", F.when(F.col("at") == 0, F.size("words")).alias("n_words"),
            F.when(F.col("at") > 0, F.struct(F.col("at"), (F.col("at") + F.col("size")).alias("end"), "gram_key")).alias("hit"))
        found = met if found is None else found.union(met)
    found = found.groupBy("part", "doc_id", "text_key").agg(
        F.count("n_words").alias("copies"), F.max("n_words").cast("long").alias("n_words"), F.collect_set("hit").alias("hits"))
    key = F.concat_ws(":", "part", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text_key")
    return stored(found.withColumn("row_key", key).select(*_KEYS), "hits"), grams


def covered(hits: Column) -> Column:
    """Words inside the union of the hits."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("reach"))
    step = lambda acc, h: F.struct((acc["n"] + F.greatest(F.lit(0), h["end"] - F.greatest(h["at"], acc["reach"]))).alias("n"),
                                   F.greatest(acc["reach"], h["end"]).alias("reach"))
    return F.aggregate(F.array_sort(hits), start, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, items: DataFrame, how: Contamination = Contamination()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (ids as sorted text), contaminated: one row per row of ``docs`` (doc_id, text).

    Null and blank texts have no words. Rows that repeat a doc_id are judged each by its own text. Items without words hit
    nothing; rows that repeat an item_id are one item; the n-grams of items without item_id hit words but are in no list.
    Texts of any length are one row of work in proportion to their words. Other columns are not read."""
    rows, grams = scan(docs, items, how)
    rows = rows.select("row_key", "doc_id", "copies", "n_words", covered(F.col("hits")).alias("n_hit"),
                       F.explode_outer(F.array_distinct(F.transform("hits", lambda h: h["gram_key"]))).alias("key"))
    named = rows.join(grams.select("key", F.col("item_id").cast("string").alias("item")), "key", "left")
    each = named.groupBy("row_key", "doc_id", "copies", "n_words", "n_hit").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return each.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, items: DataFrame, how: Contamination = Contamination(), remove: str = "documents") -> DataFrame:
    """``docs`` with its own columns, without the contaminated documents (``remove="documents"``), or with every covered word
    cut from its text together with the separators before it (``remove="spans"``). Null texts stay as they are."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    rows, _ = scan(docs, items, how)
    texts = rows.where(F.size("hits") > 0).groupBy("text_key").agg(F.any_value("hits").alias("hits"))
    own = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("_text"),
                      F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("text_key"))
    if remove == "documents":
        return own.join(texts, "text_key", "left_anti").select("_row.*")
    # Hits that touch or overlap are one span: a span starts where no earlier hit reaches.
    each = texts.select("text_key", F.inline(F.array_sort("hits")))
    reach = F.expr("max(end) OVER (PARTITION BY text_key ORDER BY at, end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    island = F.expr("sum(new) OVER (PARTITION BY text_key ORDER BY at, end ROWS UNBOUNDED PRECEDING)")
    spans = each.withColumn("new", F.when(F.col("at") > F.coalesce(reach, F.lit(0)), 1).otherwise(0)).withColumn("island", island) \
        .groupBy("text_key", "island").agg(F.min("at").alias("at"), F.max("end").alias("end")) \
        .groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("at", "end"))).alias("spans"))
    # One piece for each word with the separators before it, and one of the last separators if there are any.
    pieces = F.split("_text", BEHIND_WORD)
    rows = own.join(spans, "text_key", "left").withColumn("_pieces", F.when(F.col("spans").isNotNull(), pieces))
    # What stays lies between the end of a span and the start of the next one.
    ends = F.concat(F.array(F.lit(1)), F.transform("spans", lambda s: s["end"]))
    starts = F.concat(F.transform("spans", lambda s: s["at"]), F.array(F.size("_pieces") + 1))
    gaps = F.zip_with(ends, starts, lambda a, b: F.slice("_pieces", a, b - a))
    cut = F.when(F.col("spans").isNull(), F.col("_text")).otherwise(F.array_join(F.flatten(gaps), ""))
    out = rows.select("_row", cut.alias("_cut"))
    return out.select(*[F.col("_cut").alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
