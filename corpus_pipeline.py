"""From raw documents to token ids: quality rules, toxicity, near-duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns the rows that go on, with the columns of ``docs``; the last returns a row
of digests per encoded document. ``run`` writes each stage's rows to the shared folder and reads them back as the next
one's input, so a lost executor costs no more than the stage it was in. A document that the mix repeats comes out repeatedly.

Every stage takes null and repeated ids, null and empty texts, texts of any length, and other columns of any name, and keeps
those columns as they are; an empty table gives an empty one. Each stage says what becomes of the odd rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from govspark.llm import bpe, mixing, near_dedup, repetition, toxicity
from govspark.llm.common import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the verdict on their repeated substrings.

    Null, empty and blank texts have fewer than ten words and go. Rows are judged one by one: equal rows fare alike."""
    return repetition.keep(docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold by a network trained on the labelled ones among them.

    Texts without words are not toxic. Rows are scored one by one, those without doc_id too, which no label reaches."""
    return toxicity.keep(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingles of five words and a similarity of 0.8 or more.

    It is the one of smallest doc_id; of rows that repeat that doc_id the first by text stays. Texts without words are linked
    with nothing; rows without doc_id are in no group and stay."""
    return near_dedup.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents in training order, each as often as its source's target asks.

    A null source is a source. Documents without words are taken by no target and go. Ties in the order follow doc_id and
    size."""
    return mixing.training_order(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, as counts and digests: a row for each row of ``docs``, empty and null texts without ids."""
    import public_tokenizers
    vocabulary = bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.round_trip(docs, vocabulary, public_tokenizers.PATTERN)


STAGES = [("quality_rules", quality_rules), ("toxicity", drop_toxic), ("near_dedup", near_dedup_stage), ("mixing", mix),
          ("byte_bpe", encode)]

#: A trained network decides in the second stage, which SQL cannot express; tests compare with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
