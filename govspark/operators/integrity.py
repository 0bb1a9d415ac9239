"""Tamper evidence of the audit log: sealing, verification, missing sequence numbers.

A hash chain is sequential by nature, so a chain is sealed in segments of a bounded number of
sequence numbers, each starting like a fresh log file (previous hash ''). An anchor table chains the
segments: its rows hold each segment's size and last hash, and are linked to the segment before. A row keeps its position
in its segment, so neither verification nor anchors depend on how rows that share a sequence number lie. A hash tree over
each segment proves one record by as many hashes as the logarithm of the segment.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from govspark.operators import ordered
from govspark.runtime import floor_to

SEGMENT = 100_000
HASHED = ["sequence_num", "ts_us", "user_name", "sql_text", "decision"]


def _digest(previous: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in HASHED], previous), 256)


def seal(log: DataFrame, chain: str, segment_rows: int = SEGMENT) -> DataFrame:
    """Add segment, chain_pos, previous_hash and record_hash; every row comes out once, with all its columns.

    Rows are hash-partitioned by segment and sorted, and each partition streams through the fold in Arrow batches: no segment
    is ever held whole, and nothing is joined back. The Python side only chains digests; the hashed text of each row is
    assembled by Spark. Rows that share a sequence number are chained in the order of their text. Rows without chain or
    sequence number have no place in a chain and stay unsealed (NULL hashes).
    """
    body = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in HASHED])
    tagged = log.withColumn("segment", floor_to("sequence_num", segment_rows)).withColumn("_body", body)
    ordered_rows = tagged.repartition(chain, "segment").sortWithinPartitions(chain, "segment", "sequence_num", "_body")
    hashes = [T.StructField("chain_pos", T.LongType()), T.StructField("previous_hash", T.StringType()), T.StructField("record_hash", T.StringType())]
    schema = T.StructType([f for f in tagged.schema.fields if f.name != "_body"] + hashes)

    def fold(batches):
        target = to_arrow_schema(schema)
        at, previous, n = None, "", 0
        for batch in batches:
            places, links, digests = [], [], []
            for c, s, text in zip(*(batch.column(n).to_pylist() for n in (chain, "segment", "_body"))):
                if c is None or s is None:
                    places.append(None)
                    links.append(None)
                    digests.append(None)
                    continue
                if (c, s) != at:
                    at, previous, n = (c, s), "", 0
                n += 1
                places.append(n)
                links.append(previous)
                previous = hashlib.sha256(f"{text}|{previous}".encode()).hexdigest()
                digests.append(previous)
            made = {"chain_pos": pa.array(places, pa.int64()), "previous_hash": pa.array(links, pa.string()), "record_hash": pa.array(digests, pa.string())}
            yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else batch.column(f.name).cast(f.type) for f in target], schema=target)

    return ordered_rows.mapInArrow(fold, schema)


def anchors(sealed: DataFrame, chain: str) -> DataFrame:
    """One row per segment: rows, last hash, and a hash that also covers the previous segment's end."""
    last = sealed.groupBy(chain, "segment").agg(
        F.count(F.lit(1)).alias("rows"), F.max_by("record_hash", "chain_pos").alias("last_hash"))
    # Over the segment summaries only: one row per SEGMENT log rows.
    before = F.coalesce(F.lag("last_hash").over(W.partitionBy(chain).orderBy("segment")), F.lit(""))
    return last.withColumn("anchor_hash", F.sha2(F.concat_ws("|", F.col("segment").cast("string"), F.col("rows").cast("string"),
                                                            "last_hash", before), 256))


def verify(sealed: DataFrame, chain: str) -> DataFrame:
    """Add ``status``: ok, unplaced (no chain or sequence number), unsealed (no hash), bad_hash (content edited), bad_link
    (row removed or moved). What is cut off at an end leaves no trace here: see ``verify_anchors``."""
    linked = ordered.previous_row(sealed, [chain, "segment"], ["chain_pos"], {"_prior": "record_hash"}, bounded=True)
    status = (F.when(F.col(chain).isNull() | F.col("sequence_num").isNull(), "unplaced")
              .when(F.col("record_hash").isNull() | (F.col("record_hash") == ""), "unsealed")
              .when(_digest(F.col("previous_hash")) != F.col("record_hash"), "bad_hash")
              .when(F.col("previous_hash") != F.coalesce("_prior", F.lit("")), "bad_link")
              .otherwise("ok"))
    return linked.withColumn("status", status).drop("_prior")


def verify_anchors(sealed: DataFrame, stored: DataFrame, chain: str) -> DataFrame:
    """Segments whose size, end or history differ from the stored anchors (cut tails, lost segments)."""
    now = anchors(sealed, chain).select(chain, "segment", F.col("rows").alias("_r"), F.col("anchor_hash").alias("_a"))
    both = stored.join(now, [chain, "segment"], "full")
    status = (F.when(F.col("_a").isNull(), "missing_segment").when(F.col("anchor_hash").isNull(), "unknown_segment")
              .when((F.col("rows") != F.col("_r")) | (F.col("anchor_hash") != F.col("_a")), "changed").otherwise("ok"))
    return both.select(chain, "segment", status.alias("status"))


def broken(sealed: DataFrame, stored: DataFrame, chain: str) -> DataFrame:
    """One row with ``broken``: rows that do not verify, and segments that differ from their anchors (cut tails among them)."""
    rows = verify(sealed, chain).agg(F.count_if(F.col("status") != "ok").alias("n"))
    segments = verify_anchors(sealed, stored, chain).agg(F.count_if(F.col("status") != "ok").alias("n"))
    return rows.union(segments).agg(F.sum("n").alias("broken"))


def sequence_gaps(log: DataFrame, chain: list[str]) -> DataFrame:
    """Ranges of sequence numbers missing inside a chain."""
    steps = ordered.previous_row(log.select(*chain, "sequence_num"), chain, ["sequence_num"], {"_before": "sequence_num"})
    return steps.filter(F.col("sequence_num") - F.col("_before") > 1).select(
        *chain, (F.col("_before") + 1).alias("gap_start"), (F.col("sequence_num") - 1).alias("gap_end"),
        (F.col("sequence_num") - F.col("_before") - 1).alias("missing"))


def hash_tree(sealed: DataFrame, chain: str) -> DataFrame:
    """Nodes of a hash tree over the records of each segment: chain, segment, level, place (from 0), hash.

    Level 0 are the record hashes in chain order; a node above covers two below, and a last node without a partner is moved
    up as it is. The highest level has one node, the segment's root. Segments stream through sorted partitions, with one open
    node per level in memory."""
    rows = sealed.where(F.col("record_hash").isNotNull() & F.col("chain_pos").isNotNull()).select(chain, "segment", "chain_pos", "record_hash")
    rows = rows.repartition(chain, "segment").sortWithinPartitions(chain, "segment", "chain_pos")
    schema = T.StructType([rows.schema[chain], rows.schema["segment"], T.StructField("level", T.IntegerType()),
                           T.StructField("place", T.LongType()), T.StructField("hash", T.StringType())])

    def fold(batches):
        target = to_arrow_schema(schema)
        out: list[tuple] = []
        open_nodes: list[tuple[int, str]] = []  # (place, hash) of the last node of every level
        waits: list[bool] = []  # does that node wait for its partner?
        at = None

        def add(level: int, digest: str) -> None:
            while True:
                if level == len(open_nodes):
                    open_nodes.append((-1, ""))
                    waits.append(False)
                place, left = open_nodes[level][0] + 1, open_nodes[level][1]
                open_nodes[level] = (place, digest)
                out.append((*at, level, place, digest))
                waits[level] = not waits[level]
                if waits[level]:
                    return
                digest, level = hashlib.sha256((left + digest).encode()).hexdigest(), level + 1

        def close() -> None:
            level = 0
            while level < len(open_nodes):
                if waits[level] and (level + 1 < len(open_nodes)):
                    waits[level] = False
                    add(level + 1, open_nodes[level][1])
                level += 1
            open_nodes.clear()
            waits.clear()

        def flush():
            columns = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

        for batch in batches:
            for c, s, digest in zip(*(batch.column(n).to_pylist() for n in (chain, "segment", "record_hash"))):
                if (c, s) != at:
                    close()
                    at = (c, s)
                add(0, digest)
            if out:
                yield flush()
        close()
        if out:
            yield flush()

    return rows.mapInArrow(fold, schema)


def tree_roots(tree: DataFrame, chain: str) -> DataFrame:
    """(chain, segment, root_hash): the one node of the highest level of each segment."""
    return tree.groupBy(chain, "segment").agg(F.max_by("hash", "level").alias("root_hash"))


def record_proof(tree: DataFrame, chain: str, chain_id, segment: int, chain_pos: int) -> list[tuple[int, bool, str]]:
    """(level, partner is on the right, its hash) of the nodes that lead from a record to its segment's root: no more than
    the tree has levels."""
    mine = tree.where((F.col(chain) == F.lit(chain_id)) & (F.col("segment") == segment))
    rows = mine.where(F.expr(f"place = (shiftright({chain_pos - 1}L, level) ^ 1)"))
    return sorted((r["level"], r["place"] % 2 == 1, r["hash"]) for r in rows.select("level", "place", "hash").collect())


def proves(record_hash: str, proof: list[tuple[int, bool, str]], root_hash: str) -> bool:
    """Do the partners of ``record_proof`` lead from the record to the root?"""
    digest = record_hash
    for _, right, partner in proof:
        digest = hashlib.sha256((digest + partner if right else partner + digest).encode()).hexdigest()
    return digest == root_hash
