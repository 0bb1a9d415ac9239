"""Byte-level BPE: exact encoding of pre-tokens of any length by a rank queue, and decoding.

The queue is a hierarchical bitmap over merge ranks. A set bit says that the bucket of that rank holds positions of a
linked list of parts; find-first-set on each level gives the lowest rank. Many pre-tokens lie in one list, since merges in
one do not touch another: a bucket's merges are then made together, leftmost first where they overlap, which for each
pre-token is the order of repeated search for its lowest pair. Entries whose pair has changed since are skipped. A piece
of n bytes costs O(n log n) whatever it holds, so a text that is one long word is no special case.

Pieces repeat, so each worker remembers what it has encoded, up to a bound. A blank between two non-blank characters is
always a cut of the pattern, so in texts where every blank is such a one, the runs between blanks are looked up whole.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from govspark.llm.common import over_batches, table, unpacked

#: Runs a worker remembers before it starts anew.
CACHE_ENTRIES = 300_000
#: Characters encoded together, and positions whose pairs are looked up together: a worker's memory follows from both.
PASS_CHARS, OFFER = 2 << 20, 1 << 17
#: Runs longer than this are not remembered.
CACHE_BYTES = 64

_BITS, _MASK = 6, 63


class RankQueue:
    """Arrays of positions by rank; ``pop`` gives the lowest rank with all its positions. Empty again after use."""

    def __init__(self, ranks: int):
        self.buckets: list[list[np.ndarray]] = [[] for _ in range(ranks)]
        self.levels: list[list[int]] = []
        while ranks > 1 or not self.levels:
            ranks = (ranks + _MASK) >> _BITS
            self.levels.append([0] * ranks)

    def push(self, rank: int, positions: np.ndarray) -> None:
        bucket = self.buckets[rank]
        if not bucket:
            at = rank
            for level in self.levels:
                bit, at = 1 << (at & _MASK), at >> _BITS
                was = level[at]
                level[at] = was | bit
                if was:
                    break
        bucket.append(positions)

    def pop(self) -> tuple[int, np.ndarray] | None:
        if not self.levels[-1][0]:
            return None
        rank = 0
        for level in reversed(self.levels):
            word = level[rank]
            rank = rank << _BITS | (word & -word).bit_length() - 1
        bucket, self.buckets[rank] = self.buckets[rank], []
        at = rank
        for level in self.levels:
            bit, at = 1 << (at & _MASK), at >> _BITS
            level[at] &= ~bit
            if level[at]:
                break
        return rank, bucket[0] if len(bucket) == 1 else np.concatenate(bucket)


class Codec:
    """Encoder and decoder for one vocabulary of (bytes, rank) and one pattern of pre-tokens."""

    def __init__(self, vocabulary: bytes, pattern: str):
        pairs = (line.split() for line in vocabulary.splitlines() if line.strip())
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.token = {rank: token for token, rank in self.ranks.items()}
        self.top = max(self.token, default=0) + 1
        self.queue = RankQueue(self.top)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        made = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    made[left * self.top + right] = rank
        # The last entry stands for every pair that makes no token.
        self.pair_keys = np.array([*sorted(made), np.iinfo(np.int64).max], dtype=np.int64)
        self.pair_ranks = np.array([*(made[k] for k in sorted(made)), -1], dtype=np.int32)
        self.split = regex.compile(pattern).findall
        self.runs: dict[str, bytes | None] = {}

    def _pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.top + right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of each pre-token."""
        data = b"".join(pieces)
        n = len(data)
        ends = np.cumsum([len(p) for p in pieces])
        parts = np.append(self.byte_ids[np.frombuffer(data, np.uint8)], np.int32(0))
        kind = np.int32 if n < 1 << 30 else np.int64
        after, before = np.arange(1, n + 2, dtype=kind), np.arange(-1, n, dtype=kind)
        after[ends - 1] = n  # position n ends every list
        before[ends[:-1]] = -1
        wants = np.full(n + 1, -1, dtype=np.int32)
        queue = self.queue

        def offer(at: np.ndarray) -> None:
            at = at[after[at] < n]
            rank = self._pair_rank(parts[at], parts[after[at]])
            wants[at] = rank
            at, rank = at[rank >= 0], rank[rank >= 0]
            if len(at):
                order = np.argsort(rank, kind="stable")
                at, rank = at[order], rank[order]
                cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
                for r, group in zip(rank[np.append(0, cuts)].tolist(), np.split(at, cuts) if len(cuts) else [at]):
                    queue.push(r, group)

        for a in range(0, n, OFFER):
            offer(np.arange(a, min(a + OFFER, n), dtype=kind))
        while entry := queue.pop():
            rank, at = entry
            at = at[wants[at] == rank]
            if len(at) > 1:
                at = np.unique(at)
                chained = np.append(False, after[at[:-1]] == at[1:])
                if chained.any():  # of overlapping pairs every other one, from the left
                    index = np.arange(len(at))
                    at = at[(index - np.maximum.accumulate(np.where(chained, 0, index))) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            rest = after[gone]
            parts[at], parts[gone] = rank, -1
            wants[at], wants[gone] = -1, -1
            after[at] = rest
            before[rest] = at
            left = before[at]
            offer(np.concatenate((at, left[left >= 0])))
        alive = parts[:n] >= 0
        packed = parts[:n][alive].astype("<u4").tobytes()
        stops = np.append(0, 4 * np.cumsum(alive)[ends - 1]).tolist()
        return [packed[a:b] for a, b in zip(stops, stops[1:])]

    def _encode_runs(self, runs: list[str]) -> list[bytes]:
        cut = [self.split(r) for r in runs]
        fresh = list({p for c in cut for p in c})
        raw = [p.encode() for p in fresh]
        whole = [self.ranks.get(p) for p in raw]
        merged = iter(self.merge([p for p, w in zip(raw, whole) if w is None]) if None in whole else ())
        known = {p: next(merged) if w is None else w.to_bytes(4, "little") for p, w in zip(fresh, whole)}
        return [known[c[0]] if len(c) == 1 else b"".join([known[p] for p in c]) for c in cut]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        runs = self.runs
        cut = [t.split(" ") for t in texts]
        used = set().union(*cut)
        fresh = used - runs.keys()
        if len(runs) + len(fresh) > CACHE_ENTRIES:
            fresh = used
            runs.clear()
        # A blank beside white space is no sure cut; None stands for a run with such an edge.
        sure = [r for r in fresh if r and r == r.strip()]
        runs.update(dict.fromkeys(fresh))
        runs.update(zip(sure, self._encode_runs([" " + r for r in sure])))
        whole, out = [], []
        for i, parts in enumerate(cut):
            first = parts[0]
            if len(parts) > 1 and first and not first[-1].isspace():
                packed = [runs[r] for r in parts]
                if None not in packed:
                    out.append(b"".join(packed[1:]))
                    whole.append(first)
                    continue
            out.append(b"")
            whole.append(texts[i])
        out = [head + tail for head, tail in zip(self._encode_runs(whole), out)]
        for r in fresh:
            if len(r) > CACHE_BYTES:
                del runs[r]
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids packed by ``encode`` stand for."""
        return b"".join(map(self.token.__getitem__, memoryview(ids).cast("I")))


_codecs: dict[tuple[bytes, str], Codec] = {}


def codec(vocabulary: bytes, pattern: str) -> Codec:
    """One codec per worker and vocabulary."""
    key = (hashlib.sha256(vocabulary).digest(), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(vocabulary, pattern)
    return _codecs[key]


def _digest(df: DataFrame, vocabulary: bytes, pattern: str, schema: str, columns) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)  # one vocabulary file, under 1 MB

    def run(batch: pa.RecordBatch):
        own = codec(shared.value, pattern)
        for ids, texts in unpacked(batch, PASS_CHARS):
            yield columns(own, ids, [t or "" for t in texts])

    return over_batches(df.select("doc_id", "text"), run, schema)


def encode(df: DataFrame, vocabulary: bytes, pattern: str) -> DataFrame:
    """doc_id, ids (array of int) of every whole text; null and empty texts have no ids. Rows are taken as they come, with
    repeated and null doc_id kept; other columns are not carried."""

    def columns(own, ids, texts):
        return {"doc_id": ids, "ids": [memoryview(p).cast("I").tolist() for p in own.encode(texts)]}

    return _digest(df, vocabulary, pattern, "doc_id long, ids array<int>", columns)


def decode(df: DataFrame, vocabulary: bytes, pattern: str) -> DataFrame:
    """doc_id, data (binary) from doc_id, ids; null ids give empty data. Bytes, since a cut sequence need not be UTF-8."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batch: pa.RecordBatch):
        own = codec(shared.value, pattern)
        ids, rows = batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()
        yield {"doc_id": ids, "data": [b"".join(map(own.token.__getitem__, r or ())) for r in rows]}

    return over_batches(df.select("doc_id", "ids"), run, "doc_id long, data binary")


def round_trip(df: DataFrame, vocabulary: bytes, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip_ok of every row: encoded, and decoded from its ids."""

    def columns(own, ids, texts):
        packed = own.encode(texts)
        plain = [own.decode(p) for p in packed]
        return {"doc_id": ids, "n_tokens": [len(p) // 4 for p in packed],
                "ids_sha256": [hashlib.sha256(p).hexdigest() for p in packed],
                "decoded_sha256": [hashlib.sha256(p).hexdigest() for p in plain],
                "round_trip_ok": [p == t.encode() for p, t in zip(plain, texts)]}

    return _digest(df, vocabulary, pattern, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, "
                                            "round_trip_ok boolean", columns)


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    vocabulary = read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return round_trip(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)
