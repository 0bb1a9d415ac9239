"""Token ids in compact files: canonical length-limited Huffman codes from global counts, in independent blocks.

A dataset is a folder with two Parquet tables. ``codes`` holds the code length of each id that occurs; lengths alone give the
canonical codes. ``blocks`` holds the ids in ascending doc_id order: each block has whole documents of about ``BLOCK_IDS`` ids
together, their doc_id and sizes, the packed bits, and the bit offset of every ``STEP``-th id. A block is decoded by one table
look-up per id, from all its offsets side by side. Blocks number their part and the ids before them in it, so the
place of a document among all ids follows from the sums of the parts.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from govspark.llm.common import over_batches, stored, table, unpacked
from govspark.runtime import shared_dir

#: Longest code in bits; a decoding table has two to the power of it entries.
LONGEST = 18
BLOCK_IDS, STEP = 1 << 15, 256
#: Blocks that are decoded together.
TOGETHER = 32
#: Runs of text in each of a worker's two memories of them (pre-tokens: twice as many), and the longest of either.
CACHE_ENTRIES, CACHE_CHARS = 150_000, 64
#: Pre-tokens in one call of the library.
WORDS = 512
PASS_CHARS = 4 << 20


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal prefix-code lengths of at most ``longest`` bits by package-merge; 0 for ids that do not occur.

    Every level pairs the packages of the one below and merges them with the ids by weight. Taking the 2n - 2 lightest items
    of the last level, an id is as long as the number of levels in which it is taken."""
    lengths = np.zeros(len(counts), dtype=np.uint8)
    ids = np.flatnonzero(counts)
    if len(ids) < 2:
        lengths[ids] = 1
        return lengths
    if len(ids) > 1 << longest:
        raise ValueError(f"{len(ids)} ids do not fit into codes of {longest} bits")
    ids = ids[np.argsort(counts[ids], kind="stable")]
    weights = counts[ids].astype(np.int64)
    levels, packages = [], np.empty(0, dtype=np.int64)
    for _ in range(longest):
        merged = np.concatenate((weights, packages))
        order = np.argsort(merged, kind="stable")
        levels.append(order < len(ids))  # which items are single ids
        merged = merged[order]
        packages = merged[:len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * len(ids) - 2
    for single in reversed(levels):
        own = int(single[:take].sum())
        lengths[ids[:own]] += 1
        take = 2 * (take - own)
    return lengths


class Code:
    """Canonical codes of given lengths: shorter first, of equal length by id."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.width = max(int(self.lengths.max(initial=0)), 1)
        order = np.lexsort((np.arange(len(lengths)), self.lengths))
        order = order[self.lengths[order] > 0]
        spans = np.int64(1) << (self.width - self.lengths[order])
        starts = np.cumsum(spans) - spans
        self.codes = np.zeros(len(lengths), dtype=np.uint64)
        self.codes[order] = (starts >> (self.width - self.lengths[order])).astype(np.uint64)
        self.symbol = np.zeros(1 << self.width, dtype=np.int32)
        self.symbol[:spans.sum()] = np.repeat(order, spans)
        self.length = self.lengths[self.symbol]

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The codes of ``ids`` one after the other, most significant bit first, and the bit offset of every STEP-th."""
        size = self.lengths[ids]
        if len(ids) and not size.min():
            raise ValueError("an id without code")
        ends = np.cumsum(size)
        starts = ends - size
        bits = int(ends[-1]) if len(ids) else 0
        words = np.zeros(bits // 64 + 2, dtype=np.uint64)
        at, shift = starts >> 6, (starts & 63).astype(np.uint64)
        code = self.codes[ids] << (np.uint64(64) - size.astype(np.uint64))  # at the top of a word
        # Codes of one word do not overlap, so their sum is their union.
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(ids) else np.empty(0, dtype=np.int64)
        if len(ids):
            words[at[first]] = np.add.reduceat(code >> shift, first)
            over = (starts & 63) + size > 64  # the rest of the last code in a word
            words[at[over] + 1] += code[over] << (np.uint64(64) - shift[over])
        return words.byteswap().tobytes()[:(bits + 7) // 8], starts[::STEP]

    def unpack(self, payload: bytes, offsets: np.ndarray, n: int) -> np.ndarray:
        """The ids of a block."""
        return self.unpack_all([(payload, offsets, n)])[0]

    def unpack_all(self, blocks: list[tuple[bytes, np.ndarray, int]]) -> list[np.ndarray]:
        """The ids of several blocks of (payload, offsets, number of ids): from all their offsets at once, each up to STEP ids."""
        data = np.frombuffer(b"".join(payload + bytes(8) for payload, _, _ in blocks), np.uint8).astype(np.uint32)
        window = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]  # LONGEST + 7 bits lie in 4 bytes
        sizes = np.array([len(payload) for payload, _, _ in blocks], dtype=np.int64)
        first = np.cumsum(sizes + 8) - sizes - 8
        lanes = [len(offsets) for _, offsets, _ in blocks]
        at = np.concatenate([np.asarray(offsets, dtype=np.int64) + 8 * f for (_, offsets, _), f in zip(blocks, first)])
        last, mask = np.repeat(8 * (first + sizes), lanes), (1 << self.width) - 1
        out = np.empty((STEP, len(at)), dtype=np.int32)
        for step in range(min(STEP, max(n for _, _, n in blocks))):
            key = window[at >> 3].astype(np.int64) >> 32 - self.width - (at & 7) & mask
            out[step] = self.symbol[key]
            at = np.minimum(at + self.length[key], last)
        ends = np.cumsum(lanes)
        return [out[:, e - k:e].T.ravel()[:n] for e, k, (_, _, n) in zip(ends, lanes, blocks)]


_codes: dict[int, Code] = {}


def _code(lengths: np.ndarray) -> Code:
    """The last code used by a worker."""
    key = zlib.crc32(lengths.tobytes())
    if key not in _codes:
        _codes.clear()
        _codes[key] = Code(lengths)
    return _codes[key]


#: The pre-tokens of the public word vocabulary, as its file has them, and for lower-case text of ASCII and the letters of
#: Latin-1 without added tokens, whose normal form is the text itself; a blank is one more, that ends a run.
_PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_latin_pre_tokens = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\t-\r a-z\xdf-\xf6\xf8-\xff0-9]+| ").findall
_NOT_LATIN = "[^\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-\xff]"


class Memory(dict):
    """What a worker has encoded lately, and what before that: what is not used again before the next change is forgotten."""

    def __init__(self, entries: int):
        self.entries, self.older = entries, {}

    def missing(self, used: set[str]) -> list[str]:
        if len(self) + len(used) > self.entries:
            self.older = dict(self)
            self.clear()
        for key in used & self.older.keys():
            self[key] = self.older[key]
        return list(used - self.keys())


def _strings(names: pa.Array) -> list[str]:
    return names.to_numpy(zero_copy_only=False).tolist()


def _blanked(names: pa.Array) -> str:
    """Strings with blanks between."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), " ")[0].as_py()


class Numbered:
    """Distinct strings of ids by number, in one array."""

    def __init__(self, parts: list[bytes], dtype: str):
        self.ids = np.frombuffer(b"".join(parts), dtype=dtype)
        self.sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // self.ids.itemsize

    def joined(self, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the numbers ``at``, and where those of ``at[:end]`` end for each of ``ends``."""
        taken = self.sizes[at]
        stops = np.cumsum(taken)
        places = np.repeat((np.cumsum(self.sizes) - self.sizes)[at] - stops + taken, taken)
        places += np.arange(len(places))
        return self.ids[places], np.append(0, stops)[ends]


class Encoder:
    """The tokenizers library, called once for each pre-token that a worker's memory lacks.

    A blank is a cut of the tokenizer, whose pre-tokens hold no white space and whose normalizer does not look across it, so
    texts are encoded run by run. If the file has the pre-tokens above, runs of ASCII and the letters of Latin-1 are cut into
    them, which are fewer than runs, and go to the library many at a time with blanks between: an id that ends a word ends a
    pre-token. Other runs go to it whole. Texts are put together from numbers of runs and pre-tokens."""

    def __init__(self, vocabulary: str, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer, self.dtype = Tokenizer.from_str(vocabulary), dtype
        self.runs, self.pieces = Memory(CACHE_ENTRIES), Memory(2 * CACHE_ENTRIES)
        kinds = json.loads(vocabulary)
        steps = [n.get("type") for n in (kinds["normalizer"] or {}).get("normalizers", [])]
        levels = (kinds["pre_tokenizer"] or {}).get("pretokenizers", [])
        cuts = [c.get("pattern", {}).get("Regex") for c in levels]
        suffix, added = kinds["model"].get("end_of_word_suffix"), kinds["added_tokens"]
        self.cuts_latin = (steps == ["NFC", "Replace", "Lowercase"] and cuts == [_PRE_TOKENS, None] and levels[1].get("type") == "ByteLevel"
                           and not levels[1].get("add_prefix_space") and not levels[1].get("use_regex", True) and bool(suffix)
                           and not kinds["post_processor"] and not any(t["normalized"] for t in added))
        self.odd = re.compile("|".join([_NOT_LATIN, *(re.escape(t["content"]) for t in added)])).search
        if self.cuts_latin:
            self.words = Tokenizer.from_str(vocabulary)
            self.words.normalizer = None  # lower-case pre-tokens stay as they are
            self.words.pre_tokenizer = pre_tokenizers.Sequence([
                pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            found = self.words.get_vocab(with_added_tokens=False)
            self.ends = np.zeros(max(found.values()) + 1, dtype=bool)
            self.ends[[i for t, i in found.items() if t.endswith(suffix)]] = True

    def _library(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        for a in range(0, len(texts), 4096):
            part = texts[a:a + 4096]
            for text, found in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                yield text, np.array(found.ids, dtype=self.dtype).tobytes()

    def _library_words(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        width = int(self.dtype[-1])
        for a in range(0, len(words), WORDS):
            part = words[a:a + WORDS]
            ids = np.array(self.words.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype=self.dtype)
            stops = [0, *(width * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            packed = ids.tobytes()
            if len(stops) == len(part) + 1 and stops[-1] == len(packed):
                yield from zip(part, [packed[x:y] for x, y in zip(stops, stops[1:])])
            else:
                yield from self._library(part)

    @staticmethod
    def _remembered(memory: Memory, names: list[str], ask) -> list[bytes]:
        """The ids of distinct strings, of which ``ask`` gets those that ``memory`` lacks."""
        fresh = memory.missing(set(names))
        memory.update(ask(fresh))
        out = [memory[n] for n in names]
        for n in fresh:
            if len(n) > CACHE_CHARS:
                del memory[n]
        return out

    def _runs(self, names: pa.Array) -> tuple[Numbered, np.ndarray]:
        """The ids of distinct runs, and the number of each run among them."""
        odd = np.zeros(len(names), dtype=bool) if self.cuts_latin else np.ones(len(names), dtype=bool)
        text = _blanked(names)
        if self.cuts_latin and self.odd(text):
            odd = np.array([self.odd(r) is not None for r in _strings(names)])
            text = _blanked(names.filter(pa.array(~odd)))
        number = np.empty(len(names), dtype=np.int64)
        number[~odd], number[odd] = np.arange(n := int((~odd).sum())), np.arange(n, len(names))
        out = Numbered(self._remembered(self.runs, _strings(names.filter(pa.array(odd))), self._library), self.dtype)
        if n:
            coded = pa.array(_latin_pre_tokens(text.lower() + " "), pa.string()).dictionary_encode()
            pieces, at = _strings(coded.dictionary), coded.indices.to_numpy()
            blank = pieces.index(" ")
            known = self._remembered(self.pieces, pieces[:blank] + pieces[blank + 1:], self._library_words)
            ids, ends = Numbered(known[:blank] + [b""] + known[blank:], self.dtype).joined(at, np.flatnonzero(at == blank))
            out.ids, out.sizes = np.append(ids, out.ids), np.append(np.diff(ends, prepend=0), out.sizes)
        return out, number

    def encode(self, texts: list[str], end_id: int) -> list[bytes]:
        """Packed ids of whole texts, each with ``end_id`` behind."""
        if not texts:
            return []
        cut = pc.split_pattern(pa.array(texts, pa.string()), " ")
        coded, ends = cut.flatten().dictionary_encode(), cut.offsets.to_numpy()[1:].astype(np.int64)
        runs, number = self._runs(coded.dictionary)
        runs.ids, runs.sizes = np.append(runs.ids, np.array([end_id], dtype=self.dtype)), np.append(runs.sizes, 1)
        at = np.insert(number[coded.indices.to_numpy()], ends, len(number))
        ids, stops = runs.joined(at, ends + np.arange(1, len(texts) + 1))
        packed, stops = ids.tobytes(), [0, *(ids.itemsize * stops).tolist()]
        return [packed[x:y] for x, y in zip(stops, stops[1:])]


_encoders: dict[tuple[int, str], Encoder] = {}


def encode_texts(vocabulary: str, texts: list[str], end_id: int, dtype: str) -> list[bytes]:
    """Packed ids of whole texts, each with ``end_id`` behind, by one encoder per worker and vocabulary."""
    key = (hash(vocabulary), dtype)
    if key not in _encoders:
        _encoders[key] = Encoder(vocabulary, dtype)
    return _encoders[key].encode(texts, end_id)


def encode(df: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """doc_id, ids (packed) of every whole text with the end id; null and empty texts are the end id alone."""
    from tokenizers import Tokenizer
    dtype = "<u2" if max(Tokenizer.from_str(vocabulary).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)  # one vocabulary file, under 2 MB

    def run(batch: pa.RecordBatch):
        for ids, texts in unpacked(batch, PASS_CHARS):
            yield {"doc_id": ids, "ids": encode_texts(shared.value, [t or "" for t in texts], end_id, dtype)}

    return over_batches(df.select("doc_id", "text"), run, "doc_id long, ids binary").withColumn("width", F.lit(int(dtype[-1])))


def count_ids(encoded: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs; tasks send at most one row per id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for ids, width in zip(batch.column("ids"), batch.column("width")):
                total += np.bincount(np.frombuffer(ids.as_buffer(), f"<u{width}"), minlength=size)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["id", "n"])

    rows = encoded.select("ids", "width").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(size, dtype=np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return counts


def write(encoded: DataFrame, path: str, size: int) -> None:
    """The dataset of doc_id, ids, width below ``path``. Rows without doc_id come first; rows that repeat one are in the order
    of a hash of their ids. An empty table gives an empty dataset."""
    spark = encoded.sparkSession
    lengths = code_lengths(count_ids(encoded, size))
    found = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in found], "id int, length int").coalesce(1).write.parquet(f"{path}/codes")
    shared = spark.sparkContext.broadcast(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part = _code(shared.value), TaskContext.get().partitionId()
        before = block = held = 0
        docs: list = []
        parts: list[np.ndarray] = []

        def flush():
            nonlocal before, block, held, docs, parts
            ids = np.concatenate(parts).astype(np.int64)
            payload, offsets = code.pack(ids)
            row = [[part], [block], [before], [docs], [[len(p) for p in parts]], [payload], [offsets.tolist()]]
            before, block, held, docs, parts = before + len(ids), block + 1, 0, [], []
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(row, kinds)], names=names)

        names = ["part", "block", "before", "doc_ids", "sizes", "payload", "offsets"]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64())]
        for batch in batches:
            for doc, packed, width in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), batch.column("width")):
                ids = np.frombuffer(packed.as_py(), f"<u{width}")
                docs.append(doc)
                parts.append(ids)
                held += len(ids)
                if held >= BLOCK_IDS:
                    yield flush()
        if parts:
            yield flush()

    # Dealt by numbers alone: the sample that finds the ranges goes through the driver.
    rank = F.xxhash64("ids")
    ordered = encoded.repartitionByRange("doc_id", rank).sortWithinPartitions("doc_id", rank, "ids").select("doc_id", "ids", "width")
    ordered.mapInArrow(run, "part int, block int, before long, doc_ids array<long>, sizes array<long>, payload binary, offsets array<long>"
                       ).write.option("compression", "none").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str, size: int, digests: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids (packed as unsigned 32-bit integers) of every document of a dataset, or with ``digests``
    the CRC-32 of the packed ids, ids_crc32, in their place."""
    lengths = np.zeros(size, dtype=np.uint8)
    for r in spark.read.parquet(f"{path}/codes").collect():
        lengths[r["id"]] = r["length"]
    shared = spark.sparkContext.broadcast(lengths)
    blocks = spark.read.parquet(f"{path}/blocks")
    parts = blocks.groupBy("part").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n"))
    start = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row per part, and parts are no more than the partitions of the sort that wrote them.
    placed = blocks.join(F.broadcast(parts.select("part", start.alias("start"))), "part")

    def run(batch: pa.RecordBatch):
        code = _code(shared.value)
        for a in range(0, batch.num_rows, TOGETHER):
            part = batch.slice(a, TOGETHER)
            starts, before, docs, sizes, payloads, offsets = (
                part.column(c).to_pylist() for c in ("start", "before", "doc_ids", "sizes", "payload", "offsets"))
            for x, y, doc_ids, n, ids in zip(starts, before, docs, sizes, code.unpack_all(list(zip(payloads, offsets, map(sum, sizes))))):
                ends, ids = np.cumsum(n), ids.astype("<u4")
                out = {"doc_id": doc_ids, "start": (x + y + ends - n), "n_tokens": n}
                if digests:
                    yield {**out, "ids_crc32": [zlib.crc32(ids[e - k:e]) for e, k in zip(ends, n)]}
                else:
                    yield {**out, "ids": [ids[e - k:e].tobytes() for e, k in zip(ends, n)]}

    return over_batches(placed, run, "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digests else "ids binary"))


def op3_token_files(spark: SparkSession, sf_dir: str, end_id: int = 2) -> DataFrame:
    import public_tokenizers
    from tokenizers import Tokenizer
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        vocabulary = f.read()
    size = max(Tokenizer.from_str(vocabulary).get_vocab_size(), end_id + 1)
    path = shared_dir(spark, "token_files")
    write(stored(encode(table(spark, sf_dir, "documents"), vocabulary, end_id), "encoded"), path, size)
    return read(spark, path, size, digests=True)
