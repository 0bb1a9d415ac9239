import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from govspark.llm import bpe, queries, token_files
from tests.conftest import SMALL

VOCABULARY = bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, VOCABULARY.splitlines())}
PUBLIC = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = bpe.Codec(VOCABULARY, public_tokenizers.PATTERN)
WORDS = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()


def unpack(packed):
    return list(memoryview(packed).cast("I"))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aab  \n\t'sé1234,.字　 \x1c\x85"), st.characters(codec="utf-8")), max_size=60), max_size=5))
def test_encodes_like_the_public_library_and_back(texts):
    for text, packed in zip(texts, CODEC.encode(texts)):
        assert unpack(packed) == PUBLIC.encode_ordinary(text)
        assert CODEC.decode(packed) == text.encode()


@pytest.mark.parametrize("text", ["a" * 60_000, " " * 30_000, "ab" * 20_000, "é" * 9_000 + "x", "".join(random.Random(1).choices("abcdefghij", k=50_000))])
def test_one_long_pre_token(text):
    assert unpack(CODEC.encode([text])[0]) == PUBLIC.encode_ordinary(text)


def test_a_full_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    texts = ["one two three four", "five six seven", "one two nine ten eleven twelve"]
    own = bpe.Codec(VOCABULARY, public_tokenizers.PATTERN)
    for t in texts * 2:
        assert unpack(own.encode([t])[0]) == PUBLIC.encode_ordinary(t)


def test_queue_gives_ranks_in_order():
    queue, rng = bpe.RankQueue(5000), random.Random(2)
    ranks = [rng.randrange(5000) for _ in range(400)]
    for i, r in enumerate(ranks):
        queue.push(r, np.array([i]))
    out = []
    while entry := queue.pop():
        out += [(entry[0], i) for i in entry[1].tolist()]
    assert out == sorted((r, i) for i, r in enumerate(ranks)) and queue.pop() is None


def test_rows_of_any_kind(spark, awkward, nothing):
    rows = bpe.round_trip(awkward("n_tokens"), VOCABULARY, public_tokenizers.PATTERN).collect()
    assert len(rows) == awkward().count() and all(r.round_trip_ok for r in rows)
    none = next(r for r in rows if r.doc_id == 1)
    assert none.n_tokens == 0 and none.ids_sha256 == none.decoded_sha256 == hashlib.sha256(b"").hexdigest()
    encoded = bpe.encode(awkward(), VOCABULARY, public_tokenizers.PATTERN)
    texts = sorted((r.text or "").encode() for r in awkward().collect())
    assert sorted(bytes(r.data) for r in bpe.decode(encoded, VOCABULARY, public_tokenizers.PATTERN).collect()) == texts
    assert bpe.round_trip(nothing, VOCABULARY, public_tokenizers.PATTERN).count() == 0


def test_op1_against_the_public_library(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in queries.QUERIES["op1_byte_bpe"](spark, SMALL).collect():
        ids = np.array(PUBLIC.encode_ordinary(texts[r.doc_id]), dtype="<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def _lengths(counts):
    """Optimal unrestricted code lengths by the usual merging of the two lightest trees."""
    import heapq
    heap = [(int(c), [i]) for i, c in enumerate(counts) if c]
    out = [0] * len(counts)
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for i in a[1] + b[1]:
            out[i] += 1
        heapq.heappush(heap, (a[0] + b[0], a[1] + b[1]))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10 ** 6), min_size=1, max_size=300), st.integers(9, 18))
def test_code_lengths(counts, longest):
    counts = np.array(counts, dtype=np.int64)
    lengths = token_files.code_lengths(counts, longest).astype(int)
    used = lengths[counts > 0]
    assert (lengths[counts == 0] == 0).all() and lengths.max(initial=0) <= longest
    assert (2.0 ** -used).sum() <= 1 + 1e-12
    free = np.array(_lengths(counts))
    if (counts > 0).sum() > 1:
        cost = lambda x: int((x * counts).sum())
        assert cost(lengths) == cost(free) if free.max() <= longest else cost(lengths) >= cost(free)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=1200), st.integers(0, 5))
def test_blocks_unpack_to_what_was_packed(ids, skew):
    counts = np.bincount(np.array(ids + [7], dtype=np.int64), minlength=401) ** max(skew, 1)
    code = token_files.Code(token_files.code_lengths(counts))
    payload, offsets = code.pack(np.array(ids, dtype=np.int64))
    assert code.unpack(payload, offsets, len(ids)).tolist() == ids


def test_token_files_against_the_public_library(spark, awkward, nothing, monkeypatch):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_str(WORDS)
    monkeypatch.setattr(token_files, "BLOCK_IDS", 50)
    size = tokenizer.get_vocab_size()
    for frame in (awkward("start"), nothing):
        path = token_files.shared_dir(spark, "files")
        token_files.write(token_files.encode(frame, WORDS, 2), path, size)
        rows = token_files.read(spark, path, size).collect()
        assert len(rows) == frame.count()
        texts = {}
        for r in frame.collect():
            texts.setdefault(r.doc_id, []).append(r.text or "")
        place = 0
        for r in sorted(rows, key=lambda r: r.start):
            found = np.frombuffer(r.ids, "<u4").tolist()
            assert r.start == place and r.n_tokens == len(found)
            assert found in [tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts[r.doc_id]]
            place += r.n_tokens
        ids = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
        assert ids == sorted(ids, key=lambda i: (i is not None, i))


def test_op3_against_the_public_library(spark):
    from tokenizers import Tokenizer
    tokenizer, start = Tokenizer.from_str(WORDS), 0
    rows = {r.doc_id: r for r in queries.QUERIES["op3_token_files"](spark, SMALL).collect()}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect():
        ids = tokenizer.encode(r.text, add_special_tokens=False).ids + [2]
        got = rows[r.doc_id]
        assert (got.start, got.n_tokens, got.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
