import random
import tracemalloc

import public_tokenizers
import pyarrow as pa
import tiktoken

from govspark.llm import bpe, common
from tests.llm.test_encoding import CODEC, PUBLIC, unpack


def test_merging_takes_bounded_memory_a_byte():
    rng = random.Random(3)
    pieces = ["".join(rng.choices("abcdefghij", k=8)) for _ in range(50_000)]
    tracemalloc.start()
    packed = CODEC.merge([p.encode() for p in pieces])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60 * 8 * len(pieces)  # more than 80 bytes a byte of text when all pairs were looked up at once
    for p, ids in zip(pieces[::50], packed[::50]):
        assert unpack(ids) == PUBLIC.encode_ordinary(p)


def test_pairs_across_offers(monkeypatch):
    monkeypatch.setattr(bpe, "OFFER", 3)
    for text in ("a" * 50, "abababab" * 9, "".join(random.Random(1).choices("abcdef", k=400))):
        assert unpack(CODEC.merge([text.encode()])[0]) == PUBLIC.encode_ordinary(text)


def test_texts_are_unpacked_a_range_at_a_time():
    texts = ["a" * 40, None, "é" * 70, "", "b" * 500, "c"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], names=["doc_id", "text"])
    got = list(common.unpacked(batch, 100))
    assert [ids for ids, _ in got] == [[0, 1], [2, 3], [4], [5]] and sum((t for _, t in got), []) == texts
