"""Streams over files that each cover the whole time, one per micro-batch: registered queries lose no row to the watermark."""

import pytest

from govspark.plans import fixtures, registry
from tests.conftest import SMALL
from tests.test_streams import KEYS


@pytest.fixture(scope="module")
def mixed(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("interleaved")
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    for i in range(3):
        events.filter(f"event_id % 3 = {i}").coalesce(1).write.mode("append").parquet(str(root / "events.parquet"))
    for t in ("customer", "orders"):
        spark.read.parquet(f"{SMALL}/{t}.parquet").write.parquet(str(root / f"{t}.parquet"))
    return str(root)


@pytest.mark.parametrize("key", KEYS)
def test_files_of_the_whole_time(spark, mixed, key, monkeypatch):
    query = registry.load()[key]
    rows = lambda d: sorted(map(str, query(spark, d).collect()))
    whole = rows(SMALL)
    monkeypatch.setattr(fixtures, "STREAM_OPTIONS", {"maxFilesPerTrigger": "1"})
    assert whole and rows(mixed) == whole
