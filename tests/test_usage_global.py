"""The global level of usage_rollup: all keys together pass a limit that none passes alone."""

from govspark.operators import reliability
from govspark.runtime import local_frame


def test_all_keys_together(spark):
    log = local_frame(spark, [(i * 1000, f"u{i}", f"d{i % 3}", "LOW") for i in range(6)] + [(1_500_000, None, None, "HIGH")],
                      "ts_us long, user_name string, database_name string, priority string")
    limits = local_frame(spark, [("global", "*", 20), ("user", "*", 20), ("database", "d0", 20)], "level string, key string, tokens_per_second int")
    rows = lambda nodes: {tuple(r) for r in reliability.usage_rollup(log, limits, nodes).collect()}
    assert rows(1) == set()
    assert rows(2) == {(0, "global", "all", 12, 10)}
    assert rows(6) == {(0, "global", "all", 12, 3), (0, "database", "d0", 4, 3)}
