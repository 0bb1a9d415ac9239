"""Compare registered queries with their SQL on DuckDB: names, row counts, values."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from govspark.plans.fixtures import TABLES  # noqa: E402


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if type(v).__name__ == "Decimal":
        return ("decimal", str(v))
    return (type(v).__name__, v) if isinstance(v, bool) else v


def rows_of(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, key: str, fn, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    start = time.time()
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    took = time.time() - start
    n = sum(got.values())
    if sql is None:
        return n > 0, f"{key}: rows only, {n} rows, {took:.1f}s"
    start = time.time()
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    want = rows_of(names, rel.fetchall())
    duck = time.time() - start
    if sorted(df.columns) != sorted(names):
        return False, f"{key}: columns {sorted(df.columns)} vs {sorted(names)}"
    if got != want:
        miss, extra = want - got, got - want
        return False, (f"{key}: {n} rows vs {sum(want.values())}; {sum(miss.values())} missing {list(miss)[:3]}; "
                       f"{sum(extra.values())} unexpected {list(extra)[:3]}")
    return True, f"{key}: ok, {n} rows, spark {took:.1f}s, duckdb {duck:.1f}s"


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
             .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = connect(sf_dir), entry.oracle_sql(), []
    for key, fn in entry.queries().items():
        if only and not any(key == o or (o.endswith("*") and key.startswith(o[:-1])) for o in only):
            continue
        try:
            ok, text = compare(spark, con, key, fn, oracles.get(key), sf_dir)
        except Exception as e:  # report every query, whatever breaks
            ok, text = False, f"{key}: {type(e).__name__} {str(e)[:1500]}"
        print(("" if ok else "FAIL ") + text, flush=True)
        bad += [] if ok else [key]
    print(f"{len(bad)} failed: {bad}")


if __name__ == "__main__":
    main()
