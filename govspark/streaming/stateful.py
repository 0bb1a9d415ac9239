"""Keyed stateful streams: budgets, lockouts, alerts, behaviour profiles.

Every operator is ``groupBy(shard of keys).transformWithStateInPandas``: Spark shuffles a micro-batch by shards, which are
hashes of the keys, keeps each shard's state in RocksDB and checkpoints it. A call to the state store costs about a
millisecond, so a dozen of them serve all keys of a shard, not each one. Rows wait in the state until the watermark, ``delay`` behind the
newest event, has passed them, and are folded in event-time order. Later rows are dropped by the watermark; a
``replay.Gate`` before the stream keeps them in a table of their own. A backlog is better served by the batch forms (``cost.budget_decisions``,
``anomaly.anomaly_scores``, ``reliability.alert_episodes``), which split hot keys.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import attrgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from govspark.operators import anomaly, reliability
from govspark.streaming import folds

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_CONF = "spark.sql.streaming.stateStore.providerClass"
_UNITS = {"second": folds.SECOND_US, "minute": 60 * folds.SECOND_US, "hour": folds.HOUR_US, "day": folds.DAY_US}
#: Buckets of a watermark's delay: what a key holds in state is its rows of the delay and one bucket.
BUCKETS = 1
#: Shards of the keys. One checkpoint keeps its number; the scalars of a shard's keys are one value, written at each fold.
SHARDS = 256


def _packed(frame: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(frame, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(parts: list[bytes]) -> pd.DataFrame:
    return pa.concat_tables([pa.ipc.open_stream(p).read_all() for p in parts], promote_options="permissive").to_pandas()


class KeyedFold(StatefulProcessor):
    """Folds a shard's keys, each in the order of event time and id, with ``fold(state of the key, its rows) -> list of output rows``.

    With ``bucket_us`` rows wait in the shard's state, packed by buckets of that much time, until the watermark has passed
    their bucket; a timer then folds the due buckets one after the other, so results do not depend on how the input is split
    into micro-batches, what waits is bounded by the watermark's delay, and no more than a bucket of a shard is in memory.
    Without, rows come in order already. Small scalars of the keys' states are one JSON value; each name in ``sets`` is a list
    state to which only new members are appended. ``whole`` are the columns of whole numbers, sent without nulls, which the
    bits of ``null_bits`` tell, because pandas would make them doubles.
    """

    def __init__(self, fold: Callable, keys: list[str], whole: list[str], columns: list[str], order: list[str], sets: tuple[str, ...],
                 bucket_us: int | None):
        self.fold, self.keys, self.whole, self.columns, self.order, self.sets, self.bucket_us = fold, keys, whole, columns, order, sets, bucket_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.scalars = handle.getValueState("scalars", "value string")
        self.members = {n: handle.getListState(n, "value string") for n in self.sets}
        if self.bucket_us:
            self.waiting = handle.getMapState("waiting", "bucket bigint, part bigint", "packed binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if not self.bucket_us:
            states, before = self._state(), {}
            yield self._out(self._folded(states, before, pd.concat(list(rows))))
            self._keep(states, before)
            return
        timeless = 1 << self.whole.index("ts_us")
        for frame in rows:
            frame = frame[frame["null_bits"] & timeless == 0].drop(columns=["ts", "key_shard"])
            for bucket, some in frame.groupby(frame["ts_us"] // self.bucket_us):
                self.waiting.updateValue((int(bucket), time.time_ns()), (_packed(some),))
                self.handle.registerTimer((int(bucket) + 1) * self.bucket_us // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        due: dict[int, list] = {}
        for bucket, part in self.waiting.keys():
            if (bucket + 1) * self.bucket_us <= until:
                due.setdefault(bucket, []).append((bucket, part))
        if not due:  # another timer of this watermark has folded them
            return
        states, before = self._state(), {}
        for bucket in sorted(due):
            frame = _unpacked([bytes(self.waiting.getValue(n)[0]) for n in due[bucket]])
            yield self._out(self._folded(states, before, frame))
            for n in due[bucket]:
                self.waiting.removeKey(n)
        self._keep(states, before)

    def _folded(self, states: dict, before: dict, frame: pd.DataFrame) -> list[tuple]:
        """Output rows of all keys in ``frame``; ``before`` gets the sets of each key as they were at its first row."""
        for i, c in enumerate(self.whole):
            missing = frame["null_bits"] & 1 << i != 0
            if missing.any():
                frame[c] = frame[c].astype(object).where(~missing, float("nan"))
        rows = frame.drop(columns="null_bits").sort_values([*self.keys, *self.order]).itertuples(index=False)
        of, out = attrgetter(*self.keys), []
        for key, some in groupby(rows, of):
            name = json.dumps([None if k is None or k != k else k for k in (key if len(self.keys) > 1 else (key,))])
            state = states.setdefault(name, {})
            if name not in before:
                before[name] = {n: set(state.setdefault(n, set())) for n in self.sets}
            out += self.fold(state, some)
        return out

    def _out(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.columns, dtype=object)

    def _state(self) -> dict[str, dict]:
        """State by key."""
        states = json.loads(self.scalars.get()[0]) if self.scalars.exists() else {}
        for n, held in self.members.items():
            for r in held.get() if held.exists() else ():
                name, value = json.loads(r[0])
                states.setdefault(name, {}).setdefault(n, set()).add(value)
        return states

    def _keep(self, states: dict, before: dict) -> None:
        for n, held in self.members.items():
            fresh = [(json.dumps([name, v]),) for name, had in before.items() for v in sorted(states[name][n] - had[n])]
            if fresh:
                held.appendList(fresh)
        scalars = {name: {k: v for k, v in state.items() if k not in self.members} for name, state in states.items()}
        self.scalars.update((json.dumps({name: state for name, state in scalars.items() if state}),))

    def close(self) -> None:
        pass


def _microseconds(delay: str) -> int:
    """Length of a watermark delay such as "1 day"."""
    number, unit = delay.split()
    return int(number) * _UNITS[unit.rstrip("s")]


def _keyed(stream: DataFrame, keys: list[str], fold: Callable, schema: str, order: list[str],
           sets: tuple[str, ...] = (), delay: str | None = None) -> DataFrame:
    """With ``delay`` rows of ``stream`` (ts_us among them) wait for the watermark that follows the newest at that distance."""
    columns = [c.strip().split(" ")[0] for c in schema.split(",")]
    stream.sparkSession.conf.set(STATE_CONF, ROCKSDB)
    bucket = max(_microseconds(delay) // BUCKETS // folds.SECOND_US, 1) * folds.SECOND_US if delay else None
    if delay:
        stream = stream.withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", delay)
    whole = [f.name for f in stream.schema if isinstance(f.dataType, T.IntegralType) and f.name not in keys]
    nulls = sum((F.isnull(c).cast("long") * (1 << i) for i, c in enumerate(whole)), F.lit(0).cast("long"))
    rows = stream.select(F.pmod(F.xxhash64(*keys), F.lit(SHARDS)).cast("int").alias("key_shard"), nulls.alias("null_bits"),
                         *[F.coalesce(c, F.lit(0)).alias(c) if c in whole else F.col(c) for c in stream.columns])
    return rows.groupBy("key_shard").transformWithStateInPandas(
        statefulProcessor=KeyedFold(fold, keys, whole, columns, order, sets, bucket), outputStructType=schema,
        outputMode="append", timeMode="EventTime" if delay else "None")


def budget_stream(log: DataFrame, budgets: DataFrame, default_daily: int, default_hourly: int,
                  delay: str = "1 day") -> DataFrame:
    """Outcome of every query under its user's budgets; only admitted cost counts."""
    side = budgets.select("user_name", "daily_cents", "hourly_cents")
    limited = log.join(side, "user_name", "left").select(
        "user_name", "audit_id", "ts_us", "cost_cents", F.coalesce("daily_cents", F.lit(default_daily)).alias("daily"),
        F.coalesce("hourly_cents", F.lit(default_hourly)).alias("hourly"))

    step = folds.budget_step

    def fold(state, rows):
        return [(r.audit_id, r.user_name, step(state, r.ts_us, r.cost_cents, r.daily, r.hourly))
                for r in rows]

    return _keyed(limited, ["user_name"], fold, "audit_id bigint, user_name string, outcome string", ["ts_us", "audit_id"],
                  delay=delay)


def lockout_stream(auth: DataFrame, attempts: int = 5, window_us: int = 60 * folds.SECOND_US,
                   base_us: int = 300 * folds.SECOND_US, max_us: int = 3600 * folds.SECOND_US, delay: str = "1 day") -> DataFrame:
    """Outcome of every sign-in attempt per source address and per user, as two independent keys."""
    keyed = auth.select("audit_id", "ts_us", "success", F.inline_outer(F.array(
        F.struct(F.lit("ip").alias("kind"), F.col("source_ip").alias("key")),
        F.struct(F.lit("user").alias("kind"), F.col("user_name").alias("key")))))

    step = folds.lockout_step

    def fold(state, rows):
        return [(r.audit_id, r.kind, r.key, step(state, r.ts_us, r.success, attempts, window_us, base_us, max_us))
                for r in rows]

    return _keyed(keyed, ["kind", "key"], fold, "audit_id bigint, kind string, key string, outcome string",
                  ["ts_us", "audit_id"], delay=delay)


def alerts_stream(log: DataFrame, rules: list[dict], delay: str = "1 hour") -> DataFrame:
    """Alert events with cooldown. ``log`` has an event-time column ``ts`` and, for overflow rules, ``sequence_num``.

    Rows are counted per window first, with a watermark, one aggregate for each window width in use, so a rule's key only ever
    sees one row per window that has data; windows without data count as zero. Lost events are the sequence numbers missing
    inside a window and between it and the one before, whose last number is kept in state: numbers rise with time from
    window to window.
    """
    timed, per_rule = log.withWatermark("ts", delay), None
    for width in sorted({r["window_us"] for r in rules}):
        mine = [r for r in rules if r["window_us"] == width]
        counted = [r for r in mine if r["condition"] != "audit_buffer_overflow"]
        sequence = [F.min("sequence_num").alias("_low"), F.max("sequence_num").alias("_high"), F.count("sequence_num").alias("_n")] if len(counted) < len(mine) else []
        counts = timed.groupBy(F.window("ts", f"{width} microseconds")).agg(
            F.count(F.lit(1)).alias("_rows"), *sequence, *[reliability.alert_value(r["condition"]).alias(r["name"]) for r in counted])
        none = F.lit(None).cast("long")
        one = lambda r: F.struct(
            F.lit(r["name"]).alias("rule"), (F.col(r["name"]) if r in counted else F.lit(0)).cast("double").alias("value"), F.lit(float(r["threshold"])).alias("threshold"),
            F.lit(r["cooldown_us"]).alias("cooldown"), F.lit(width).alias("width"), *[(none if r in counted else F.col(c)).alias(c[1:]) for c in ("_low", "_high", "_n")])
        rows = counts.select(F.unix_micros("window.start").alias("window_us"), F.inline_outer(F.array(*map(one, mine))))
        per_rule = rows if per_rule is None else per_rule.union(rows)

    step = folds.alert_step

    def fold(state, rows):
        out = []
        for r in rows:
            value = r.value
            if r.n == r.n and r.n:  # an overflow: what is missing inside the window and since the last one
                value = float(r.high - r.low + 1 - r.n + (r.low - state["high"] - 1 if "high" in state else 0))
                state["high"] = int(r.high)
            # Windows without data can only resolve an alert: the first one past the cooldown does.
            at = state.get("next", r.window_us)
            while at < r.window_us and state.get("active"):
                event = step(state, at, 0.0, r.threshold, r.cooldown)
                if event:
                    out.append((r.rule, at, 0.0, event))
                at += r.width
            event = step(state, r.window_us, value, r.threshold, r.cooldown)
            if event:
                out.append((r.rule, r.window_us, value, event))
            state["next"] = int(r.window_us + r.width)
        return out

    return _keyed(per_rule, ["rule"], fold, "rule string, window_us bigint, value double, event string", ["window_us"])


def anomaly_stream(log: DataFrame, after: int = 100, window_us: int = 300_000_000, history: int = 288,
                   z: float = 3.0, delay: str = "1 day") -> DataFrame:
    """Anomalies of every query as it arrives. ``log``: user_name, audit_id, ts_us, tables (array), fingerprint_hash."""
    step, weights, limit = folds.anomaly_step, anomaly.WEIGHTS, anomaly.ANOMALOUS

    def fold(state, rows):
        out = []
        for r in rows:
            found = step(state, r.ts_us, list(r.tables), r.fingerprint_hash, after, window_us, history, z)
            if found:
                score = min(1.0, round(sum(weights[f.split(":")[0]] for f in found), 6))
                out.append((r.audit_id, r.user_name, score, ",".join(sorted(found)), score >= limit))
        return out

    return _keyed(log.select("user_name", "audit_id", "ts_us", "tables", "fingerprint_hash"), ["user_name"], fold,
                  "audit_id bigint, user_name string, anomaly_score double, anomalies string, is_anomalous boolean",
                  ["ts_us", "audit_id"], ("tables", "patterns", "hours"), delay)
