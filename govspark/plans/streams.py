"""Registered queries: streams over the files of the events table, run over all available input.

The events are copied into slices of time first, in whose order a stream takes them; its delay covers one slice, so no row is
late however the table is cut into files, and no more than about a slice waits in state. An end mark closes every window and session, so each SQL twin is the plain batch
query.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from govspark.plans.activity import AFTER, ALERT_SQL, BUDGET_RUN, BUDGET_SQL, DAY, HOUR, RULES, alert_log, budgets
from govspark.plans.fixtures import table, view
from govspark.plans.registry import query
from govspark.runtime import local_frame, shared_dir
from govspark.streaming import replay, stateful, windows

MINUTE, SECOND = 60_000_000, 1_000_000
SLICE_ROWS = replay.SLICE_ROWS


def _times(spark, d):
    """First and last time of the events; one and the same where there is none."""
    low, high = table(spark, d, "events").agg(*(f(F.col("ts").cast("timestamp_ntz")) for f in (F.min, F.max))).first()
    return low or datetime(2000, 1, 1), high or datetime(2000, 1, 1)


def _run(spark, d, purpose, build, name="audit"):
    """The stream that ``build(log, delay)`` makes of the audit log, run over the events in the order of time and an end mark."""
    events = table(spark, d, "events")
    low, high = _times(spark, d)
    end = max(datetime(2200, 1, 1), high + (high - low) + timedelta(days=30))  # its watermark passes all windows and sessions
    mark = events.limit(0).unionByName(local_frame(spark, [(end, "error")], "ts timestamp_ntz, event_type string"),
                                       allowMissingColumns=True)  # an event that every derived log keeps, of no user
    control, root = shared_dir(spark, "control"), shared_dir(spark, "replay")
    events.limit(0).write.parquet(control)
    widest = replay.ordered_copy(events, f"{root}/events.parquet", slice_rows=SLICE_ROWS)
    # Written last, so it is taken last: the watermark then passes everything.
    mark.select(events.columns).write.mode("append").parquet(f"{root}/events.parquet")
    out = windows.drain(build(view(spark, root, name, control), f"{widest // SECOND + 2} seconds"), purpose)
    named = [c for c in ("audit_id", "window_us", "start_us") if c in out.columns]
    return out.filter(F.col(named[0]).isNotNull())  # without what the end mark itself gave


@query("budget_stream", BUDGET_RUN + "SELECT audit_id, user_name, outcome FROM admitted", BUDGET_SQL)
def budget_stream(spark, d):
    return _run(spark, d, "budget", lambda log, delay: stateful.budget_stream(
        log.select("audit_id", "user_name", "ts_us", "cost_cents"), budgets(spark, d), 20000, 8000, delay))


_ATTEMPTS, _WINDOW, _BASE, _MAX = 3, 12 * HOUR, 3 * HOUR, 24 * HOUR
_LOCK = {
    "attempts": """SELECT *, row_number() OVER (PARTITION BY kind, key ORDER BY ts_us, audit_id) AS n FROM (SELECT audit_id, ts_us, success, 'ip' AS kind, source_ip AS key FROM {auth_log}
  UNION ALL SELECT audit_id, ts_us, success, 'user', user_name FROM {auth_log}) x""",
}
_RECENT = f"list_append(list_filter(p.recent, lambda x: a.ts_us - x <= {_WINDOW}), a.ts_us)"
_LOCK_RUN = f"""WITH RECURSIVE walked AS (
 SELECT audit_id, kind, key, n, CASE WHEN success THEN 'success' ELSE 'failure' END AS outcome, cast(0 AS bigint) AS until, 0 AS rounds,
  CASE WHEN success THEN []::BIGINT[] ELSE [ts_us] END AS recent FROM {{attempts}} WHERE n = 1
 UNION ALL SELECT a.audit_id, a.kind, a.key, a.n,
  CASE WHEN p.until > a.ts_us THEN 'blocked' WHEN a.success THEN 'success' WHEN len({_RECENT}) >= {_ATTEMPTS} THEN 'locked_out' ELSE 'failure' END,
  CASE WHEN p.until > a.ts_us THEN p.until WHEN a.success THEN 0 WHEN len({_RECENT}) >= {_ATTEMPTS} THEN a.ts_us + least(cast({_BASE} * pow(2, p.rounds) AS bigint), {_MAX}) ELSE p.until END,
  CASE WHEN p.until > a.ts_us THEN p.rounds WHEN a.success THEN 0 WHEN len({_RECENT}) >= {_ATTEMPTS} THEN p.rounds + 1 ELSE p.rounds END,
  CASE WHEN p.until > a.ts_us THEN p.recent WHEN a.success OR len({_RECENT}) >= {_ATTEMPTS} THEN []::BIGINT[] ELSE {_RECENT} END
 FROM walked p JOIN {{attempts}} a ON a.kind = p.kind AND a.key = p.key AND a.n = p.n + 1)
SELECT audit_id, kind, key, outcome FROM walked"""


@query("lockout_stream", _LOCK_RUN, _LOCK)
def lockout_stream(spark, d):
    return _run(spark, d, "lockout", lambda log, delay: stateful.lockout_stream(log, _ATTEMPTS, _WINDOW, _BASE, _MAX, delay), "auth_log")


_COOLED = {**ALERT_SQL, "closed": f"""SELECT r.*, CASE rule WHEN 'denials' THEN {24 * HOUR} ELSE {12 * HOUR} END AS cooldown, row_number() OVER (PARTITION BY rule ORDER BY window_us) AS n
  FROM {{rule_counts}} r"""}
_COLD = "(p.fired IS NULL OR c.window_us - p.fired >= c.cooldown)"
_ALERT_RUN = f"""WITH RECURSIVE walked AS (
 SELECT rule, window_us, value, n, value >= threshold AS active, CASE WHEN value >= threshold THEN window_us END AS fired, CASE WHEN value >= threshold THEN 'fired' END AS event FROM {{closed}} WHERE n = 1
 UNION ALL SELECT c.rule, c.window_us, c.value, c.n, CASE WHEN NOT {_COLD} THEN p.active ELSE c.value >= c.threshold END,
  CASE WHEN {_COLD} AND c.value >= c.threshold AND NOT p.active THEN c.window_us ELSE p.fired END,
  CASE WHEN NOT {_COLD} THEN NULL WHEN c.value >= c.threshold AND NOT p.active THEN 'fired' WHEN c.value < c.threshold AND p.active THEN 'resolved' END
 FROM walked p JOIN {{closed}} c ON c.rule = p.rule AND c.n = p.n + 1)
SELECT rule, window_us, cast(value AS double) AS value, event FROM walked WHERE event IS NOT NULL"""


@query("alerts_stream", _ALERT_RUN, _COOLED)
def alerts_stream(spark, d):
    return _run(spark, d, "alerts", lambda log, delay: stateful.alerts_stream(alert_log(log, view(spark, d, "lineage")), RULES, delay))


def _counter_sql(windows_of: str) -> str:
    return f"""SELECT window_us, count(*) AS requests, count(*) FILTER (WHERE decision = 'BLOCK') AS blocked, count(*) FILTER (WHERE rate_limited) AS rate_limited,
 count(*) FILTER (WHERE error_code <> 'NONE') AS errors FROM (SELECT *, {windows_of} AS window_us FROM {{audit}}) x GROUP BY window_us"""


def _timed(log):
    return log.withColumn("ts", F.col("ts").cast("timestamp"))


@query("counters_stream", _counter_sql(f"ts_us - ts_us % {2 * SECOND}"))
def counters_stream(spark, d):
    return _run(spark, d, "counters", lambda log, delay: windows.counters(_timed(log), delay))


@query("sliding_counters_stream", _counter_sql(f"unnest([ts_us - ts_us % {30 * MINUTE}, ts_us - ts_us % {30 * MINUTE} - {30 * MINUTE}])"))
def sliding_counters_stream(spark, d):
    return _run(spark, d, "sliding", lambda log, delay: windows.counters(_timed(log), delay, width="60 minutes", slide="30 minutes"))


@query("session_activity", f"""SELECT user_name, min(ts_us) AS start_us, max(ts_us) + {4 * HOUR} AS end_us, count(*) AS events FROM (
 SELECT *, sum(fresh) OVER (PARTITION BY user_name ORDER BY ts_us, audit_id) AS session FROM (
 SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY user_name ORDER BY ts_us, audit_id) < {4 * HOUR} THEN 0 ELSE 1 END AS fresh FROM {{audit}}) a) b
 GROUP BY user_name, session""")
def session_activity(spark, d):
    return _run(spark, d, "sessions", lambda log, delay: windows.session_activity(_timed(log), "4 hours", delay))


_PROFILE = {
    "numbered": "SELECT *, row_number() OVER (PARTITION BY user_name ORDER BY ts_us, audit_id) AS n FROM {audit}",
    "parts": f"""SELECT audit_id, user_name, concat('NEW_TABLE:', tbl) AS anomaly, 0.3 AS score FROM (SELECT audit_id, user_name, tbl, n, min(n) OVER (PARTITION BY user_name, tbl) AS f
   FROM (SELECT audit_id, user_name, n, unnest(list_distinct(string_split(table_list, ','))) AS tbl FROM {{numbered}} WHERE table_list <> '') t) x WHERE n = f AND n > {AFTER}
  UNION ALL SELECT audit_id, user_name, 'NEW_QUERY_PATTERN', 0.2 FROM (SELECT *, min(n) OVER (PARTITION BY user_name, fingerprint_hash) AS f FROM {{numbered}} WHERE fingerprint_hash <> 0) x WHERE n = f AND n > {AFTER}
  UNION ALL SELECT audit_id, user_name, concat('UNUSUAL_HOUR:', cast(h AS string)), 0.2 FROM (SELECT *, min(n) OVER (PARTITION BY user_name, h) AS f FROM (SELECT *, extract(hour FROM ts) AS h FROM {{numbered}}) y) x WHERE n = f AND n > {AFTER}
  UNION ALL SELECT audit_id, user_name, 'VOLUME_SPIKE', 0.4 FROM (SELECT a.audit_id, a.user_name, b.total, b.squares, b.w, row_number() OVER (PARTITION BY a.user_name, b.window_us ORDER BY a.ts_us, a.audit_id) - 1 AS c
   FROM {{audit}} a JOIN {{baselines}} b ON a.user_name = b.user_name AND a.ts_us - a.ts_us % {DAY} = b.window_us) x
   WHERE w >= 2 AND w * c > total AND w * squares > total * total AND (w * c - total) * (w * c - total) > 2.25 * (w * squares - total * total)""",
    "baselines": f"""SELECT user_name, window_us, count(*) OVER w AS w, cast(sum(q) OVER w AS bigint) AS total, cast(sum(q * q) OVER w AS bigint) AS squares FROM (SELECT user_name, ts_us - ts_us % {DAY} AS window_us, count(*) AS q FROM {{audit}} GROUP BY 1, 2) c
  WINDOW w AS (PARTITION BY user_name ORDER BY window_us ROWS BETWEEN 288 PRECEDING AND 1 PRECEDING)""",
}


@query("anomaly_stream", """SELECT audit_id, user_name, cast(least(1.0, round(sum(score), 6)) AS double) AS anomaly_score, string_agg(anomaly, ',' ORDER BY anomaly) AS anomalies,
 sum(score) >= 0.5 AS is_anomalous FROM {parts} GROUP BY audit_id, user_name""", _PROFILE)
def anomaly_stream(spark, d):
    tables = F.when(F.col("table_list") == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.split("table_list", ",")))
    return _run(spark, d, "profiles", lambda log, delay: stateful.anomaly_stream(log.withColumn("tables", tables), AFTER, DAY, 288, 1.5, delay))


@query("audit_dedup_stream", "SELECT audit_id, user_name, sql_text FROM {audit}")
def audit_dedup_stream(spark, d):
    def build(log, delay):
        both = _timed(log).unionByName(_timed(log).filter("k % 3 = 0"))
        return windows.dedup(both.select("audit_id", "user_name", "sql_text", "ts"), delay)
    return _run(spark, d, "dedup", build).select("audit_id", "user_name", "sql_text")


@query("sql_firewall_stream", """SELECT audit_id FROM {audit} WHERE fingerprint_hash NOT IN (SELECT fingerprint_hash FROM {audit} WHERE ts_us < 1704078000000000)""")
def sql_firewall_stream(spark, d):
    from govspark.operators import logs
    learned = logs.firewall_learn(view(spark, d, "audit").filter("ts_us < 1704078000000000"), "fingerprint_hash")
    return _run(spark, d, "firewall", lambda log, delay: logs.firewall_check(log, learned, "fingerprint_hash", "violations").select("audit_id"))


_ARRIVALS, _PATIENCE = 4, 10 * DAY


@query("late_rows", f"""SELECT audit_id, ts_us, part > 0 AND ts_us < newest - {_PATIENCE} AS late FROM (
 SELECT a.audit_id, a.ts_us, a.part, (SELECT max(ts_us) FROM {{audit}} b WHERE b.audit_id % {_ARRIVALS} < a.part) AS newest FROM (SELECT *, audit_id % {_ARRIVALS} AS part FROM {{audit}}) a) x""")
def late_rows(spark, d):
    """The log arriving in four parts that each cover all its time, through a gate that waits ten days: every row, in time or late."""
    log = view(spark, d, "audit").select("audit_id", "ts_us", F.col("ts").cast("timestamp").alias("ts"))
    arrived = shared_dir(spark, "arrived")
    gate = replay.Gate(log.schema, _PATIENCE, spark)
    for part in range(_ARRIVALS):
        log.where(F.col("audit_id") % _ARRIVALS == part).write.mode("append").parquet(arrived)
        gate.drain(spark.readStream.schema(log.schema).parquet(arrived))
    return gate.tagged().select("audit_id", "ts_us", "late")
