"""Integrity, budgets, behaviour, alerts, sources and reports on small fixtures and brute force."""

import json
import random

import pytest
from pyspark.sql import functions as F

from govspark.operators import anomaly, cost, integrity, lineage, logs, policy, reliability, snapshots, synthetic
from govspark.plans import activity
from govspark.plans.fixtures import view
from govspark.runtime import local_frame
from govspark.sources import audit_log
from govspark.streaming import folds
from tests.conftest import SMALL

HOUR, DAY = 3_600_000_000, 86_400_000_000
CHAIN = "chain_id string, sequence_num long, ts_us long, user_name string, sql_text string, decision string"


def chain(spark, n=40):
    return local_frame(spark, [(f"c{i % 2}", i, i * 10, f"u{i % 3}", f"select {i} -- é|", "ALLOW") for i in range(n)], CHAIN)


def statuses(df):
    return {r.sequence_num: r.status for r in df.collect() if r.status != "ok"}


def test_seal_then_verify_is_clean_and_every_edit_is_found(spark):
    sealed = integrity.seal(chain(spark), "chain_id", 10).cache()
    check = lambda df: statuses(integrity.verify(df, "chain_id"))
    assert check(sealed) == {}
    for c in ("ts_us", "sequence_num"):
        assert check(sealed.withColumn(c, F.when(F.col("sequence_num") == 7, F.col(c) + (1000 if c == "ts_us" else 0)).otherwise(F.col(c)))).get(7) == (
            "bad_hash" if c == "ts_us" else None)
    for c in ("user_name", "sql_text", "decision"):
        assert check(sealed.withColumn(c, F.when(F.col("sequence_num") == 7, F.concat(c, F.lit("."))).otherwise(F.col(c)))) == {7: "bad_hash"}
    assert check(sealed.filter("sequence_num <> 4")) == {6: "bad_link"}
    assert check(sealed.withColumn("record_hash", F.when(F.col("sequence_num") != 5, F.col("record_hash")))) == {5: "unsealed", 7: "bad_link"}


def test_anchors_find_what_links_cannot(spark):
    sealed = integrity.seal(chain(spark), "chain_id", 10)
    stored = integrity.anchors(sealed, "chain_id").cache()
    bad = lambda df: sorted((r.chain_id, r.segment, r.status) for r in integrity.verify_anchors(df, stored, "chain_id").collect() if r.status != "ok")
    assert bad(sealed) == []
    assert bad(sealed.filter("sequence_num <> 38")) == [("c0", 30, "changed")]
    lost = bad(sealed.filter("NOT (chain_id = 'c1' AND segment = 10)"))
    assert lost == [("c1", 10, "missing_segment"), ("c1", 20, "changed")]


def test_gaps(spark):
    log = local_frame(spark, [("a", s) for s in (1, 2, 5, 6, 11)] + [("b", s) for s in (4, 5)], "c string, sequence_num long")
    got = [tuple(r) for r in integrity.sequence_gaps(log, ["c"]).orderBy("gap_start").collect()]
    assert got == [("a", 3, 4, 2), ("a", 7, 10, 4)]


@pytest.mark.parametrize("seed", [1, 2])
def test_budgets_equal_the_row_by_row_rule(spark, seed):
    rnd = random.Random(seed)
    rows = [(f"u{rnd.randint(0, 4)}", i, 1_704_067_200_000_000 + rnd.randint(0, 2 * DAY), rnd.choice([0, 5, 30, 70])) for i in range(700)]
    limits = {"u0": (200, 90), "u1": (0, 50), "u2": (150, 0), "u3": (0, 0)}
    log = local_frame(spark, rows, "user_name string, audit_id long, ts_us long, cost_cents long")
    budgets = local_frame(spark, [(u, d, h) for u, (d, h) in limits.items()], "user_name string, daily_cents long, hourly_cents long")
    got = {r.audit_id: r.outcome for r in cost.budget_decisions(log, budgets, 300, 100).collect()}
    states, want = {}, {}
    for u, i, ts, c in sorted(rows, key=lambda r: (r[2], r[1])):
        want[i] = folds.budget_step(states.setdefault(u, {}), ts, c, *limits.get(u, (300, 100)))
    assert got == want and {"admitted", "daily_exceeded", "hourly_exceeded"} <= set(want.values())


def test_anomalies_equal_the_profile_rule(spark):
    rnd = random.Random(3)
    rows, at = [], 1_704_067_200_000_000
    for i in range(900):
        at += rnd.choice([1, 40, 900]) * 1_000_000
        rows.append((rnd.choice(["a", "a", "a", "b"]), i, at, rnd.sample(["t1", "t2", "t3", "t4"], rnd.randint(0, 2)), rnd.choice([0, 1, 2, 3, i])))
    log = local_frame(spark, rows, "user_name string, audit_id long, ts_us long, tables array<string>, fingerprint_hash long")
    got = {r.audit_id: r.anomalies for r in anomaly.anomaly_scores(log, 30, 20 * 60_000_000, 288, 1.5).collect()}
    states, want = {}, {}
    for u, i, ts, tables, f in rows:
        found = folds.anomaly_step(states.setdefault(u, {"tables": set(), "patterns": set(), "hours": set()}), ts, tables, f, 30, 20 * 60_000_000, 288, 1.5)
        if found:
            want[i] = ",".join(sorted(found))
    assert got == want and any("VOLUME" in w for w in want.values()) and any("HOUR" in w for w in want.values())


def test_outages(spark):
    kinds = "FFTFSFFAFF"
    text = {"F": "Connection REFUSED", "T": "deadlock", "A": "syntax", "S": ""}
    log = local_frame(spark, [("db", i * 100, i, k == "S", text[k]) for i, k in enumerate(kinds)], "database_name string, ts_us long, audit_id long, execution_success boolean, error_message string")
    got = sorted((r.start_us, r.end_us, r.failures) for r in reliability.outage_episodes(log, 3).collect())
    assert got == [(0, 300, 3), (500, 900, 4)]


def test_error_order(spark):
    df = local_frame(spark, [("lock TIMEOUT",), ("Deadlock found",), ("serialization failure",), ("whatever",)], "m string")
    assert [r[0] for r in df.select(reliability.error_class(F.col("m"))).collect()] == ["INFRASTRUCTURE", "TRANSIENT", "TRANSIENT", "APPLICATION"]


def test_alert_resolves_in_an_empty_window(spark):
    rule = [{"name": "r", "condition": "rate_limit_breach", "threshold": 2, "window_us": 10, "cooldown_us": 0}]
    log = local_frame(spark, [(t, True) for t in (0, 1, 11, 12, 41, 55, 56)], "ts_us long, rate_limited boolean")
    got = [(r.window_us, r.event) for r in reliability.alert_episodes(reliability.alert_counts(log, rule)).orderBy("window_us").collect()]
    assert got == [(0, "fired"), (20, "resolved"), (50, "fired")]


def test_exposure_and_lost_events(spark):
    log = local_frame(spark, [(1, 10), (2, 12), (3, 13), (4, 20), (5, None)], "audit_id long, sequence_num long")
    lineage_rows = local_frame(spark, [(1, True), (2, False), (2, False), (3, True), (3, False)], "audit_id long, was_masked boolean")
    assert {r.audit_id: r.pii_exposed for r in reliability.with_exposure(log, lineage_rows).collect()} == {1: False, 2: True, 3: True, 4: False, 5: False}
    assert {r.audit_id: r.lost_events for r in reliability.with_lost_events(log).collect()} == {1: 0, 2: 1, 3: 0, 4: 6, 5: 0}


def test_overflow_rules_of_two_widths(spark):
    rules = [{"name": n, "condition": "audit_buffer_overflow", "threshold": 3, "window_us": w, "cooldown_us": 0} for n, w in (("narrow", 10), ("wide", 20))]
    log = local_frame(spark, [(t, s) for t, s in ((0, 1), (5, 2), (12, 5), (18, 7), (31, 8), (33, 9))], "ts_us long, sequence_num long")
    counts = {(r.rule, r.window_us): r.value for r in reliability.alert_counts(reliability.with_lost_events(log), rules).collect()}
    assert counts == {("narrow", 0): 0, ("narrow", 10): 3, ("narrow", 20): 0, ("narrow", 30): 0, ("wide", 0): 3, ("wide", 20): 0}


def test_alert_cooldown():
    state, events = {}, []
    for w, v in enumerate([5, 0, 5, 0, 0, 5, 5, 0]):
        events.append(folds.alert_step(state, w, v, 3, 3))
    assert events == ["fired", None, None, "resolved", None, "fired", None, None]


def test_lockout_doubles_and_success_forgets():
    state = {}
    step = lambda t, ok=False: folds.lockout_step(state, t, ok, 2, 10, 100, 250)
    assert [step(0), step(1), step(50), step(102), step(103), step(302), step(304), step(305)] == [
        "failure", "locked_out", "blocked", "failure", "locked_out", "blocked", "failure", "locked_out"]
    assert state["until"] == 305 + 250 and step(600, True) == "success" and state == {}
    assert [step(700), step(711), step(712)] == ["failure", "failure", "locked_out"]


def test_log_reader_drops_and_defaults(spark, tmp_path):
    lines = [json.dumps({"audit_id": 1, "user": "a", "sql": "x", "decision": "allow", "statement_type": "select", "roles": ["r"], "tables": ["t"], "spans": [{"id": "1", "op": "p", "dur_us": 5}]}),
             "", "not json", json.dumps({"user": "a", "sql": "x"}), json.dumps({"user": "", "sql": "x", "decision": "ALLOW"}),
             json.dumps({"audit_id": 2, "user": "b", "sql": "y", "decision": "PERHAPS", "statement_type": "ODD", "database": "d"})]
    (tmp_path / "log.json").write_text("\n".join(lines))
    got = audit_log.read_audit_log(spark, str(tmp_path)).orderBy("audit_id").collect()
    assert [(r.audit_id, r.database, r.decision, r.statement_type) for r in got] == [(1, "default", "ALLOW", "SELECT"), (2, "d", "BLOCK", "UNKNOWN")]
    assert got[0].spans[0].dur_us == 5


def test_log_writer_splits_files_and_days(spark, tmp_path):
    log = activity.as_audit(spark, SMALL)
    audit_log.write_audit_log(log, str(tmp_path / "o"), max_records=100, tasks_per_day=2)
    assert len({p.parent.name for p in (tmp_path / "o").glob("date=*/*.json")}) == 30
    assert audit_log.read_audit_log(spark, str(tmp_path / "o")).count() == log.filter("sql IS NOT NULL").count()


def test_sampling(spark):
    log = local_frame(spark, [(1, "BLOCK", "NONE", "SELECT", 9999), (2, "ALLOW", "QUERY_TIMEOUT", "SELECT", 9999), (3, "ALLOW", "NONE", "DELETE", 9999),
                              (4, "ALLOW", "NONE", "SELECT", 499), (5, "ALLOW", "NONE", "SELECT", 500), (6, "ALLOW", "NONE", "SHOW", 9999), (7, "ALLOW", "NONE", "SELECT", -1)],
                      "id int, decision string, error_code string, statement_type string, fingerprint_hash long")
    assert [r.id for r in logs.audit_sample(log, 0.05, 1.0).orderBy("id").collect()] == [1, 2, 3, 4, 6]
    assert [r.id for r in logs.audit_sample(log, 0.0, 0.0).orderBy("id").collect()] == [1, 2, 3]


def test_allowlist_edges(spark):
    log = local_frame(spark, [(i, k, ip) for i, (k, ip) in enumerate([("a", "10.1.2.3"), ("a", "11.0.0.1"), ("a", "10.1.2"), ("b", "junk"), ("c", "1.2.3.4"), ("d", "9.9.9.9"), ("a", "10.1.2.300")])],
                      "i int, k string, source_ip string")
    entries = local_frame(spark, [("a", "10.0.0.9/8"), ("c", "nonsense"), ("d", "0.0.0.0/0")], "k string, cidr string")
    got = {r.i: r.ip_allowed for r in logs.ip_allowlist(log, entries, "k").collect()}
    assert got == {0: True, 1: False, 2: False, 3: True, 4: False, 5: True, 6: False}


def test_access_request_states(spark):
    h = lambda n: n * HOUR
    rows = [(1, "u", "d", "t", 0, "APPROVED", h(1), 5), (2, "u", "d", "t", h(150), "DENIED", h(151), 5), (3, "u", "d", "t", h(199), "APPROVED", h(199), 0),
            (4, "u", "d", "t", h(100), "APPROVED", h(250), 5), (5, "u", "d", "t", h(260), "PENDING", None, 5), (6, "u", "d", "t", h(190), "APPROVED", h(190), 5)]
    req = local_frame(spark, rows, "request_id long, user_name string, database_name string, table_name string, created_us long, status string, decided_us long, requested_hours int")
    got = {r.request_id: r.state for r in snapshots.access_requests_as_of(req, h(200)).collect()}
    assert got == {2: "DENIED", 3: "APPROVED", 4: "PENDING", 6: "EXPIRED"}


def test_describe(spark):
    df = local_frame(spark, [("SELECT", ["a", "b"], [], ["id"], ["x", "y"], []), ("DELETE", [], ["a"], ["id"], [], []), ("DROP_TABLE", [], ["a"], [], [], []), ("SHOW", ["a"], [], [], [], []), ("SELECT", [], [], [], [], [])],
                     "statement_type string, tables_read array<string>, tables_written array<string>, columns_filtered array<string>, columns_selected array<string>, columns_written array<string>")
    assert [r.summary for r in logs.describe_queries(df).collect()] == [
        "This SELECT reads from 'a', 'b', filtering by 'id', returning: x, y", "This DELETE removes from 'a', filtering by 'id'",
        "This DROP_TABLE targets 'a'", "This SHOW references 'a'", "This SELECT"]


def test_catalog_ties_keep_the_earliest(spark):
    rows = [(i, t, "u", "d", "t", "c", cls, conf, "s", False) for i, (t, cls, conf) in enumerate([(5, "A", 0.8), (1, "B", 0.9), (2, "C", 0.9), (9, "D", 0.5)])]
    ev = local_frame(spark, rows, "audit_id long, ts_us long, user_name string, database_name string, table_name string, column_name string, classification string, confidence double, strategy string, was_masked boolean")
    r = lineage.catalog_columns(ev).first()
    assert (r.pii_type, r.confidence, r.accesses, r.users, r.first_seen_us, r.last_seen_us) == ("B", 0.9, 4, 1, 1, 9)
    s = lineage.lineage_summary(ev).first()
    assert (s.classification, s.total_accesses, s.users) == ("B", 4, 1)
    approx = lineage.lineage_summary(view(spark, SMALL, "lineage"), exact=False)
    assert approx.agg(F.sum("total_accesses")).first()[0] == view(spark, SMALL, "lineage").count()


def test_grants_pick_the_last_ending(spark):
    log = local_frame(spark, [(1, "u", "d", "t", "SELECT", 50), (2, "u", "d", "t", "SELECT", 99), (3, "v", "d", "t", "SELECT", 50)], "audit_id long, user string, database string, table string, statement_type string, ts_us long")
    g = local_frame(spark, [(7, "u", "d", "t", [], 0, 60), (8, "u", "d", "t", ["SELECT"], 40, 70), (9, "u", "d", "t", ["INSERT"], 0, 90)],
                    "request_id long, user string, database string, table string, statement_types array<string>, valid_from_us long, valid_until_us long")
    assert [(r.audit_id, r.grant_policy) for r in policy.grant_coverage(log, g).collect()] == [(1, "access_grant_8")]


def test_synthetic_is_a_function_of_the_index(spark):
    r = synthetic.synthetic_data(spark.range(28, 29), [("e", "text", "PII.Email"), ("d", "timestamp", None), ("p", "real", None), ("u", "uuid", None), ("x", "hstore", None)]).first()
    assert tuple(r) == ("user29@example.com", "2024-02-01", "42.50", "00000000-0000-0000-0000-000000000028", "x_29")


def test_sealing_keeps_every_row(spark):
    rows = [("a", 1, "x"), ("a", 1, "y"), ("a", 2, "z"), (None, 3, "n"), ("a", None, "m"), ("b", 1, "x"), ("b", 1, "x")]
    log = local_frame(spark, [(c, n, 0, "u", t, "ALLOW") for c, n, t in rows],
                      "chain_id string, sequence_num long, ts_us long, user_name string, sql_text string, decision string")
    sealed = integrity.seal(log, "chain_id", 10)
    assert sorted((r.chain_id or "", r.sequence_num or 0, r.sql_text) for r in sealed.collect()) == sorted((c or "", n or 0, t) for c, n, t in rows)
    assert sealed.filter("record_hash IS NULL").count() == 2
    status = {(r.chain_id, r.sequence_num): r.status for r in integrity.verify(sealed, "chain_id").collect() if r.sql_text in "nmz"}
    assert status[(None, 3)] == status[("a", None)] == "unplaced" and status[("a", 2)] == "ok"


def test_repeated_sequence_numbers_verify_in_any_order(spark):
    """Rows that share a sequence number: clean in whatever order they lie, anchors too; an edit stays one bad row."""
    rows = [("c", n, 0, f"u{i % 2}", f"q{i * 7 % 5}", "ALLOW") for n in range(40) for i in range(3)]
    sealed = integrity.seal(local_frame(spark, rows, CHAIN), "chain_id", 10)
    first = integrity.anchors(sealed, "chain_id").orderBy("segment").collect()
    for order in (F.rand(1), F.rand(2), F.desc("sql_text")):
        lying = sealed.orderBy(order)
        assert statuses(integrity.verify(lying, "chain_id")) == {}
        assert integrity.anchors(lying, "chain_id").orderBy("segment").collect() == first
    edited = sealed.withColumn("sql_text", F.when((F.col("chain_pos") == 5) & (F.col("segment") == 10), "zzz").otherwise(F.col("sql_text")))
    assert [r.status for r in integrity.verify(edited, "chain_id").where("status <> 'ok'").collect()] == ["bad_hash"]


def test_cut_tails_reach_the_report(spark):
    sealed = integrity.seal(chain(spark), "chain_id", 10)
    stored = integrity.anchors(sealed, "chain_id")
    assert integrity.broken(sealed, stored, "chain_id").first().broken == 0
    assert integrity.broken(sealed.where("sequence_num < 38"), stored, "chain_id").first().broken > 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 64, 100])
def test_every_record_is_proved_by_few_hashes(spark, n):
    import hashlib
    import math
    rows = [("c", i, 0, "u", f"q{i}", "ALLOW") for i in range(n)]
    sealed = integrity.seal(local_frame(spark, rows, CHAIN), "chain_id", 1000)
    hashes = {r.chain_pos: r.record_hash for r in sealed.collect()}
    level = [hashes[i] for i in range(1, n + 1)]
    while len(level) > 1:
        level = [hashlib.sha256((level[i] + level[i + 1]).encode()).hexdigest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    tree = integrity.hash_tree(sealed, "chain_id").cache()
    root = integrity.tree_roots(tree, "chain_id").first().root_hash
    assert root == level[0]
    for pos in {1, 2, n // 2 + 1, n}:
        if pos <= n:
            proof = integrity.record_proof(tree, "chain_id", "c", 0, pos)
            assert len(proof) <= math.ceil(math.log2(n)) if n > 1 else not proof
            assert integrity.proves(hashes[pos], proof, root) and (n == 1 or not integrity.proves("0" * 64, proof, root))


def test_hash_tree_of_several_chains_and_segments(spark):
    sealed = integrity.seal(chain(spark, 90), "chain_id", 10)
    tree = integrity.hash_tree(sealed, "chain_id")
    assert tree.where("level = 0").count() == 90
    roots = integrity.tree_roots(tree, "chain_id").count()
    assert roots == sealed.select("chain_id", "segment").distinct().count() and integrity.hash_tree(sealed.limit(0), "chain_id").count() == 0


@pytest.mark.parametrize("broadcast", [20_000, 0])
def test_allowlist_in_both_forms(spark, broadcast):
    import ipaddress
    import random as r
    rnd = r.Random(3)
    cidrs = [(rnd.choice(["a", "b"]), f"10.{rnd.randrange(3)}.{rnd.randrange(4)}.{rnd.randrange(256)}/{rnd.randrange(20, 33)}") for _ in range(60)] + [("b", "nonsense"), ("c", "x/99"), (None, "10.0.0.0/8")]
    rows = [(i, rnd.choice(["a", "b", "c", "d", None]), rnd.choice([f"10.{rnd.randrange(3)}.{rnd.randrange(4)}.{rnd.randrange(256)}", "bad", None])) for i in range(400)]
    log = local_frame(spark, rows, "i long, k string, source_ip string")
    got = {x.i: x.ip_allowed for x in logs.ip_allowlist(log, local_frame(spark, cidrs, "k string, cidr string"), "k", broadcast_rows=broadcast).collect()}

    def plain(key, ip):
        mine = [c for k, c in cidrs if k == key and key is not None]
        if not mine:
            return True
        if ip in ("bad", None):
            return False
        return any(ipaddress.ip_address(ip) in ipaddress.ip_network(c, strict=False) for c in mine if c[0] == "1")

    assert got == {i: plain(k, ip) for i, k, ip in rows}


def test_a_hundred_thousand_ranges_and_grants_of_one_key(spark):
    entries = spark.range(100_000).selectExpr("'k' AS k", "concat('10.', id div 65536, '.', id div 256 % 256, '.', id % 256) AS cidr").where("cidr NOT LIKE '%.77'")
    log = spark.range(2_000).selectExpr("id AS i", "'k' AS k", "concat('10.0.', id % 256, '.', id % 100) AS source_ip")
    found = logs.ip_allowlist(log, entries, "k")
    assert found.where("ip_allowed = (source_ip LIKE '%.77')").count() == 0
    grants = spark.range(100_000).selectExpr("id AS request_id", "'u' AS user", "'d' AS database", "'t' AS table", "array('SELECT') AS statement_types",
                                             "id * 10 AS valid_from_us", "id * 10 + 4 AS valid_until_us")
    reads = spark.range(1_000).selectExpr("id AS audit_id", "'u' AS user", "'d' AS database", "'t' AS table", "'SELECT' AS statement_type", "id * 503 AS ts_us")
    covered = policy.grant_coverage(reads, grants)
    assert sorted((x.audit_id, x.grant_policy) for x in covered.collect()) == [(i, f"access_grant_{i * 503 // 10}") for i in range(1000) if i * 503 % 10 <= 4 and i * 503 // 10 < 100_000]


@pytest.mark.parametrize("broadcast", [20_000, 0])
def test_grants_in_both_forms(spark, broadcast):
    import random as r
    rnd = r.Random(8)
    grants = [(i, rnd.choice(["u1", "u2", None]), "d", rnd.choice(["t1", "t2"]), rnd.choice([[], ["SELECT"], ["INSERT", "SELECT"]]), a, a + rnd.randrange(0, 60))
              for i, a in enumerate(rnd.randrange(100) for _ in range(80))]
    rows = [(i, rnd.choice(["u1", "u2", "u3", None]), "d", rnd.choice(["t1", "t2"]), rnd.choice(["SELECT", "INSERT"]), rnd.randrange(160)) for i in range(300)]
    log = local_frame(spark, rows, "audit_id long, user string, database string, table string, statement_type string, ts_us long")
    given = local_frame(spark, grants, "request_id long, user string, database string, table string, statement_types array<string>, valid_from_us long, valid_until_us long")
    got = {x.audit_id: x.grant_policy for x in policy.grant_coverage(log, given, broadcast_rows=broadcast).collect()}
    want = {}
    for i, u, d, t, op, ts in rows:
        fits = [(g[6], g[0]) for g in grants if u is not None and (g[1], g[2], g[3]) == (u, d, t) and g[5] <= ts <= g[6] and (not g[4] or op in g[4])]
        if fits:
            want[i] = f"access_grant_{max(fits)[1]}"
    assert got == want
