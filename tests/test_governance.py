from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from govspark.functions import crypto, masking
from govspark.operators import governance, policy
from govspark.operators.governance import AccessDenied, ColumnDecision, LimitRule, Principal, RowRule
from govspark.plans.governed import AS_OF, POLICIES_V1
from govspark.runtime import local_frame
from govspark.sources.policies import load_policies
from tests.conftest import SMALL

ANA = Principal("ana", ("analyst",), {"seg": "FURNITURE"}, "testdb")
READ_ALL = [{"name": "read", "action": "ALLOW", "users": ["*"]},
            {"name": "mask", "action": "ALLOW", "users": ["*"], "table": "customer", "columns": ["c_name"], "masking_action": "hash"},
            {"name": "hide", "action": "BLOCK", "users": ["*"], "table": "customer", "columns": ["c_acctbal"]}]
TABLES = {t: (lambda s, t=t: s.read.parquet(f"{SMALL}/{t}.parquet")) for t in ("customer", "orders")}
RULE = RowRule("c_mktsegment = '$ATTR.seg'", table="customer")


def run(spark, sql, policies=READ_ALL, **kw):
    return governance.governed_query(spark, sql, ANA, load_policies(spark, policies), TABLES, AS_OF, rules=[RULE], **kw)


def test_masks(spark):
    df = local_frame(spark, [("abcdefgh",), ("abcdef",), ("",), (None,), ("é" * 7,)], "v string")
    rows = df.select(masking.mask_partial(F.col("v")), masking.mask_redact(F.col("v")), masking.mask_hash(F.col("v")),
                     masking.mask_nullify(F.col("v"))).collect()
    assert [r[0] for r in rows] == ["abc***fgh", "***REDACTED***", "***REDACTED***", None, "ééé***ééé"]
    assert [r[1] for r in rows] == ["***REDACTED***"] * 3 + [None, "***REDACTED***"]
    assert rows[2][2] == "e3b0c44298fc1c14" and rows[3][2] is None
    assert all(r[3] is None for r in rows)


def test_user_text_cannot_escape_the_row_filter(spark):
    for sql in ("SELECT c_custkey, c_mktsegment FROM customer WHERE 1 = 0 OR 1 = 1",
                "SELECT c_custkey, c_mktsegment FROM (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' OR true) x",
                "WITH c AS (SELECT * FROM customer) SELECT c_custkey, c_mktsegment FROM c UNION ALL SELECT c_custkey, c_mktsegment FROM customer"):
        segments = {r.c_mktsegment for r in run(spark, sql).df.collect()}
        assert segments == {"FURNITURE"}


def test_aliases_and_expressions_see_masked_values(spark):
    rows = run(spark, "SELECT c_name AS n, upper(c_name) AS u FROM customer").df.collect()
    assert rows and all(len(r.n) == 16 and r.u == r.n.upper() for r in rows)
    assert run(spark, "SELECT count(*) AS n FROM customer WHERE c_name LIKE 'Customer%'").df.first().n == 0


def test_blocked_column_is_not_there(spark):
    with pytest.raises(Exception, match="c_acctbal"):
        run(spark, "SELECT c_acctbal FROM customer").df.collect()


@pytest.mark.parametrize("sql", [
    f"SELECT * FROM parquet.`{SMALL}/customer.parquet`", "SELECT * FROM nation", "SELECT * FROM global_temp.x", "SELECT * FROM range(5)",
    "SELECT * FROM customer WHERE c_custkey IN (SELECT n_nationkey FROM nation)", "DROP TABLE customer", "CREATE TABLE x AS SELECT 1",
    "WITH nope AS (SELECT * FROM secrets) SELECT * FROM nope", "SHOW TABLES", "SET spark.x=1", "INSERT INTO customer SELECT * FROM customer"])
def test_everything_else_is_denied(spark, sql):
    with pytest.raises(AccessDenied):
        run(spark, sql)


def test_views_of_the_session_stay_out_of_reach(spark):
    spark.range(3).createOrReplaceTempView("leak")
    with pytest.raises(AccessDenied):
        run(spark, "WITH leak AS (SELECT 1 AS id) SELECT * FROM leak")
    spark.catalog.dropTempView("leak")


def test_denied_by_policy_carries_the_reason(spark):
    rules = READ_ALL + [{"name": "closed", "action": "BLOCK", "users": ["*"], "table": "orders", "reason": "quarter end"}]
    with pytest.raises(AccessDenied, match="closed: quarter end"):
        run(spark, "SELECT 1 FROM orders", rules)
    with pytest.raises(AccessDenied, match="default_deny"):
        run(spark, "SELECT 1 FROM orders", READ_ALL[1:])


def test_limits(spark):
    assert run(spark, "SELECT * FROM orders", limits=[LimitRule(7)]).df.count() == 7
    assert run(spark, "SELECT * FROM orders LIMIT 9", limits=[LimitRule(7)]).df.count() == 9
    with pytest.raises(governance.ResultTooLarge):
        governance.guarded(run(spark, "SELECT * FROM orders", max_rows=10).df.collect)


def test_filter_is_pushed_and_blocked_column_never_read(spark):
    plan = run(spark, "SELECT c_custkey FROM customer").df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_mktsegment,FURNITURE)" in plan
    assert "c_acctbal" not in plan and "c_name" not in plan.split("ReadSchema")[1]


def test_placeholders_are_bound_not_spliced(spark):
    evil = Principal("x' OR '1'='1", ("a' OR 1=1 --",), {"k": "v' OR true --"})
    condition, args = governance.bind_condition("o = '$USER' AND r IN ($ROLES) AND a = $ATTR.k AND p LIKE '%$ATTR.none%' AND q = 'it''s'", evil)
    assert "OR" not in condition and set(args.values()) == {evil.user, evil.roles[0], "v' OR true --", "none"}
    df = local_frame(spark, [("x",), ("x' OR '1'='1",)], "o string")
    assert governance.rls_filter(df, [RowRule("o = '$USER'")], evil, "t").count() == 1


def test_encryption(spark):
    keys = local_frame(spark, [("k1", b"1" * 32, False), ("k2", b"2" * 32, True)], "key_id string, key binary, active boolean")
    df = local_frame(spark, [(1, "abc"), (2, None), (3, ""), (4, "é" * 500)], "id int, v string")
    e = crypto.encrypt_columns(df, ["v"], keys)
    texts = {r.id: r.v for r in e.collect()}
    assert texts[2] is None and all(t.startswith("ENC:v1:k2:") and "\n" not in t for i, t in texts.items() if i != 2)
    back = {r.id: r.v for r in crypto.decrypt_columns(e, ["v"], keys).collect()}
    assert back == {1: "abc", 2: None, 3: "", 4: "é" * 500}
    mixed = local_frame(spark, [("plain",), (None,), ("ENC:v1:k9:" + "QUJD" * 12,), (texts[1],)], "v string")
    other = local_frame(spark, [("k1", b"1" * 32, True), ("k2", b"2" * 32, False)], "key_id string, key binary, active boolean")
    rotated = [r.v for r in crypto.rotate_keys(mixed, ["v"], other).collect()]
    assert rotated[:3] == ["plain", None, "ENC:v1:k9:" + "QUJD" * 12] and rotated[3].startswith("ENC:v1:k1:")
    bad = local_frame(spark, [("plain",), ("ENC:v1:k9:QUJD",), (texts[1][:-4] + "AAA=",), ("ENC:v1:k2:!!",)], "v string")
    assert [r.v for r in crypto.decrypt_columns(bad, ["v"], keys).collect()] == [r.v for r in bad.collect()]


def test_mutations(spark):
    df = local_frame(spark, [(1, "a"), (2, None)], "id int, v string")
    version, changed = governance.spec_mutate(df, {"op": "delete", "where": {"v": "a"}, "returning": ["id"]})
    assert [r.id for r in version.collect()] == [2] and [r.id for r in changed.collect()] == [1]
    version, changed = governance.spec_mutate(df, {"op": "update", "where": {"id": 2}, "values": {"v": "z"}})
    assert {r.id: r.v for r in version.collect()} == {1: "a", 2: "z"} and changed.first().v == "z"


def test_apply_masking_reports(spark):
    df = local_frame(spark, [("abcdefgh", "x")], "a string, b string")
    out, report = governance.apply_masking(df, {"a": ColumnDecision("a", masking_action="PARTIAL", prefix=1, suffix=1),
                                                "b": ColumnDecision("b", "BLOCK", masking_action="HASH")})
    assert out.first().asDict() == {"a": "a***h", "b": "x"} and report == [("a", "PARTIAL")]


def test_no_join_or_shuffle_when_deciding(spark):
    log = local_frame(spark, [(1, "u1", ["analyst"], "testdb", "SELECT", ["customer", "orders"], 0)],
                      "audit_id long, user string, roles array<string>, database string, statement_type string, tables array<string>, ts_us long")
    plan = policy.decide_queries(log, load_policies(spark, POLICIES_V1))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_time_limited_policy_includes_its_bounds(spark):
    at = lambda h: datetime(2024, 1, 1, h, tzinfo=timezone.utc)
    p = load_policies(spark, [{"name": "t", "action": "ALLOW", "users": ["*"], "valid_from": at(1), "valid_until": at(2)}])
    rows = [(i, "u", ["r"], "d", "x", "SELECT", at(h)) for i, h in enumerate((0, 1, 2, 3))]
    req = local_frame(spark, rows, "id int, user string, roles array<string>, database string, table string, statement_type string, ts timestamp")
    assert [r.decision for r in policy.evaluate_tables(req, p, ["id"]).orderBy("id").collect()] == ["BLOCK", "ALLOW", "ALLOW", "BLOCK"]


def test_encrypted_columns_are_opened_below_the_masks(spark, tmp_path):
    rows = [("k1", b"1" * 32, True)]
    keys = lambda s: local_frame(s, rows, "key_id string, key binary, active boolean")
    plain = local_frame(spark, [(1, "Customer#1", "FURNITURE"), (2, "Customer#2", "BUILDING")], "c_custkey long, c_name string, c_mktsegment string")
    crypto.encrypt_columns(plain, ["c_name"], keys(spark)).write.parquet(str(tmp_path / "c"))
    out = governance.governed_query(spark, "SELECT * FROM customer", ANA, load_policies(spark, READ_ALL),
                                    {"customer": lambda s: s.read.parquet(str(tmp_path / "c"))}, AS_OF, rules=[RULE],
                                    encrypted={"customer": ["c_name"]}, keys=keys)
    want = plain.filter("c_custkey = 1").select(masking.mask_hash(F.col("c_name"))).first()[0]
    assert [r.c_name for r in out.df.collect()] == [want] and out.masked == [("customer.c_name", "HASH")]
    assert "1" * 32 not in out.df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("sql", [
    "WITH `text.secretfile` AS (SELECT 1 AS a) SELECT * FROM text.`secretfile`",
    "WITH q AS (SELECT 1 AS a) SELECT * FROM (WITH r AS (SELECT 2 AS a) SELECT * FROM r) x JOIN r ON true",
    "SELECT reflect('java.lang.System', 'getProperty', 'user.home') FROM customer",
    "SELECT try_reflect('java.lang.System', 'getProperty', 'user.home') FROM customer",
    "SELECT java_method('java.lang.System', 'getProperty', 'user.home') FROM customer",
    "SELECT count(*) FROM customer WHERE c_name IN (SELECT reflect('java.lang.System', 'getProperty', 'user.home'))",
    "SELECT input_file_name() FROM customer",
    "SELECT * FROM parquet.`/root/testdata/sf0.001/customer.parquet`",
])
def test_files_reflection_and_out_of_scope_ctes_are_refused(spark, sql):
    with pytest.raises(AccessDenied):
        run(spark, sql)



def test_log_lines_survive_a_rotation(spark):
    ring = lambda active: local_frame(spark, [(k, k.encode() * 16, k == active) for k in ("k1", "k2")], "key_id string, key binary, active boolean")
    log = local_frame(spark, [(1, "SELECT 1"), (2, None)], "id int, sql string")
    old = crypto.encrypt_audit(log, ring("k1"))
    assert all(r.line.startswith("AENC:v1:k1:") for r in old.collect())
    lines = old.union(local_frame(spark, [('{"id":3}',), ("AENC:v1:k9:" + "QUJD" * 12,)], "line string"))
    rows = {(r.id, r.sql, r._unopened) for r in crypto.decrypt_audit(lines, ring("k2"), log.schema).collect()}
    assert rows == {(1, "SELECT 1", None), (2, None, None), (3, None, None), (None, None, "AENC:v1:k9:" + "QUJD" * 12)}


@pytest.mark.parametrize("keys", [[("k1", True), ("k2", True)], [("k1", False)]])
def test_one_key_must_be_active(spark, keys):
    ring = local_frame(spark, [(k, b"1" * 32, a) for k, a in keys], "key_id string, key binary, active boolean")
    with pytest.raises(Exception, match="active keys"):
        crypto.encrypt_columns(local_frame(spark, [("a",)], "v string"), ["v"], ring).collect()


def test_repeated_key_ids_fail(spark):
    ring = local_frame(spark, [("k1", b"1" * 32, True), ("k1", b"2" * 32, False)], "key_id string, key binary, active boolean")
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        crypto.decrypt_columns(local_frame(spark, [("ENC:v1:k1:" + "QUJD" * 12,)], "v string"), ["v"], ring).collect()
