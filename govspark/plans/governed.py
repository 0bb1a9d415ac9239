"""Registered queries: policies, row and column control, masks, encryption, structured requests."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govspark import schemas
from govspark.functions import crypto, masking
from govspark.operators import governance, logs, policy, reliability
from govspark.operators.governance import ColumnDecision, LimitRule, Principal, RowRule
from govspark.plans.fixtures import table, view
from govspark.plans.registry import query
from govspark.runtime import local_frame, spread
from govspark.sources.policies import RAW, load_policies, policy_error

JAN = lambda d: datetime(2024, 1, d, tzinfo=timezone.utc)
AS_OF = JAN(15)

POLICIES_V1 = [
    {"name": "admin_all", "priority": 100, "action": "ALLOW", "roles": ["admin"]},
    {"name": "analyst_read", "priority": 50, "action": "ALLOW", "roles": ["analyst"], "statement_types": ["SELECT"]},
    {"name": "developer_orders", "priority": 60, "action": "ALLOW", "roles": ["developer"], "table": "orders"},
    {"name": "developer_no_update", "priority": 60, "action": "BLOCK", "roles": ["developer"], "table": "orders",
     "statement_types": ["UPDATE"], "reason": "orders are append-only"},
    {"name": "auditor_sales", "priority": 40, "action": "ALLOW", "roles": ["auditor"], "database": "salesdb"},
    {"name": "no_lineitem_writes", "priority": 80, "action": "BLOCK", "users": ["*"], "table": "lineitem",
     "statement_types": ["INSERT", "UPDATE"], "reason": "read-only table"},
    {"name": "shadow_supplier", "priority": 90, "action": "BLOCK", "users": ["*"], "table": "supplier", "shadow": True},
    {"name": "part_campaign", "priority": 70, "action": "ALLOW", "users": ["*"], "table": "part",
     "valid_from": JAN(10), "valid_until": JAN(20)},
    {"name": "customer_not_developers", "priority": 30, "action": "ALLOW", "users": ["*"],
     "exclude_roles": ["developer"], "database": "testdb", "table": "customer"},
    {"name": "sales_closed", "priority": 10, "action": "BLOCK", "users": ["*"], "database": "salesdb"},
    {"name": "one_user", "priority": 20, "action": "ALLOW", "users": ["u2", "u6"], "roles": ["auditor"], "schema": "public"},
    {"name": "mask_customer_name", "priority": 50, "action": "ALLOW", "roles": ["analyst"], "table": "customer",
     "columns": ["c_name"], "masking_action": "partial", "masking_prefix_len": 3, "masking_suffix_len": 2},
    {"name": "hide_balance", "priority": 50, "action": "BLOCK", "roles": ["analyst"], "table": "customer", "columns": ["c_acctbal"]},
    {"name": "hash_suppliers", "priority": 10, "action": "ALLOW", "users": ["*"], "table": "supplier", "columns": ["*"],
     "masking_action": "hash"},
    {"name": "price_tie_allow", "priority": 30, "action": "ALLOW", "users": ["*"], "table": "orders", "columns": ["o_totalprice"],
     "masking_action": "nullify"},
    {"name": "price_tie_block", "priority": 30, "action": "BLOCK", "users": ["*"], "exclude_roles": ["admin"], "table": "orders",
     "columns": ["o_totalprice"]},
]
POLICIES_V2 = [p for p in POLICIES_V1 if p["name"] not in ("auditor_sales", "developer_no_update")] + [
    {"name": "developer_customer", "priority": 55, "action": "ALLOW", "roles": ["developer"], "table": "customer"},
    {"name": "lineitem_closed", "priority": 99, "action": "BLOCK", "users": ["*"], "table": "lineitem"},
]


def _values(policies: list[dict]) -> str:
    text = lambda v: "NULL" if v is None else "'" + str(v) + "'"
    items = lambda v: "[" + ", ".join(text(x) for x in v or []) + "]::VARCHAR[]"
    us = lambda v: "NULL::BIGINT" if v is None else str(int(v.timestamp() * 1_000_000))
    rows = []
    for i, p in enumerate(policies):
        spec = (1 if p.get("database") else 0) + (2 if p.get("schema") else 0) + (4 if p.get("table") else 0) + (8 if p.get("columns") else 0)
        rows.append("(" + ", ".join([
            text(p["name"]), str(p["priority"]), text(p["action"]), items(p.get("users")), items(p.get("roles")),
            items(p.get("exclude_roles")), text(p.get("database")), text(p.get("schema")), text(p.get("table")),
            items(p.get("columns")), items(p.get("statement_types")), text((p.get("masking_action") or "NONE").upper()),
            str(p.get("shadow", False)), us(p.get("valid_from")), us(p.get("valid_until")), str(i), str(spec)]) + ")")
    return ("SELECT * FROM (VALUES " + ",\n ".join(rows) + ") AS v(name, priority, action, users, roles, excl, db, sch, tbl, "
            "cols, ops, mask, shadow, from_us, until_us, ord, spec)")


_MATCH = """(len(p.users) = 0 OR list_contains(p.users, '*') OR list_contains(p.users, q.user_name))
 AND (len(p.roles) = 0 OR list_contains(p.roles, q.role)) AND NOT list_contains(p.excl, q.role)
 AND (p.db IS NULL OR p.db IN ('*', q.database_name)) AND (p.sch IS NULL OR p.sch IN ('*', 'public'))
 AND (p.tbl IS NULL OR p.tbl IN ('*', q.tbl)) AND (len(p.ops) = 0 OR list_contains(p.ops, q.statement_type))
 AND (p.from_us IS NULL OR q.ts_us >= p.from_us) AND (p.until_us IS NULL OR q.ts_us <= p.until_us)"""
_RANKED = "ORDER BY p.spec DESC, p.priority DESC, CASE WHEN p.action = 'BLOCK' THEN 0 ELSE 1 END, p.ord"

_SQL = {
    "policies": _values(POLICIES_V1),
    "policies_next": _values(POLICIES_V2),
    "requests": """SELECT audit_id, ts_us, user_name, role, database_name, statement_type,
  unnest(string_split(table_list, ',')) AS tbl, generate_subscripts(string_split(table_list, ','), 1) - 1 AS pos
  FROM {audit} WHERE table_list <> ''""",
    "column_requests": """SELECT audit_id, ts_us, user_name, role, database_name, statement_type, table_name AS tbl,
  CASE table_name WHEN 'customer' THEN CASE WHEN k % 2 = 0 THEN 'c_name' ELSE 'c_acctbal' END
    WHEN 'orders' THEN 'o_totalprice' WHEN 'supplier' THEN 's_name' ELSE 'other' END AS col
  FROM {audit} WHERE statement_type = 'SELECT'""",
    "winners": f"""SELECT q.audit_id, q.pos, p.name, p.action, p.spec, row_number() OVER (PARTITION BY q.audit_id, q.pos {_RANKED}) AS rn
  FROM {{requests}} q JOIN {{policies}} p ON len(p.cols) = 0 AND NOT p.shadow AND {_MATCH}""",
    "shadows": f"""SELECT q.audit_id, q.pos, p.name, p.action, row_number() OVER (PARTITION BY q.audit_id, q.pos {_RANKED}) AS rn
  FROM {{requests}} q JOIN {{policies}} p ON len(p.cols) = 0 AND p.shadow AND {_MATCH}""",
    "winners_next": f"""SELECT q.audit_id, q.pos, p.name, p.action, row_number() OVER (PARTITION BY q.audit_id, q.pos {_RANKED}) AS rn
  FROM {{requests}} q JOIN {{policies_next}} p ON len(p.cols) = 0 AND NOT p.shadow AND {_MATCH}""",
    "decided_next": """SELECT r.audit_id, count(*) AS n, min(r.pos) FILTER (WHERE coalesce(w.action, 'BLOCK') = 'BLOCK') AS first_block,
    max(coalesce(w.name, 'default_deny')) FILTER (WHERE r.pos = 0) AS name0,
    max(coalesce(w.name, 'default_deny')) FILTER (WHERE r.pos = 1) AS name1
  FROM {requests} r LEFT JOIN {winners_next} w ON r.audit_id = w.audit_id AND r.pos = w.pos AND w.rn = 1 GROUP BY r.audit_id""",
    "replayed": """SELECT a.audit_id, a.decision, CASE WHEN d.first_block IS NOT NULL THEN 'BLOCK' ELSE 'ALLOW' END AS new_decision,
    CASE WHEN d.n IS NULL THEN 'utility_statement' WHEN d.first_block = 0 THEN d.name0 WHEN d.first_block = 1 THEN d.name1
      WHEN d.n = 1 THEN d.name0 ELSE 'multi_table_allow' END AS new_policy
  FROM {audit} a LEFT JOIN {decided_next} d ON a.audit_id = d.audit_id""",
}


def policies(spark: SparkSession) -> DataFrame:
    return load_policies(spark, POLICIES_V1)


def log_for_policy(spark: SparkSession, d: str) -> DataFrame:
    tables = F.when(F.col("table_list") == "", F.array().cast("array<string>")).otherwise(F.split("table_list", ","))
    return spread(view(spark, d, "audit")).withColumn("roles", F.array("role")).withColumn("tables", tables)


NAMES = {"user": "user_name", "database": "database_name"}


@query("table_policy_eval", """SELECT r.audit_id, cast(r.pos AS int) AS pos, r.tbl AS table_name, coalesce(w.action, 'BLOCK') AS decision,
 coalesce(w.name, 'default_deny') AS matched_policy, coalesce(w.spec, 0) AS rule_specificity,
 coalesce(s.action = 'BLOCK', false) AS shadow_blocked, s.name AS shadow_policy
 FROM {requests} r LEFT JOIN {winners} w ON r.audit_id = w.audit_id AND r.pos = w.pos AND w.rn = 1
 LEFT JOIN {shadows} s ON r.audit_id = s.audit_id AND r.pos = s.pos AND s.rn = 1""", _SQL)
def table_policy_eval(spark, d):
    requests = log_for_policy(spark, d).select("*", F.posexplode("tables").alias("pos", "tbl"))
    out = policy.evaluate_tables(requests, policies(spark), ["audit_id", "pos"], {**NAMES, "table": "tbl"})
    return out.select("audit_id", "pos", F.col("tbl").alias("table_name"), "decision", "matched_policy",
                      "rule_specificity", "shadow_blocked", "shadow_policy")


# A policy per customer: of a user or a role, some for one database, table or kind of statement, some for five days, some in shadow.
_CUSTOMER_POLICIES = {"customer_policies": """SELECT *, CASE WHEN db IS NULL THEN 0 ELSE 1 END + CASE WHEN tbl IS NULL THEN 0 ELSE 4 END AS spec FROM (
 SELECT concat('c', c_custkey::VARCHAR) AS name, c_nationkey % 5 AS priority, CASE WHEN c_custkey % 2 = 0 THEN 'ALLOW' ELSE 'BLOCK' END AS action,
  CASE WHEN c_nationkey % 5 = 0 THEN []::VARCHAR[] ELSE [concat('u', c_custkey::VARCHAR)] END AS users,
  CASE WHEN c_nationkey % 5 = 0 THEN [CASE c_custkey % 4 WHEN 0 THEN 'analyst' WHEN 1 THEN 'developer' WHEN 2 THEN 'auditor' ELSE 'admin' END] ELSE []::VARCHAR[] END AS roles,
  CASE WHEN c_nationkey % 7 = 3 THEN ['admin'] ELSE []::VARCHAR[] END AS excl, CASE c_nationkey % 3 WHEN 0 THEN 'testdb' WHEN 1 THEN 'salesdb' END AS db, NULL::VARCHAR AS sch,
  CASE c_nationkey % 4 WHEN 0 THEN 'customer' WHEN 1 THEN 'orders' WHEN 2 THEN 'lineitem' END AS tbl, CASE WHEN c_nationkey % 6 = 5 THEN ['SELECT'] ELSE []::VARCHAR[] END AS ops,
  CASE WHEN c_nationkey % 6 = 1 THEN 1704067200000000 + 86400000000 * (c_custkey % 20) END AS from_us,
  CASE WHEN c_nationkey % 6 = 1 THEN 1704067200000000 + 86400000000 * (c_custkey % 20 + 5) END AS until_us, c_custkey % 11 = 0 AS shadow, c_custkey AS ord FROM customer) c"""}


def customer_policies(spark: SparkSession, d: str) -> DataFrame:
    text = lambda c: F.concat(F.lit(c), F.col("c_custkey").cast("string"))
    none, key, nation = F.array().cast("array<string>"), F.col("c_custkey"), F.col("c_nationkey")
    role = F.when(key % 4 == 0, "analyst").when(key % 4 == 1, "developer").when(key % 4 == 2, "auditor").otherwise("admin")
    day = lambda n: F.when(nation % 6 == 1, F.timestamp_micros(F.lit(1704067200000000) + 86400000000 * (key % 20 + n)))
    fields = {
        "name": text("c"), "priority": nation % 5, "action": F.when(key % 2 == 0, "ALLOW").otherwise("BLOCK"),
        "users": F.when(nation % 5 == 0, none).otherwise(F.array(text("u"))), "roles": F.when(nation % 5 == 0, F.array(role)).otherwise(none),
        "exclude_roles": F.when(nation % 7 == 3, F.array(F.lit("admin"))), "database": F.when(nation % 3 == 0, "testdb").when(nation % 3 == 1, "salesdb"),
        "table": F.when(nation % 4 == 0, "customer").when(nation % 4 == 1, "orders").when(nation % 4 == 2, "lineitem"),
        "statement_types": F.when(nation % 6 == 5, F.array(F.lit("SELECT"))), "valid_from": day(0), "valid_until": day(5), "shadow": key % 11 == 0, "load_order": key}
    raw = table(spark, d, "customer").select(*[fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RAW.fields])
    return load_policies(spark, raw)


@query("customer_policy_eval", f"""WITH met AS (SELECT q.audit_id, q.pos, p.* FROM {{requests}} q JOIN {{customer_policies}} p ON {_MATCH}),
 w AS (SELECT *, row_number() OVER (PARTITION BY audit_id, pos {_RANKED.replace('p.', '')}) AS rn FROM met WHERE NOT shadow),
 s AS (SELECT *, row_number() OVER (PARTITION BY audit_id, pos {_RANKED.replace('p.', '')}) AS rn FROM met WHERE shadow)
SELECT r.audit_id, cast(r.pos AS int) AS pos, coalesce(w.action, 'BLOCK') AS decision, coalesce(w.name, 'default_deny') AS matched_policy, coalesce(s.action = 'BLOCK', false) AS shadow_blocked,
 s.name AS shadow_policy FROM {{requests}} r LEFT JOIN w ON r.audit_id = w.audit_id AND r.pos = w.pos AND w.rn = 1 LEFT JOIN s ON r.audit_id = s.audit_id AND r.pos = s.pos AND s.rn = 1""",
       {**_SQL, **_CUSTOMER_POLICIES})
def customer_policy_eval(spark, d):
    requests = log_for_policy(spark, d).select("*", F.posexplode("tables").alias("pos", "tbl"))
    out = policy.evaluate_tables(requests, customer_policies(spark, d), ["audit_id", "pos"], {**NAMES, "table": "tbl"})
    return out.select("audit_id", "pos", "decision", "matched_policy", "shadow_blocked", "shadow_policy")


@query("column_policy_eval", f"""SELECT q.audit_id, q.tbl AS table_name, q.col AS column_name,
 coalesce(w.action, 'ALLOW') AS decision, coalesce(w.name, 'default_allow') AS matched_policy,
 CASE WHEN coalesce(w.action, 'ALLOW') = 'ALLOW' THEN coalesce(w.mask, 'NONE') ELSE 'NONE' END AS masking_action
 FROM {{column_requests}} q LEFT JOIN (SELECT q.audit_id, p.*, row_number() OVER (PARTITION BY q.audit_id {_RANKED}) AS rn
   FROM {{column_requests}} q JOIN {{policies}} p ON len(p.cols) > 0 AND NOT p.shadow
   AND (list_contains(p.cols, q.col) OR list_contains(p.cols, '*')) AND {_MATCH}) w ON q.audit_id = w.audit_id AND w.rn = 1""", _SQL)
def column_policy_eval(spark, d):
    col = (F.when(F.col("table_name") == "customer", F.when(F.col("k") % 2 == 0, "c_name").otherwise("c_acctbal"))
           .when(F.col("table_name") == "orders", "o_totalprice").when(F.col("table_name") == "supplier", "s_name").otherwise("other"))
    requests = log_for_policy(spark, d).filter(F.col("statement_type") == "SELECT").withColumn("column_name", col)
    out = policy.evaluate_columns(requests, policies(spark), ["audit_id"], {**NAMES, "table": "table_name", "column": "column_name"})
    return out.select("audit_id", "table_name", "column_name", "decision", "matched_policy", "masking_action")


def _replayed(spark, d):
    log = log_for_policy(spark, d).select("audit_id", "ts_us", "user_name", "roles", "database_name", "statement_type", "tables", "decision")
    return policy.replay(log, load_policies(spark, POLICIES_V2), "audit_id", NAMES)


_CHANGE = "CASE WHEN new_decision = decision THEN 'unchanged' WHEN new_decision = 'BLOCK' THEN 'newly_blocked' ELSE 'newly_allowed' END"


@query("policy_replay", f"""SELECT count(*) AS total, count(*) FILTER (WHERE new_decision <> decision) AS changed,
 count(*) FILTER (WHERE {_CHANGE} = 'newly_blocked') AS newly_blocked, count(*) FILTER (WHERE {_CHANGE} = 'newly_allowed') AS newly_allowed,
 count(*) FILTER (WHERE {_CHANGE} = 'unchanged') AS unchanged FROM {{replayed}}""", _SQL)
def policy_replay(spark, d):
    return policy.replay_summary(_replayed(spark, d))


@query("policy_replay_diffs", f"""SELECT audit_id, decision, new_decision, new_policy, {_CHANGE} AS change
 FROM {{replayed}} WHERE new_decision <> decision ORDER BY audit_id LIMIT 100""", _SQL)
def policy_replay_diffs(spark, d):
    return policy.replay_diffs(_replayed(spark, d), ["audit_id"]).select("audit_id", "decision", "new_decision", "new_policy", "change")


# Policy records kept as a table: one per customer, some of them malformed.
_RAW = {
    "raw_policies": """SELECT c_custkey AS id, CASE WHEN c_custkey % 17 = 0 THEN '' ELSE concat('p-', c_name) END AS name,
 cast(CASE WHEN c_custkey % 13 = 0 THEN -1 ELSE c_nationkey END AS int) AS priority,
 CASE c_custkey % 5 WHEN 0 THEN 'allow' WHEN 1 THEN 'ALLOW' WHEN 2 THEN 'block' WHEN 3 THEN NULL ELSE CASE WHEN c_custkey % 7 = 0 THEN 'PERMIT' ELSE 'BLOCK' END END AS action,
 CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat('u', cast(c_custkey AS string)) END AS users,
 CASE WHEN c_custkey % 11 = 0 THEN '' ELSE lower(c_mktsegment) END AS roles,
 CASE WHEN c_custkey % 2 = 0 THEN 'orders' ELSE '' END AS tbl,
 CASE WHEN c_custkey % 19 = 0 THEN 'select,frobnicate' WHEN c_custkey % 4 = 0 THEN 'select,insert' ELSE '' END AS ops
 FROM {customer}""",
}


def raw_policies(spark: SparkSession, d: str) -> DataFrame:
    from govspark.plans.fixtures import derive
    items = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, ","))
    raw = derive(spark, d, _RAW["raw_policies"])
    given = {"name": F.col("name"), "priority": F.col("priority"), "action": F.col("action"), "users": items("users"),
             "roles": items("roles"), "table": F.col("tbl"), "statement_types": items("ops"), "load_order": F.col("id").cast("int")}
    return raw.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RAW.fields])


@query("load_policies", """SELECT name, priority, upper(coalesce(action, 'BLOCK')) AS action, users, roles, nullif(tbl, '') AS "table",
 upper(ops) AS operations, 3 AS mask_prefix FROM {raw_policies} WHERE name <> '' AND upper(coalesce(action, 'BLOCK')) IN ('ALLOW', 'BLOCK')
 AND ops NOT LIKE '%frobnicate%' AND priority >= 0 AND NOT (users = '' AND roles = '')""", _RAW)
def load_policy_table(spark, d):
    joined = lambda c: F.array_join(c, ",").alias(c)
    return load_policies(spark, raw_policies(spark, d)).select(
        "name", "priority", "action", joined("users"), joined("roles"), "table", joined("operations"), "mask_prefix")


@query("rejected_policies", """SELECT cast(id AS int) AS load_order, CASE WHEN name = '' THEN 'Policy must have a name'
 WHEN upper(coalesce(action, 'BLOCK')) NOT IN ('ALLOW', 'BLOCK') THEN 'Invalid action' WHEN ops LIKE '%frobnicate%' THEN 'Invalid statement type'
 WHEN priority < 0 THEN 'Policy priority must be non-negative' ELSE 'Policy must specify at least one user or role' END AS error
 FROM {raw_policies} WHERE name = '' OR upper(coalesce(action, 'BLOCK')) NOT IN ('ALLOW', 'BLOCK') OR ops LIKE '%frobnicate%'
 OR priority < 0 OR (users = '' AND roles = '')""", _RAW)
def rejected_policies(spark, d):
    return raw_policies(spark, d).withColumn("error", policy_error()).filter(F.col("error").isNotNull()).select("load_order", "error")


@query("policy_diff", """SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN 'added' WHEN b.name IS NULL THEN 'removed'
 WHEN a.pr = b.pr THEN 'unchanged' ELSE 'changed' END AS status
 FROM (SELECT concat('p-', c_name) AS name, c_nationkey AS pr FROM customer WHERE c_nationkey < 20) a
 FULL JOIN (SELECT concat('p-', c_name) AS name, CASE WHEN c_mktsegment = 'BUILDING' THEN 99 ELSE c_nationkey END AS pr FROM customer WHERE c_nationkey > 4) b
 ON a.name = b.name""")
def policy_diff(spark, d):
    c = table(spark, d, "customer")
    raw = lambda df, prio: load_policies(spark, df.select(*[
        {"name": F.concat(F.lit("p-"), "c_name"), "priority": prio, "users": F.array("c_name")}.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
        for f in RAW.fields]))
    old = raw(c.filter("c_nationkey < 20"), F.col("c_nationkey"))
    new = raw(c.filter("c_nationkey > 4"), F.when(F.col("c_mktsegment") == "BUILDING", 99).otherwise(F.col("c_nationkey")))
    return policy.policy_diff(old, new)


@query("dead_policies", """SELECT r.rule AS name FROM (SELECT DISTINCT concat('rule-', cast(c_nationkey AS string)) AS rule FROM customer) r
 WHERE r.rule NOT IN (SELECT matched_policy FROM {audit})""")
def dead_policies(spark, d):
    rules = table(spark, d, "customer").select(F.concat(F.lit("rule-"), F.col("c_nationkey").cast("string")).alias("name")).distinct()
    return policy.dead_policies(rules, view(spark, d, "audit"))


_GRANTED = """SELECT audit_id, user_name, concat('access_grant_', cast(id AS string)) AS grant_policy FROM (
 SELECT a.audit_id, a.user_name, g.id, row_number() OVER (PARTITION BY a.audit_id ORDER BY g.until_us DESC, g.id DESC) AS rn
 FROM {audit} a JOIN (SELECT request_id AS id, user_name, database_name, table_name, decided_us AS from_us,
   decided_us + (CASE WHEN requested_hours <= 0 THEN 24 ELSE least(requested_hours, 168) END) * 3600000000 AS until_us
   FROM {access_requests} WHERE status = 'APPROVED') g
 ON a.user_name = g.user_name AND a.database_name = g.database_name AND a.table_name = g.table_name AND a.ts_us BETWEEN g.from_us AND g.until_us) x WHERE rn = 1"""


def _granted(spark, d, **kw):
    from govspark.operators.snapshots import grants
    covered = policy.grant_coverage(view(spark, d, "audit"), grants(view(spark, d, "access_requests")),
                                    {"user": "user_name", "database": "database_name", "table": "table_name"}, **kw)
    return covered.select("audit_id", "user_name", "grant_policy")


@query("grants_effective", _GRANTED)
def grants_effective(spark, d):
    return _granted(spark, d)


@query("grants_in_time", _GRANTED)
def grants_in_time(spark, d):
    """The same by the form for any number of grants."""
    return _granted(spark, d, broadcast_rows=0)


# --- rows, columns, masks -------------------------------------------------------------------------

ANA = Principal("ana", ("analyst",), {"seg": "FURNITURE", "floor": "0"}, "testdb")
SEGMENT_RULE = RowRule("c_mktsegment = '$ATTR.seg'", table="customer", roles=("analyst",))

FLAGSHIP = """SELECT c.c_nationkey, c.c_name, count(*) AS orders, cast(sum(cast(o.o_totalprice AS decimal(18,2))) AS double) AS revenue
 FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_nationkey, c.c_name"""


def flagship(spark: SparkSession, d: str) -> governance.Governed:
    reader = lambda t: (lambda s: s.read.parquet(f"{d}/{t}.parquet"))
    rules = [p for p in POLICIES_V1 if p["name"] not in ("price_tie_block", "price_tie_allow")]
    return governance.governed_query(
        spark, f"{FLAGSHIP} ORDER BY revenue DESC, c_nationkey, c_name", ANA, load_policies(spark, rules),
        {"customer": reader("customer"), "orders": reader("orders")}, AS_OF, rules=[SEGMENT_RULE], limits=[LimitRule(1000)])


@query("governed_query", """SELECT c_nationkey, CASE WHEN length(c_name) <= 5 THEN '***REDACTED***' ELSE concat(left(c_name, 3), '***', right(c_name, 2)) END AS c_name,
 count(*) AS orders, cast(sum(cast(o_totalprice AS decimal(18,2))) AS double) AS revenue
 FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'FURNITURE' GROUP BY 1, 2 ORDER BY revenue DESC, 1, 2 LIMIT 1000""")
def governed(spark, d):
    return flagship(spark, d).df


@query("column_acl", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def column_acl(spark, d):
    c = table(spark, d, "customer")
    decisions = governance.column_decisions(spark, ANA, "customer", c.columns, policies(spark), "SELECT", AS_OF)
    return governance.column_acl(c, decisions)


@query("mask_redact", "SELECT c_custkey, CASE WHEN misc IS NOT NULL THEN '***REDACTED***' END AS misc FROM {people}")
def mask_redact(spark, d):
    return view(spark, d, "people").select("c_custkey", masking.mask_redact(F.col("misc")).alias("misc"))


@query("mask_partial", """SELECT c_custkey, CASE WHEN length(c_mktsegment) <= 8 THEN '***REDACTED***' ELSE concat(left(c_mktsegment, 5), '***', right(c_mktsegment, 3)) END AS seg,
 CASE WHEN length(misc) <= 6 THEN '***REDACTED***' WHEN misc IS NOT NULL THEN concat(left(misc, 3), '***', right(misc, 3)) END AS misc FROM {people}""")
def mask_partial(spark, d):
    return view(spark, d, "people").select("c_custkey", masking.mask_partial(F.col("c_mktsegment"), 5, 3).alias("seg"),
                                           masking.mask_partial(F.col("misc")).alias("misc"))


@query("mask_hash", "SELECT c_custkey, left(sha256(c_name), 16) AS c_name, left(sha256(misc), 16) AS misc FROM {people}")
def mask_hash(spark, d):
    return view(spark, d, "people").select("c_custkey", masking.mask_hash(F.col("c_name")).alias("c_name"), masking.mask_hash(F.col("misc")).alias("misc"))


@query("mask_nullify", "SELECT c_custkey, cast(NULL AS varchar) AS c_name FROM customer")
def mask_nullify(spark, d):
    return table(spark, d, "customer").select("c_custkey", masking.mask_nullify(F.col("c_name")).alias("c_name"))


@query("apply_masking", """SELECT c_custkey, concat(left(c_name, 3), '***', right(c_name, 2)) AS c_name, left(sha256(contact), 16) AS contact,
 '***REDACTED***' AS phone, cast(NULL AS varchar) AS code_a, code_b FROM {people}""")
def apply_masking(spark, d):
    people = view(spark, d, "people").select("c_custkey", "c_name", "contact", "phone", "code_a", "code_b")
    rules = [ColumnDecision("c_name", masking_action="PARTIAL", prefix=3, suffix=2), ColumnDecision("contact", masking_action="HASH"),
             ColumnDecision("phone", masking_action="REDACT"), ColumnDecision("code_a", masking_action="NULLIFY"),
             ColumnDecision("code_b", "BLOCK", masking_action="HASH")]
    return governance.apply_masking(people, {r.column: r for r in rules})[0]


@query("rls_filter", """SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE (c_mktsegment = 'FURNITURE')
 AND (c_acctbal > 0) AND ('analyst' IN ('analyst', 'staff')) AND ('user ana' <> c_name OR missing = 'missing') """.replace(
    "OR missing = 'missing'", "OR 'missing' = 'missing'"))
def rls_filter(spark, d):
    who = Principal("ana", ("analyst", "staff"), {"seg": "FURNITURE", "floor": "0"}, "testdb")
    rules = [SEGMENT_RULE, RowRule("c_acctbal > cast($ATTR.floor AS double)", users=("ana",)), RowRule("'analyst' IN ($ROLES)"),
             RowRule("'user $USER' <> c_name OR '$ATTR.missing' = 'missing'"), RowRule("1 = 0", database="salesdb"),
             RowRule("1 = 0", table="orders"), RowRule("1 = 0", roles=("admin",))]
    return governance.rls_filter(table(spark, d, "customer"), rules, who, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")


@query("enforce_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000")
def enforce_limit(spark, d):
    return governance.enforce_limit(table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey"), 1000)


@query("default_limit", """SELECT 'plain' AS kind, count(*) AS n FROM (SELECT * FROM lineitem LIMIT 1000) UNION ALL
 SELECT 'aggregate', count(*) FROM (SELECT l_partkey, count(*) FROM lineitem GROUP BY l_partkey) UNION ALL
 SELECT 'limited', count(*) FROM (SELECT * FROM lineitem LIMIT 5)""")
def default_limit(spark, d):
    li = table(spark, d, "lineitem")
    n = lambda df, kind: governance.default_limit(df).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return n(li, "plain").unionByName(n(li.groupBy("l_partkey").count(), "aggregate")).unionByName(n(li.limit(5), "limited"))


@query("max_rows_guard", "SELECT o_orderpriority, count(*) AS orders FROM orders GROUP BY o_orderpriority")
def max_rows_guard(spark, d):
    return governance.max_rows_guard(table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("orders")))


# --- encryption -----------------------------------------------------------------------------------

def keys(spark: SparkSession, active: str) -> DataFrame:
    """Demonstration keys; a deployment reads its key table from protected storage."""
    rows = [(k, bytes([i + 1]) * 32, k == active) for i, k in enumerate(("k1", "k2"))]
    return local_frame(spark, rows, "key_id string, key binary, active boolean")


@query("column_encrypt", """SELECT c_custkey, 'ENC:v1:k2:' AS prefix, cast(10 + 4 * ceil((28 + length(contact)) / 3.0) AS bigint) AS length,
 true AS hidden FROM {people}""")
def column_encrypt(spark, d):
    people = view(spark, d, "people").select("c_custkey", "contact").withColumn("plain", F.col("contact"))
    e = crypto.encrypt_columns(people, ["contact"], keys(spark, "k2"))
    return e.select("c_custkey", F.substring("contact", 1, 10).alias("prefix"), F.length("contact").cast("bigint").alias("length"),
                    (~F.contains(F.col("contact"), F.col("plain"))).alias("hidden"))


@query("column_decrypt", """SELECT c_custkey, contact, misc, CASE WHEN misc IS NULL THEN NULL ELSE concat('ENC:v1:k9:', misc) END AS bad FROM {people}""")
def column_decrypt(spark, d):
    people = view(spark, d, "people").select("c_custkey", "contact", "misc").withColumn("bad", F.concat(F.lit("ENC:v1:k9:"), "misc"))
    e = crypto.encrypt_columns(people, ["contact", "misc"], keys(spark, "k1"))
    return crypto.decrypt_columns(e, ["contact", "misc", "bad"], keys(spark, "k2"))


@query("rotate_keys", """SELECT c_custkey, 'k2' AS key_id, c_mktsegment <> 'BUILDING' AS rewritten, contact FROM {people}""")
def rotate_keys(spark, d):
    people = view(spark, d, "people").select("c_custkey", "contact", "c_mktsegment")
    stale = crypto.encrypt_columns(people.filter("c_mktsegment <> 'BUILDING'"), ["contact"], keys(spark, "k1"))
    fresh = crypto.encrypt_columns(people.filter("c_mktsegment = 'BUILDING'"), ["contact"], keys(spark, "k2"))
    before = stale.unionByName(fresh).withColumn("old_id", F.regexp_extract("contact", "^ENC:v1:([^:]*):", 1))
    after = crypto.rotate_keys(before, ["contact"], keys(spark, "k2")).withColumn("key_id", F.regexp_extract("contact", "^ENC:v1:([^:]*):", 1))
    return crypto.decrypt_columns(after, ["contact"], keys(spark, "k2")).select(
        "c_custkey", "key_id", (F.col("old_id") != F.col("key_id")).alias("rewritten"), "contact")


@query("audit_encrypt", "SELECT audit_id, user_name, sql_text, true AS sealed FROM {audit}")
def audit_encrypt(spark, d):
    log = view(spark, d, "audit").select("audit_id", "user_name", "sql_text")
    # Written before and after a rotation, read with the keys of today.
    before, after = log.filter("audit_id % 3 <> 0"), log.filter("audit_id % 3 = 0")
    lines = crypto.encrypt_audit(before, keys(spark, "k1")).union(crypto.encrypt_audit(after, keys(spark, "k2")))
    sealed = lines.filter(F.col("line").rlike(f"^{crypto.AUDIT_PREFIX}k[12]:"))
    opened = crypto.decrypt_audit(sealed, keys(spark, "k2"), log.schema)
    return opened.select(*log.columns, F.col("_unopened").isNull().alias("sealed"))


# --- structured requests --------------------------------------------------------------------------

@query("spec_select", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 50 OFFSET 10")
def spec_select(spark, d):
    return governance.spec_select(table(spark, d, "orders"), {
        "fields": ["o_orderkey", "o_totalprice"], "where": {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"},
        "order_by": ["o_totalprice", "o_orderkey"], "desc": True, "limit": 50, "offset": 10})


@query("spec_mutate", """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'renamed' ELSE c_name END AS c_name, c_nationkey, c_mktsegment
 FROM customer WHERE c_nationkey <> 7 UNION ALL SELECT -1, 'new', 3, NULL""")
def spec_mutate(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    updated, _ = governance.spec_mutate(c, {"op": "update", "where": {"c_mktsegment": "BUILDING"}, "values": {"c_name": "renamed"}})
    kept, _ = governance.spec_mutate(updated, {"op": "delete", "where": {"c_nationkey": 7}})
    version, _ = governance.spec_mutate(kept, {"op": "insert", "values": {"c_custkey": -1, "c_name": "new", "c_nationkey": 3}})
    return version


# --- admission from the log -----------------------------------------------------------------------

@query("ip_allowlist", """SELECT audit_id, CASE tenant_id WHEN 't0' THEN true
 WHEN 't1' THEN split_part(source_ip, '.', 2) = '0' WHEN 't2' THEN split_part(source_ip, '.', 2) = '1' AND split_part(source_ip, '.', 3) = '3' AND cast(split_part(source_ip, '.', 4) AS int) < 128
 WHEN 't3' THEN source_ip = '10.2.4.9' ELSE false END AS ip_allowed FROM {audit}""")
def ip_allowlist(spark, d):
    entries = local_frame(spark, [("t1", "10.0.0.0/16"), ("t2", "10.1.3.77/25"), ("t3", "10.2.4.9"), ("t3", "bogus/99"),
                                     ("t4", "300.1.1.1"), ("t4", "192.168.0.0/16")], "tenant_id string, cidr string")
    return logs.ip_allowlist(view(spark, d, "audit"), entries, "tenant_id").select("audit_id", "ip_allowed")


@query("ip_allowlist_ranges", """SELECT a.audit_id, bool_or(a.ip BETWEEN e.base AND e.base + e.width - 1) AS ip_allowed FROM (SELECT audit_id, tenant_id,
  cast(split_part(source_ip, '.', 1) AS bigint) * 16777216 + cast(split_part(source_ip, '.', 2) AS bigint) * 65536 + cast(split_part(source_ip, '.', 3) AS bigint) * 256 + cast(split_part(source_ip, '.', 4) AS bigint) AS ip FROM {audit}) a
 JOIN (SELECT tenant, width, net - net % width AS base FROM (SELECT concat('t', cast(c_custkey % 4 AS string)) AS tenant, 10 * 16777216 + c_custkey % 3 * 65536 + c_custkey % 8 * 256 + c_custkey * 7 % 256 AS net,
  cast(pow(2, c_custkey % 5) AS bigint) AS width FROM customer) c) e ON a.tenant_id = e.tenant GROUP BY a.audit_id
UNION ALL SELECT audit_id, true FROM {audit} WHERE tenant_id = 't4'""")
def ip_allowlist_ranges(spark, d):
    """An entry per customer, by the form for any number of entries; tenant t4 has none."""
    key = F.col("c_custkey")
    entries = table(spark, d, "customer").select(F.concat(F.lit("t"), (key % 4).cast("string")).alias("tenant_id"),
                                                 F.format_string("10.%d.%d.%d/%d", key % 3, key % 8, key * 7 % 256, 32 - key % 5).alias("cidr"))
    return logs.ip_allowlist(view(spark, d, "audit"), entries, "tenant_id", broadcast_rows=0).select("audit_id", "ip_allowed")


@query("residency_check", """SELECT audit_id, CASE tenant_id WHEN 't1' THEN database_name = 'testdb' WHEN 't2' THEN true WHEN 't3' THEN false ELSE true END AS residency_ok FROM {audit}""")
def residency_check(spark, d):
    tenants = local_frame(spark, [("t0", []), ("t1", ["eu"]), ("t2", ["eu", "us"]), ("t3", ["asia"])], "tenant_id string, allowed_regions array<string>")
    databases = local_frame(spark, [("testdb", "eu"), ("salesdb", "us")], "database_name string, region string")
    return logs.residency_check(view(spark, d, "audit"), tenants, databases).select("audit_id", "residency_ok")


@query("audit_sample", """SELECT audit_id, fingerprint_hash FROM {audit} WHERE decision = 'BLOCK' OR error_code <> 'NONE'
 OR statement_type IN ('INSERT', 'UPDATE') OR fingerprint_hash % 10000 < 40""")
def audit_sample(spark, d):
    return logs.audit_sample(view(spark, d, "audit"), 0.004, 1.0).select("audit_id", "fingerprint_hash")


@query("classify_error", """SELECT audit_id, CASE WHEN regexp_matches(lower(error_message), 'connection refused|could not connect|timeout') THEN 'INFRASTRUCTURE'
 WHEN regexp_matches(lower(error_message), 'deadlock|serialization failure') THEN 'TRANSIENT' ELSE 'APPLICATION' END AS failure FROM {audit} WHERE error_code <> 'NONE'""")
def classify_error(spark, d):
    return view(spark, d, "audit").filter("error_code <> 'NONE'").select("audit_id", reliability.error_class(F.col("error_message")).alias("failure"))
