"""Policy evaluation against a plain reading of the rules, inline and relational."""

import random

import pytest

from govspark.operators import policy
from govspark.runtime import local_frame
from govspark.sources.policies import load_policies

REQUEST = "id int, user string, roles array<string>, database string, schema string, table string, statement_type string, ts_us long"


def spec(p):
    return bool(p.get("database")) + 2 * bool(p.get("schema")) + 4 * bool(p.get("table")) + 8 * bool(p.get("columns"))


def covers(p, q):
    users, roles = p.get("users", []), p.get("roles", [])
    scope = all(p.get(f) in (None, "*", q[f]) for f in ("database", "schema", "table"))
    return ((not users or "*" in users or q["user"] in users) and (not roles or set(roles) & set(q["roles"]))
            and not set(p.get("exclude_roles", [])) & set(q["roles"]) and scope
            and (not p.get("statement_types") or q["statement_type"] in p["statement_types"]))


def decide(policies, q):
    hits = [(i, p) for i, p in enumerate(policies) if not p.get("columns") and not p.get("shadow") and covers(p, q)]
    if not hits:
        return "BLOCK", "default_deny"
    i, p = max(hits, key=lambda h: (spec(h[1]), h[1]["priority"], h[1]["action"] == "BLOCK", -h[0]))
    return p["action"], p["name"]


def some_policies(rnd, n):
    pick = lambda xs, k=2: rnd.sample(xs, rnd.randint(0, k))
    out = []
    for i in range(n):
        p = {"name": f"p{i}", "priority": rnd.randint(0, 2), "action": rnd.choice(["ALLOW", "BLOCK"]), "users": pick(["u1", "u2", "*"]),
             "roles": pick(["r1", "r2", "r3"]), "exclude_roles": pick(["r2", "r3"], 1), "statement_types": pick(["SELECT", "INSERT"], 1),
             "shadow": rnd.random() < 0.1, "columns": ["c"] if rnd.random() < 0.1 else []}
        for f, values in (("database", ["d1", "d2", "*"]), ("schema", ["public", "s2"]), ("table", ["t1", "t2", "*"])):
            if rnd.random() < 0.4:
                p[f] = rnd.choice(values)
        if not p["users"] and not p["roles"]:
            p["users"] = ["u1"]
        out.append(p)
    return out


@pytest.mark.parametrize("inline", [256, 0])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_policies(spark, monkeypatch, seed, inline):
    monkeypatch.setattr(policy, "MAX_INLINE_POLICIES", inline)
    rnd = random.Random(seed)
    policies = some_policies(rnd, 25)
    queries = [{"user": rnd.choice(["u1", "u2", "u3"]), "roles": rnd.sample(["r1", "r2", "r3"], rnd.randint(0, 2)), "database": rnd.choice(["d1", "d2", "d3"]),
                "schema": rnd.choice(["public", "s2"]), "table": rnd.choice(["t1", "t2", "t3"]), "statement_type": rnd.choice(["SELECT", "INSERT"])} for _ in range(80)]
    req = local_frame(spark, [(i, q["user"], q["roles"], q["database"], q["schema"], q["table"], q["statement_type"], 0) for i, q in enumerate(queries)], REQUEST)
    got = {r.id: (r.decision, r.matched_policy) for r in policy.evaluate_tables(req, load_policies(spark, policies), ["id"]).collect()}
    assert got == {i: decide(policies, q) for i, q in enumerate(queries)}


@pytest.mark.parametrize("inline", [256, 0])
def test_query_decisions(spark, monkeypatch, inline):
    monkeypatch.setattr(policy, "MAX_INLINE_POLICIES", inline)
    policies = load_policies(spark, [{"name": "a", "action": "ALLOW", "users": ["*"]}, {"name": "no_t2", "action": "BLOCK", "users": ["*"], "table": "t2"},
                                     {"name": "no_t3", "action": "BLOCK", "users": ["*"], "table": "t3"}])
    log = local_frame(spark, [(1, "u", ["r"], []), (2, "u", ["r"], ["t1"]), (3, "u", ["r"], ["t1", "t4"]), (4, "u", ["r"], ["t1", "t3", "t2"]), (5, "u", ["r"], None)],
                      "audit_id long, user string, roles array<string>, tables array<string>").selectExpr("*", "'d' AS database", "'SELECT' AS statement_type", "0L AS ts_us", "'ALLOW' AS decision")
    got = {r.audit_id: (r.new_decision, r.new_policy) for r in policy.decide_queries(log, policies).collect()}
    assert got == {1: ("ALLOW", "utility_statement"), 2: ("ALLOW", "a"), 3: ("ALLOW", "multi_table_allow"), 4: ("BLOCK", "no_t3"), 5: ("ALLOW", "utility_statement")}
    assert policy.replay_summary(policy.replay(log, policies)).first().asDict() == {"total": 5, "changed": 1, "newly_blocked": 1, "newly_allowed": 0, "unchanged": 4}


def test_simulated_policies(spark):
    got = load_policies(spark, [{"action": "deny"}, {"name": "x", "action": "allow", "users": ["u"]}], simulate=True).orderBy("load_order").collect()
    assert [(r.name, r.action, r.users) for r in got] == [("sim-policy-0", "BLOCK", ["*"]), ("x", "ALLOW", ["u"])]


def test_policy_files(spark, tmp_path):
    (tmp_path / "p.toml").write_text('[[policies]]\nname = "a"\naction = "allow"\nroles = ["r"]\nmasking_action = "partial"\n[[policies]]\nname = "b"\n')
    (tmp_path / "p.json").write_text('{"policies": [{"name": "j", "action": "BLOCK", "users": ["*"], "priority": 3}]}')
    t = load_policies(spark, str(tmp_path / "p.toml")).collect()
    assert [(r.name, r.masking_action, r.mask_prefix) for r in t] == [("a", "PARTIAL", 3)]
    assert load_policies(spark, str(tmp_path / "p.json")).first().priority == 3


def timed_policies(rnd, n):
    """As ``some_policies``, with validity intervals, more shadow ones and lists of columns."""
    out = some_policies(rnd, n)
    for p in out:
        p["columns"] = rnd.sample(["c1", "c2", "*"], rnd.randint(0, 2))
        p["shadow"] = rnd.random() < 0.3
        p["masking_action"] = rnd.choice(["none", "hash"])
        if rnd.random() < 0.5:
            a, b = sorted(rnd.sample(range(10), 2))
            p["valid_from"], p["valid_until"] = rnd.choice([(a, b), (a, None), (None, b)])
    return out


def winner(policies, q, shadow, column):
    timely = lambda p: (p.get("valid_from") is None or p["valid_from"] <= q["ts_us"]) and (p.get("valid_until") is None or q["ts_us"] <= p["valid_until"])
    named = lambda p: bool(p["columns"]) == (column is not None) and (column is None or "*" in p["columns"] or column in p["columns"])
    hits = [(i, p) for i, p in enumerate(policies) if p["shadow"] == shadow and named(p) and timely(p) and covers(p, q)]
    return max(hits, key=lambda h: (spec(h[1]), h[1]["priority"], h[1]["action"] == "BLOCK", -h[0]))[1] if hits else None


@pytest.mark.parametrize("inline", [256, 0])
@pytest.mark.parametrize("seed", [4, 5])
def test_times_shadows_and_columns(spark, monkeypatch, seed, inline):
    """Both forms against a plain reading of the rules; many rows share a request, at other times."""
    from datetime import datetime, timezone
    monkeypatch.setattr(policy, "MAX_INLINE_POLICIES", inline)
    rnd = random.Random(seed)
    policies = timed_policies(rnd, 30)
    at = lambda n: None if n is None else datetime.fromtimestamp(n, timezone.utc)
    loaded = load_policies(spark, [{**p, "valid_from": at(p.get("valid_from")), "valid_until": at(p.get("valid_until"))} for p in policies])
    queries = [{"user": rnd.choice(["u1", "u3"]), "roles": rnd.choice([[], ["r1"], ["r2", "r3"]]), "database": rnd.choice(["d1", "d3"]), "schema": "public",
                "table": rnd.choice(["t1", "t3"]), "statement_type": rnd.choice(["SELECT", "INSERT"]), "ts_us": rnd.randrange(10), "column": rnd.choice(["c1", "c3"])} for _ in range(150)]
    rows = [(i, q["user"], q["roles"], q["database"], q["schema"], q["table"], q["statement_type"], q["ts_us"] * 1_000_000, q["column"]) for i, q in enumerate(queries)]
    req = local_frame(spark, rows, REQUEST + ", column string")
    name = lambda p, default: p["name"] if p else default
    tables = {r.id: (r.matched_policy, r.shadow_policy) for r in policy.evaluate_tables(req, loaded, ["id"]).collect()}
    assert tables == {i: (name(winner(policies, q, False, None), "default_deny"), name(winner(policies, q, True, None), None)) for i, q in enumerate(queries)}
    columns = {r.id: r.matched_policy for r in policy.evaluate_columns(req, loaded, ["id"]).collect()}
    assert columns == {i: name(winner(policies, q, False, q["column"]), "default_allow") for i, q in enumerate(queries)}


def test_log_decisions_do_not_depend_on_the_form(spark, monkeypatch):
    """A whole log over several tables a row, policies of no scope at all, and an empty set."""
    rnd = random.Random(9)
    rows = [(i, rnd.choice(["u1", "u2"]), rnd.choice([["r1"], ["r2", "r3"]]), "d1", "SELECT", rnd.sample(["t1", "t2", "t3"], rnd.randint(0, 3)), i, "ALLOW") for i in range(60)]
    log = local_frame(spark, rows, "audit_id long, user string, roles array<string>, database string, statement_type string, tables array<string>, ts_us long, decision string")
    everyone = [{"name": "all", "action": "ALLOW", "users": ["*"]}, {"name": "not_r2", "action": "BLOCK", "users": ["*"], "priority": 3, "exclude_roles": ["r2"]},
                {"name": "reads", "action": "ALLOW", "users": ["*"], "priority": 5, "statement_types": ["SELECT"], "exclude_roles": ["r1"]}]
    for policies in (some_policies(rnd, 20), everyone, everyone + some_policies(rnd, 5), []):
        loaded, found = load_policies(spark, policies), []
        for inline in (256, -1):
            monkeypatch.setattr(policy, "MAX_INLINE_POLICIES", inline)
            found.append(sorted((r.audit_id, r.new_decision, r.new_policy) for r in policy.decide_queries(log, loaded).collect()))
        assert found[0] == found[1] and len(found[0]) == 60


def test_requests_meet_conditions_not_policies(spark, monkeypatch):
    """Many policies with equal conditions: only the best of them is compared with requests."""
    policies = [{"name": f"p{i}", "action": "ALLOW" if i % 3 else "BLOCK", "roles": [f"r{i % 2}"], "table": ["t1", "t2"][i // 2 % 2], "priority": i * 7 % 50} for i in range(300)]
    queries = [{"user": f"u{i}", "roles": [f"r{i % 3}"], "database": "d", "schema": "public", "table": f"t{i % 2 + 1}", "statement_type": "SELECT"} for i in range(12)]
    req = local_frame(spark, [(i, q["user"], q["roles"], q["database"], q["schema"], q["table"], q["statement_type"], 0) for i, q in enumerate(queries)], REQUEST)
    stored, met = policy._stored, []

    def counted(df, purpose):
        out = stored(df, purpose)
        met.extend([out.count()] if purpose == "candidates" else [])
        return out

    monkeypatch.setattr(policy, "_stored", counted)
    got = {r.id: (r.decision, r.matched_policy) for r in policy.evaluate_tables(req, load_policies(spark, policies), ["id"]).collect()}
    assert got == {i: decide(policies, q) for i, q in enumerate(queries)}
    assert met and met[0] <= len(queries)
