"""Policy decisions over request tables, and what-if replay over an audit log.

Up to ``MAX_INLINE_POLICIES`` policies are ranked once and become one CASE expression, best policy first, so that deciding
a log is a narrow projection: no join, no shuffle. A larger set becomes an index by scope. Policies are numbered in the
order of precedence, so the best of several is the smallest number; each is listed under the users, roles, database, schema,
table and columns that it names. The log is reduced to its distinct requests without their times, and these are joined by
equality once for every combination of named fields that policies use. A request is left with its best untimed policy and
the timed ones above that, and log rows meet only these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from govspark.operators import ordered
from govspark.runtime import MAX_BROADCAST_ROWS, at_position, fits_broadcast, position, shared_dir, small_side

MAX_INLINE_POLICIES = 256
ANY = "*"


def specificity() -> Column:
    return (F.when(F.col("database").isNotNull(), 1).otherwise(0)
            + F.when(F.col("schema").isNotNull(), 2).otherwise(0)
            + F.when(F.col("table").isNotNull(), 4).otherwise(0)
            + F.when(F.size("columns") > 0, 8).otherwise(0))


def _inline(policies: DataFrame) -> list[Row] | None:
    """The policies in order of precedence, or None when there are too many to inline.

    Specificity outranks priority; of equals BLOCK wins, then the one loaded first.
    """
    rows = policies.select("*", specificity().alias("spec"), F.unix_micros("valid_from").alias("from_us"),
                           F.unix_micros("valid_until").alias("until_us")).limit(MAX_INLINE_POLICIES + 1).collect()
    if len(rows) > MAX_INLINE_POLICIES:
        return None
    return sorted(rows, key=lambda p: (-p["spec"], -p["priority"], p["action"] != "BLOCK", p["load_order"]))


def _covers(p: Row, q: dict[str, Column]) -> Column:
    """Does policy ``p`` cover request ``q``? Only the conditions it really has are emitted."""
    out = F.lit(True)
    for field, name in (("table", "table"), ("database", "database"), ("schema", "schema")):
        if p[field] is not None and p[field] != ANY:
            out = out & (q[name] == p[field])
    if p["operations"]:
        out = out & q["statement_type"].isin(list(p["operations"]))
    if p["users"] and ANY not in p["users"]:
        out = out & q["user"].isin(list(p["users"]))
    if p["roles"]:
        out = out & F.arrays_overlap(q["roles"], F.lit(list(p["roles"])))
    if p["exclude_roles"]:
        out = out & ~F.arrays_overlap(q["roles"], F.lit(list(p["exclude_roles"])))
    if p["from_us"] is not None:
        out = out & (q["ts_us"] >= p["from_us"])
    if p["until_us"] is not None:
        out = out & (q["ts_us"] <= p["until_us"])
    return out


def _first(ranked: list[Row], q: dict[str, Column], shadow: bool, column: Column | None = None) -> Column:
    """Position (from 0) of the first policy that covers the request, NULL if none does."""
    out = F
    for i, p in enumerate(ranked):
        if p["shadow"] != shadow or bool(p["columns"]) != (column is not None):
            continue
        hit = _covers(p, q)
        if column is not None and ANY not in p["columns"]:
            hit = hit & column.isin(list(p["columns"]))
        out = out.when(F.coalesce(hit, F.lit(False)), i)
    return F.lit(None).cast("int") if out is F else out.otherwise(F.lit(None)).cast("int")


def _pick(ranked: list[Row], position: Column, field: str) -> Column:
    values = [p[field] for p in ranked]
    kind = "int" if all(isinstance(v, int) for v in values if v is not None) and values else "string"
    return F.get(F.lit(values) if values else F.array().cast("array<string>"), position).cast(kind)


# --- the index by scope, for policy sets too large to inline ---------------------------------------

# Fields of a request that a policy may name; "operation" is a field of its own for policies that name nothing else.
_SCOPE = ["user", "role", "database", "schema", "table", "column", "operation"]
_SALTS = 16


def _stored(df: DataFrame, purpose: str) -> DataFrame:
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scope_index(policies: DataFrame, of_columns: bool = False) -> DataFrame:
    """The policies of tables (or of columns) numbered by precedence, one row per combination of the names that each lists.

    ``place`` is smaller the higher a policy ranks: specificity, then priority, then BLOCK over ALLOW, then load order.
    A scope field is null where the policy holds for any value; ``named`` says as bits which are not."""
    ranked = policies.withColumn("spec", specificity()).where((F.size("columns") > 0) if of_columns else (F.size("columns") == 0)).orderBy(
        F.desc("spec"), F.desc("priority"), F.desc(F.col("action") == "BLOCK"), "load_order").withColumn("place", F.monotonically_increasing_id())
    ranked = _stored(ranked, "policies")
    any_of = lambda c, free: F.when(free, F.array(F.lit(None).cast("string"))).otherwise(F.col(c))
    one = lambda c: F.when(F.col(c) != ANY, F.col(c))
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    out = ranked.select(
        "*", one("database").alias("_database"), one("schema").alias("_schema"), one("table").alias("_table"),
        F.explode(any_of("users", none("users") | F.array_contains("users", ANY))).alias("_user"))
    out = out.withColumn("_role", F.explode(any_of("roles", none("roles"))))
    out = out.withColumn("_column", F.explode(any_of("columns", F.lit(not of_columns) | F.array_contains("columns", ANY))))
    bare = F.coalesce("_user", "_role", "_database", "_schema", "_table", "_column").isNull()
    out = out.withColumn("_operation", F.explode(any_of("operations", none("operations") | ~bare)))
    named = sum((F.when(F.col(f"_{f}").isNotNull(), 1 << i).otherwise(0) for i, f in enumerate(_SCOPE)), F.lit(0))
    return _stored(out.withColumn("named", named), "policy_index")


def _leading(index: DataFrame) -> DataFrame:
    """The index with one row for each set of conditions: of policies that hold for the same requests at the same times only the
    one that ranks highest can win, so a request meets as many rows as there are different conditions, not policies."""
    names = lambda c: F.array_sort(F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>")))).alias(c)
    return index.groupBy("named", *[f"_{f}" for f in _SCOPE], names("operations"), names("exclude_roles"), "shadow", "valid_from", "valid_until").agg(
        F.min("place").alias("place"))


def _candidates(shapes: DataFrame, index: DataFrame) -> DataFrame:
    """(shape fields, place, shadow, from_us, until_us) of every policy that covers a shape at some time.

    ``shapes`` has the distinct requests: user, roles, database, schema, table, column, operation."""
    keep = [c for c in shapes.columns]
    # Of the policies that name nothing, only those can win that rank above the best one without conditions.
    bare = index.where("named = 0")
    free = bare.where(~F.col("shadow") & F.col("valid_from").isNull() & F.col("valid_until").isNull() & (F.coalesce(F.size("exclude_roles"), F.lit(0)) <= 0))
    least = free.agg(F.min("place")).first()[0]
    out = None
    for (named,) in sorted(index.select("named").distinct().collect()):
        fields = [f for i, f in enumerate(_SCOPE) if named >> i & 1]
        side = index.where(F.col("named") == named).select(
            *[F.col(f"_{f}") for f in fields], "place", "shadow", "operations", "exclude_roles",
            F.unix_micros("valid_from").alias("from_us"), F.unix_micros("valid_until").alias("until_us"))
        if not fields and least is not None:
            side = side.where((F.col("place") <= least) | F.col("shadow"))
        left = shapes.withColumn("role", F.explode(F.array_distinct("roles"))) if "role" in fields else shapes
        met = left.withColumn("_any", F.lit(0)).join(side.withColumn("_any", F.lit(0)), [F.col(f) == F.col(f"_{f}") for f in fields] or ["_any"])
        bans = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
        met = met.where((bans("operations") | F.array_contains("operations", F.col("operation")))
                        & (bans("exclude_roles") | ~F.arrays_overlap("exclude_roles", "roles"))).select(*keep, "place", "shadow", "from_us", "until_us")
        out = met if out is None else out.union(met)
    return out


def _request(names: dict[str, str], columns: list[str]) -> dict[str, Column]:
    """Request fields by column; ``names`` overrides the default column of a field."""
    def field(name: str, default: Column) -> Column:
        c = names.get(name, name)
        return F.col(c) if c in columns else default
    ts_us = F.col("ts_us") if "ts_us" in columns else F.unix_micros(F.col(names.get("ts", "ts")))
    return {
        "user": field("user", F.lit("")), "roles": field("roles", F.array().cast("array<string>")),
        "database": field("database", F.lit("")),
        "schema": F.coalesce(F.nullif(field("schema", F.lit("")), F.lit("")), F.lit("public")),
        "statement_type": field("statement_type", F.lit("SELECT")), "ts_us": ts_us,
    }


_FIELDS = ["spec", "name", "action", "reason", "masking_action", "mask_prefix", "mask_suffix"]


def _with_winners(requests: DataFrame, policies: DataFrame, q: dict[str, Column], ids: list[str],
                  column: Column | None = None) -> DataFrame:
    """Add ``_w`` (enforced winner) and ``_s`` (shadow winner) to each request."""
    ranked = _inline(policies)
    if ranked is not None:
        placed = requests.withColumns({"_iw": _first(ranked, q, False, column), "_is": _first(ranked, q, True, column)})
        winner = lambda i: F.struct(*[_pick(ranked, F.col(i), f).alias(f) for f in _FIELDS])
        return placed.withColumns({"_w": winner("_iw"), "_s": winner("_is")}).drop("_iw", "_is")
    index = scope_index(policies, column is not None)
    fields = {"user": q["user"], "roles": q["roles"], "database": q["database"], "schema": q["schema"], "table": q["table"],
              "column": column if column is not None else F.lit(None).cast("string"), "operation": q["statement_type"]}
    asked = requests.select(*requests.columns, F.struct(*[c.alias(f) for f, c in fields.items()]).alias("_shape"), q["ts_us"].alias("_at"))
    shapes = _stored(asked.select("_shape.*").distinct(), "requests")
    found = _candidates(shapes, _stored(_leading(index), "leading_policies"))
    if found is None:  # no policies at all
        none = F.lit(None).cast(_winner_type(policies))
        return requests.withColumns({"_w": none, "_s": none})
    found = _stored(found.select(F.struct(*fields).alias("_shape"), "place", "shadow", "from_us", "until_us"), "candidates")
    timed = F.col("from_us").isNotNull() | F.col("until_us").isNotNull()
    best = lambda shadow: F.min(F.when(~timed & (F.col("shadow") == shadow), F.col("place")))
    fixed = found.groupBy("_shape").agg(best(False).alias("_w0"), best(True).alias("_s0"))
    above = found.where(timed).join(fixed, "_shape").where(F.col("place") < F.coalesce(F.when(F.col("shadow"), F.col("_s0")).otherwise(F.col("_w0")),
                                                                                    F.lit((1 << 63) - 1)))
    # What a policy says is added to the requests' answers, which are fewer than the log's rows.
    about = index.dropDuplicates(["place"]).select("place", F.struct(*_FIELDS).alias("_about"))
    of = lambda place, to: about.select(F.col("place").alias(place), F.col("_about").alias(to))
    fixed = fixed.join(of("_w0", "_wf"), "_w0", "left").join(of("_s0", "_sf"), "_s0", "left").select("_shape", "_wf", "_sf")
    above = above.join(about, "place").select("_shape", "shadow", "from_us", "until_us", F.struct("place", "_about").alias("_rule"))
    salt = F.pmod(F.xxhash64(*ids), F.lit(_SALTS))
    dealt = lambda df: df.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))))
    asked = asked.withColumn("_salt", salt)
    # Rows of requests that timed policies may decide; every other row has its answer from its request.
    now = asked.select(*ids, "_at", "_shape", "_salt").join(dealt(above), ["_shape", "_salt"])
    now = now.where((F.col("from_us").isNull() | (F.col("_at") >= F.col("from_us"))) & (F.col("until_us").isNull() | (F.col("_at") <= F.col("until_us"))))
    now = now.groupBy(*ids).agg(F.min(F.when(~F.col("shadow"), F.col("_rule"))).alias("_w1"), F.min(F.when(F.col("shadow"), F.col("_rule"))).alias("_s1"))
    placed = asked.join(dealt(fixed), ["_shape", "_salt"], "left").join(now, ids, "left")
    # A timed policy found here ranks above the request's best untimed one.
    return placed.select(*requests.columns, F.coalesce("_w1._about", "_wf").alias("_w"), F.coalesce("_s1._about", "_sf").alias("_s"))


def _winner_type(policies: DataFrame):
    return policies.withColumn("spec", specificity()).select(F.struct(*_FIELDS).alias("w")).schema["w"].dataType


def evaluate_tables(requests: DataFrame, policies: DataFrame, ids: list[str],
                    names: dict[str, str] | None = None) -> DataFrame:
    """Decide each (request, table) row, identified by ``ids``; adds decision, matched_policy,
    rule_specificity, block_reason, shadow_blocked and shadow_policy."""
    names = names or {}
    table = F.col(names.get("table", "table"))
    q = {**_request(names, requests.columns), "table": table}
    out = _with_winners(requests, policies, q, ids)
    return (out.withColumn("decision", F.coalesce("_w.action", F.lit("BLOCK")))
            .withColumn("matched_policy", F.coalesce("_w.name", F.lit("default_deny")))
            .withColumn("rule_specificity", F.coalesce("_w.spec", F.lit(0)))
            .withColumn("block_reason", F.when(F.col("decision") == "BLOCK", F.coalesce("_w.reason", F.lit(""))))
            .withColumn("shadow_blocked", F.coalesce(F.col("_s.action") == "BLOCK", F.lit(False)))
            .withColumn("shadow_policy", F.col("_s.name"))
            .drop("_w", "_s"))


def evaluate_columns(requests: DataFrame, policies: DataFrame, ids: list[str],
                     names: dict[str, str] | None = None) -> DataFrame:
    """Decide each (request, table, column) row, identified by ``ids``; adds decision, matched_policy and the mask to apply."""
    names = names or {}
    table, column = F.col(names.get("table", "table")), F.col(names.get("column", "column"))
    q = {**_request(names, requests.columns), "table": table}
    out = _with_winners(requests, policies, q, ids, column)
    allowed = F.coalesce(F.col("_w.action"), F.lit("ALLOW")) == "ALLOW"
    return (out.withColumn("decision", F.coalesce("_w.action", F.lit("ALLOW")))
            .withColumn("matched_policy", F.coalesce("_w.name", F.lit("default_allow")))
            .withColumn("masking_action", F.when(allowed, F.coalesce("_w.masking_action", F.lit("NONE"))).otherwise("NONE"))
            .withColumn("mask_prefix", F.col("_w.mask_prefix")).withColumn("mask_suffix", F.col("_w.mask_suffix"))
            .drop("_w", "_s"))


def decide_queries(log: DataFrame, policies: DataFrame, id_col: str = "audit_id",
                   names: dict[str, str] | None = None) -> DataFrame:
    """Decide each log row over its ``tables`` array; adds new_decision and new_policy.

    No table: ALLOW ``utility_statement``. Any table blocked: BLOCK by the first such table. A single
    table keeps its policy's name, several allowed ones give ``multi_table_allow``.
    """
    names = names or {}
    tables = F.coalesce(F.col(names.get("tables", "tables")), F.array().cast("array<string>"))
    ranked = _inline(policies)
    if ranked is not None:
        q = _request(names, log.columns)
        decided = log.withColumn("_p", F.transform(tables, lambda t: F.coalesce(
            _first(ranked, {**q, "table": t}, False), F.lit(-1))))
        decided = decided.withColumn("_v", F.transform("_p", lambda i: F.when(i >= 0, F.struct(
            _pick(ranked, i, "action").alias("action"), _pick(ranked, i, "name").alias("name"))).otherwise(
            F.struct(F.lit("BLOCK").alias("action"), F.lit("default_deny").alias("name"))))).drop("_p")
    else:
        used = {names.get(f, f) for f in ("user", "roles", "database", "schema", "statement_type", "ts", "ts_us")}
        exploded = log.select(id_col, *[c for c in log.columns if c in used and c != id_col],
                              F.posexplode(tables).alias("_pos", "_table"))
        each = evaluate_tables(exploded, policies, [id_col, "_pos"], {**names, "table": "_table"})
        # At most one entry per table of a single request is collected here.
        per_query = each.groupBy(id_col).agg(
            F.array_sort(F.collect_list(F.struct("_pos", "decision", "matched_policy"))).alias("_l"))
        decided = log.join(per_query, id_col, "left").withColumn("_l", F.coalesce(
            "_l", F.array().cast("array<struct<_pos:int,decision:string,matched_policy:string>>"))).withColumn("_v", F.transform("_l", lambda x: F.struct(
            x["decision"].alias("action"), x["matched_policy"].alias("name")))).drop("_l")
    first_block = F.try_element_at(F.filter("_v", lambda v: v["action"] == "BLOCK"), F.lit(1))
    return (decided.withColumn("_b", first_block)
            .withColumn("new_decision", F.when(F.col("_b").isNotNull(), "BLOCK").otherwise("ALLOW"))
            .withColumn("new_policy", F.when(F.size("_v") == 0, "utility_statement")
                        .when(F.col("_b").isNotNull(), F.col("_b.name"))
                        .when(F.size("_v") == 1, F.try_element_at("_v", F.lit(1))["name"])
                        .otherwise("multi_table_allow"))
            .drop("_v", "_b"))


def replay(log: DataFrame, policies: DataFrame, id_col: str = "audit_id",
           names: dict[str, str] | None = None) -> DataFrame:
    """The log with the decision the proposed policies would have made and how it differs."""
    old = F.col((names or {}).get("decision", "decision"))
    return (decide_queries(log, policies, id_col, names)
            .withColumn("change", F.when(F.col("new_decision") == old, "unchanged")
                        .when(F.col("new_decision") == "BLOCK", "newly_blocked")
                        .otherwise("newly_allowed")))


def replay_summary(replayed: DataFrame) -> DataFrame:
    n = lambda c: F.count_if(c)
    return replayed.agg(
        F.count(F.lit(1)).alias("total"), n(F.col("change") != "unchanged").alias("changed"),
        n(F.col("change") == "newly_blocked").alias("newly_blocked"),
        n(F.col("change") == "newly_allowed").alias("newly_allowed"),
        n(F.col("change") == "unchanged").alias("unchanged"))


def replay_diffs(replayed: DataFrame, order: list[str], max_diffs: int = 100) -> DataFrame:
    """The first changed rows in log order (a bounded report, taken with a top-k)."""
    return replayed.filter(F.col("change") != "unchanged").orderBy(*order).limit(max_diffs)


def policy_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Policies added, removed, changed or unchanged between two versions, matched by name."""
    def side(df: DataFrame, tag: str) -> DataFrame:
        body = F.to_json(F.struct(*[c for c in df.columns if c not in ("name", "load_order")]))
        return df.select("name", F.sha2(body, 256).alias(tag))
    both = side(old, "_old").join(side(new, "_new"), "name", "full")
    status = (F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed")
              .when(F.col("_old") == F.col("_new"), "unchanged").otherwise("changed"))
    return both.select("name", status.alias("status"))


def dead_policies(policies: DataFrame, log: DataFrame, matched: str = "matched_policy") -> DataFrame:
    """Policies that no log row matched."""
    used = log.select(F.col(matched).alias("name")).filter(F.col("name").isNotNull()).distinct()
    return policies.join(used, "name", "left_anti")


def grant_coverage(log: DataFrame, grants: DataFrame, names: dict[str, str] | None = None, broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Log rows covered by an approved temporary grant, with the policy name the grant acts under.

    ``grants``: request_id, user, database, table, statement_types, valid_from_us, valid_until_us.
    Each row is reported once, under the grant that ends last. Up to ``broadcast_rows`` grants are broadcast; more are laid
    among the log rows in the order of time. Of the grants that have begun the one that ends last covers a row if any does.
    """
    n = {"user": "user", "database": "database", "table": "table", "statement_type": "statement_type",
         "ts_us": "ts_us", **(names or {})}
    if not fits_broadcast(grants, broadcast_rows):
        return _grants_in_time(log, grants, n)
    key = ["_gu", "_gd", "_gt"]
    g = grants.groupBy(F.col("user").alias("_gu"), F.col("database").alias("_gd"), F.col("table").alias("_gt")).agg(
        F.collect_list(F.struct(F.col("valid_until_us").alias("until"), F.col("request_id").alias("id"),
                                F.col("valid_from_us").alias("since"), F.col("statement_types").alias("ops"))).alias("_g"))
    joined = log.join(small_side(g), (F.col(n["user"]) == F.col("_gu")) & (F.col(n["database"]) == F.col("_gd"))
                      & (F.col(n["table"]) == F.col("_gt")))
    ts, op = F.col(n["ts_us"]), F.col(n["statement_type"])
    best = F.array_max(F.filter("_g", lambda x: (ts >= x["since"]) & (ts <= x["until"])
                                & ((F.size(x["ops"]) == 0) | F.array_contains(x["ops"], op))))
    return (joined.withColumn("_m", best).filter(F.col("_m").isNotNull())
            .withColumn("grant_policy", F.concat(F.lit("access_grant_"), F.col("_m.id").cast("string")))
            .drop("_m", "_g", *key))


def _grants_in_time(log: DataFrame, grants: DataFrame, n: dict[str, str]) -> DataFrame:
    """``grant_coverage`` for any number of grants of a key."""
    keys = ["_gu", "_gd", "_gt", "_go"]
    kinds = F.when(F.size("statement_types") > 0, F.col("statement_types")).otherwise(F.array(F.lit(None).cast("string")))
    marks = grants.where("user IS NOT NULL AND database IS NOT NULL AND `table` IS NOT NULL").select(
        F.col("user").alias("_gu"), F.col("database").alias("_gd"), F.col("table").alias("_gt"), F.explode(kinds).alias("_go"),
        F.col("valid_from_us").alias("_at"), position("valid_until_us", "request_id").alias("_end"))
    rows = log.withColumns({"_gu": F.col(n["user"]), "_gd": F.col(n["database"]), "_gt": F.col(n["table"]), "_at": F.col(n["ts_us"])})
    # Grants for any kind of statement, then those for the row's own kind.
    rows = ordered.as_of(rows.withColumn("_go", F.lit(None).cast("string")), marks.where("_go IS NULL"), keys, "_at", "_end", "_any")
    rows = ordered.as_of(rows.withColumn("_go", F.col(n["statement_type"])), marks.where("_go IS NOT NULL"), keys, "_at", "_end", "_own")
    rows = rows.withColumn("_best", F.greatest("_any", "_own")).withColumns(at_position("_best", "_until", "_id"))
    return rows.where(F.col("_until") >= F.col("_at")).withColumn("grant_policy", F.concat(F.lit("access_grant_"), F.col("_id").cast("string"))).drop(
        *keys, "_at", "_any", "_own", "_best", "_until", "_id")
