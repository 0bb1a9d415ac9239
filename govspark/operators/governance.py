"""Governed tables: row filters, column access, masks, limits, and queries over secured views.

A table is secured once, at its base relation — decrypt, filter rows, drop blocked columns, mask —
and user SQL only ever sees the secured view. Catalyst pushes the row filter and the pruned column
list into the scan, and no alias, OR or subquery of the user's text can get behind them.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from govspark.functions import masking
from govspark.functions.crypto import decrypt_columns
from govspark.operators import admission, classify, policy
from govspark.operators.admission import AccessDenied
from govspark.runtime import local_frame

DEFAULT_LIMIT = 1000
MAX_RESULT_ROWS = 10_000


@dataclass(frozen=True)
class Principal:
    user: str
    roles: tuple[str, ...] = ()
    attributes: dict[str, str] = field(default_factory=dict)
    database: str = "default"
    tenant: str = "default"


@dataclass(frozen=True)
class RowRule:
    """Row filter: ``condition`` may use $USER, $ROLES and $ATTR.key inside or outside quotes."""
    condition: str
    table: str | None = None
    database: str | None = None
    users: tuple[str, ...] = ()
    roles: tuple[str, ...] = ()

    def applies(self, principal: Principal, table: str) -> bool:
        return ((self.database is None or self.database == principal.database)
                and (self.table is None or self.table == table)
                and _covers(self.users, self.roles, principal))


@dataclass(frozen=True)
class LimitRule:
    limit: int = DEFAULT_LIMIT
    users: tuple[str, ...] = ()
    roles: tuple[str, ...] = ()


def _covers(users: tuple[str, ...], roles: tuple[str, ...], principal: Principal) -> bool:
    if not users and not roles:
        return True
    return "*" in users or principal.user in users or bool(set(roles) & set(principal.roles))


# --- rows -----------------------------------------------------------------------------------------

_PLACEHOLDER = re.compile(r"\$USER|\$ROLES|\$ATTR\.(\w+)")


def bind_condition(condition: str, principal: Principal) -> tuple[str, dict[str, str]]:
    """The condition with every placeholder turned into a named parameter, and the parameters.

    Values travel as literals of the plan, never as text, so nothing in them can change the condition.
    """
    args: dict[str, str] = {}

    def param(value: str) -> str:
        name = f"p{len(args)}"
        args[name] = value.replace("\0", "")
        return f":{name}"

    def value_of(m: re.Match) -> str:
        key = m.group(1)
        return principal.user if m.group(0) == "$USER" else principal.attributes.get(key, key)

    def expand(m: re.Match) -> str:
        if m.group(0) == "$ROLES":
            return ", ".join(param(r) for r in principal.roles) or "NULL"
        return param(value_of(m))

    def expand_quoted(literal: str) -> str:
        body, parts, at = literal[1:-1], [], 0
        for m in _PLACEHOLDER.finditer(body):
            if m.group(0) == "$ROLES":
                continue
            if m.start() > at:
                parts.append("'" + body[at:m.start()] + "'")
            parts.append(param(value_of(m)))
            at = m.end()
        if not parts:
            return literal
        if at < len(body):
            parts.append("'" + body[at:] + "'")
        return parts[0] if len(parts) == 1 else "concat(" + ", ".join(parts) + ")"

    pieces = re.split(r"('(?:[^']|'')*')", condition)
    bound = [expand_quoted(p) if p.startswith("'") else _PLACEHOLDER.sub(expand, p) for p in pieces]
    return "".join(bound), args


def rls_filter(df: DataFrame, rules: list[RowRule], principal: Principal, table: str) -> DataFrame:
    """Keep the rows every applicable rule allows."""
    for rule in rules:
        if rule.applies(principal, table):
            condition, args = bind_condition(rule.condition, principal)
            df = df.sparkSession.sql(f"SELECT * FROM {{base}} WHERE ({condition})", args=args, base=df)
    return df


# --- columns --------------------------------------------------------------------------------------

@dataclass(frozen=True)
class ColumnDecision:
    column: str
    decision: str = "ALLOW"
    policy: str = "default_allow"
    masking_action: str = "NONE"
    prefix: int | None = None
    suffix: int | None = None


def column_decisions(spark: SparkSession, principal: Principal, table: str, columns: list[str],
                     policies: DataFrame, statement_type: str, ts) -> dict[str, ColumnDecision]:
    """Column decisions of one principal for one table (as many rows as the table has columns)."""
    return _column_decisions(spark, principal, {table: columns}, policies, statement_type, ts)[table]


def _column_decisions(spark, principal, columns: dict[str, list[str]], policies, statement_type, ts):
    rows = [(principal.user, list(principal.roles), principal.database, "", t, c, statement_type, ts)
            for t, names in columns.items() for c in names]
    decided = policy.evaluate_columns(local_frame(spark, rows, _REQUEST), policies, ["table", "column"])
    out: dict[str, dict[str, ColumnDecision]] = {t: {} for t in columns}
    for r in decided.collect():
        out[r["table"]][r["column"]] = ColumnDecision(r["column"], r["decision"], r["matched_policy"], r["masking_action"],
                                                      r["mask_prefix"], r["mask_suffix"])
    return out


_REQUEST = T.StructType([
    T.StructField("user", T.StringType()), T.StructField("roles", T.ArrayType(T.StringType())),
    T.StructField("database", T.StringType()), T.StructField("schema", T.StringType()),
    T.StructField("table", T.StringType()), T.StructField("column", T.StringType()),
    T.StructField("statement_type", T.StringType()), T.StructField("ts", T.TimestampType())])


def column_acl(df: DataFrame, decisions: dict[str, ColumnDecision]) -> DataFrame:
    """Drop the columns decided BLOCK; they leave the scan as well."""
    return df.drop(*[c for c in df.columns if c in decisions and decisions[c].decision == "BLOCK"])


def apply_masking(df: DataFrame, decisions: dict[str, ColumnDecision]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Mask every allowed column that a decision says to; also returns (column, action) of the masked ones."""
    def expr(c: str) -> Column:
        d = decisions.get(c)
        if d is None or d.decision != "ALLOW" or d.masking_action == "NONE":
            return F.col(f"`{c}`")
        report.append((c, d.masking_action))
        return masking.apply_mask(F.col(f"`{c}`"), d.masking_action, d.prefix, d.suffix).alias(c)
    report: list[tuple[str, str]] = []
    return df.select(*[expr(c) for c in df.columns]), report


# --- limits ---------------------------------------------------------------------------------------

def _node_names(df: DataFrame) -> set[str]:
    plan, names, stack = df._jdf.queryExecution().analyzed(), set(), []
    stack.append(plan)
    while stack:
        node = stack.pop()
        names.add(node.nodeName())
        for seq in (node.children(), node.subqueries()):
            stack.extend(seq.apply(i) for i in range(seq.size()))
    return names


def has_limit(df: DataFrame) -> bool:
    """Is the outermost operation of the query a limit?"""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "SubqueryAlias", "Offset"):
        node = node.children().apply(0)
    return "Limit" in node.nodeName()


def enforce_limit(df: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Add LIMIT when the query has none."""
    return df if has_limit(df) else df.limit(limit)


def default_limit(df: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Add LIMIT only to a query without limit, aggregate or subquery."""
    names = _node_names(df)
    subquery = any("Subquery" in n and n != "SubqueryAlias" for n in names) or _has_subquery(df)
    if "Aggregate" in names or subquery or any("Limit" in n for n in names):
        return df
    return df.limit(limit)


def _has_subquery(df: DataFrame) -> bool:
    stack = [df._jdf.queryExecution().analyzed()]
    while stack:
        node = stack.pop()
        if node.subqueries().size():
            return True
        children = node.children()
        stack.extend(children.apply(i) for i in range(children.size()))
    return False


class ResultTooLarge(Exception):
    """RESULT_TOO_LARGE: the query returns more rows than allowed."""


_TOO_LARGE = "RESULT_TOO_LARGE"


def max_rows_guard(df: DataFrame, max_rows: int = MAX_RESULT_ROWS) -> DataFrame:
    """Fail when the result exceeds ``max_rows``: the running query counts its rows and raises RESULT_TOO_LARGE on the row past
    the bound, so it is run once. No more than that many rows pass through the counting task. ``guarded`` turns the error
    of an action into ResultTooLarge."""
    first = df.limit(max_rows + 1).coalesce(1)
    message = F.lit(f"{_TOO_LARGE}: more than {max_rows} rows")
    return first.where(F.when(F.monotonically_increasing_id() < max_rows, True).otherwise(F.raise_error(message).cast("boolean")))


def guarded(action: Callable[[], object]):
    """The result of ``action``, an action on a guarded DataFrame."""
    try:
        return action()
    except Exception as e:
        if _TOO_LARGE in str(e):
            raise ResultTooLarge(next(line for line in str(e).splitlines() if _TOO_LARGE in line)) from e
        raise


# --- structured requests --------------------------------------------------------------------------

def spec_select(df: DataFrame, spec: dict) -> DataFrame:
    """``{fields, where: {col: value}, order_by, desc, limit, offset}`` over a table."""
    for c, v in (spec.get("where") or {}).items():
        df = df.filter(F.col(c) == F.lit(v))
    if spec.get("order_by"):
        keys = spec["order_by"] if isinstance(spec["order_by"], list) else [spec["order_by"]]
        df = df.orderBy(*[F.col(k).desc() if spec.get("desc") else F.col(k).asc() for k in keys])
    if spec.get("offset"):
        df = df.offset(spec["offset"])
    if spec.get("limit") is not None:
        df = df.limit(spec["limit"])
    return df.select(*spec["fields"]) if spec.get("fields") else df


def spec_mutate(df: DataFrame, spec: dict) -> tuple[DataFrame, DataFrame]:
    """``{op: insert|update|delete, values, where, returning}`` → (new table version, affected rows)."""
    cond = F.lit(True)
    for c, v in (spec.get("where") or {}).items():
        cond = cond & F.coalesce(F.col(c) == F.lit(v), F.lit(False))
    values = spec.get("values") or {}
    if spec["op"] == "insert":
        row = local_frame(df.sparkSession, [tuple(values.get(f.name) for f in df.schema)], df.schema)
        version, affected = df.unionByName(row), row
    elif spec["op"] == "update":
        new = {c: F.when(cond, F.lit(v).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()}
        version = df.withColumns(new)
        affected = df.filter(cond).withColumns({c: F.lit(v).cast(df.schema[c].dataType) for c, v in values.items()})
    else:
        version, affected = df.filter(~cond), df.filter(cond)
    return version, affected.select(*spec["returning"]) if spec.get("returning") else affected


# --- whole queries --------------------------------------------------------------------------------

@dataclass(frozen=True)
class Governed:
    df: DataFrame
    policy: str
    masked: list[tuple[str, str]]
    classes: dict[str, str]
    tables: list[str]


def secure_table(df: DataFrame, table: str, principal: Principal, rules: list[RowRule],
                 decisions: dict[str, ColumnDecision], encrypted: list[str] | None = None,
                 keys: DataFrame | None = None) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Row filter → decrypt → column access → masks, all on the base relation."""
    df = rls_filter(df, rules, principal, table)
    if encrypted and keys is not None:
        df = decrypt_columns(df, encrypted, keys)
    return apply_masking(column_acl(df, decisions), decisions)


def governed_query(spark: SparkSession, sql: str, principal: Principal, policies: DataFrame,
                   tables: dict[str, Callable[[SparkSession], DataFrame]], as_of,
                   rules: list[RowRule] = (), limits: list[LimitRule] = (),
                   encrypted: dict[str, list[str]] | None = None, keys=None,
                   max_rows: int | None = None) -> Governed:
    """Run ``sql`` for ``principal`` over secured views of ``tables`` (name → reader), or raise AccessDenied.

    The views live in a session of their own, where nothing else is registered; see ``admission`` for what a query may be.
    """
    inner = spark.newSession()
    inner.conf.set("spark.sql.session.timeZone", "UTC")
    # Else ${env:NAME} in the text would be replaced by the driver's environment before it is parsed.
    inner.conf.set("spark.sql.variable.substitute", "false")
    names, ctes = admission.parsed_relations(inner, sql)
    for parts in names:
        if len(parts) > 1 or parts[0] not in tables:
            raise AccessDenied("default_deny", f"unknown relation {'.'.join(parts)}")
    for name in ctes - {t.lower() for t in tables}:
        if spark.catalog.tableExists(name):
            raise AccessDenied("default_deny", f"{name} is also a relation of the session")
    used = [parts[0] for parts in names]
    ts = as_of
    rows = [(principal.user, list(principal.roles), principal.database, "", t, "", "SELECT", ts) for t in used]
    name = "utility_statement"
    if rows:
        decided = policy.evaluate_tables(local_frame(spark, rows, _REQUEST), policies, ["table"]).collect()
        by_table = {r["table"]: r for r in decided}
        for t in used:
            if by_table[t]["decision"] == "BLOCK":
                raise AccessDenied(by_table[t]["matched_policy"], by_table[t]["block_reason"] or "")
        name = by_table[used[0]]["matched_policy"] if len(used) == 1 else "multi_table_allow"
    masked: list[tuple[str, str]] = []
    bases = {t: tables[t](inner) for t in used}
    decisions = _column_decisions(spark, principal, {t: b.columns for t, b in bases.items()}, policies, "SELECT", ts)
    for t, base in bases.items():
        secured, report = secure_table(base, t, principal, list(rules), decisions[t],
                                       (encrypted or {}).get(t), keys(inner) if keys else None)
        secured.createOrReplaceTempView(t)
        masked += [(f"{t}.{c}", a) for c, a in report]
    out = inner.sql(sql)
    admission.prove_analyzed(out, set(used))
    for rule in limits:
        if _covers(rule.users, rule.roles, principal):
            out = enforce_limit(out, rule.limit)
    if max_rows is not None:
        out = max_rows_guard(out, max_rows)
    return Governed(out, name, masked, classify.names_of(out.columns), used)
