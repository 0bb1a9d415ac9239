"""Personal-data classification of columns: by name, by declared type, by value, by derivation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from govspark.functions.recognizers import RECOGNIZERS, SPANS, spans
from govspark.runtime import small_side
from govspark.schemas import PII_TYPES

# Column-name patterns of each class.
NAME_PATTERNS = {
    "PII.Email": ["email", "e_mail", "mail", "email_address"],
    "PII.Phone": ["phone", "telephone", "mobile", "cell", "phone_number"],
    "PII.SSN": ["ssn", "social_security", "social_security_number"],
    "PII.CreditCard": ["credit_card", "card_number", "cc_number", "creditcard"],
    "PII.Address": ["address", "street", "street_address", "home_address", "mailing_address", "city", "zip",
                    "zip_code", "zipcode", "postal_code", "postcode"],
    "PII.Passport": ["passport", "passport_number", "passport_no", "passport_id"],
    "PII.IpAddress": ["ip_address", "ip_addr", "client_ip", "source_ip", "remote_addr"],
    "Sensitive.Salary": ["salary", "compensation", "pay", "wage"],
    "Sensitive.Password": ["password", "pwd", "pass_hash"],
}
# Expressions that destroy the personal content of what they read.
DESTROYERS = ["length(", "char_length(", "octet_length(", "md5(", "sha", "crypt(", "count(", "sum(", "avg(",
              "min(", "max(", "extract(", "date_part(", "date_trunc("]
# Name parts that count for a column of a text or integer type.
TYPE_RULES = [("PII.Email", ["email", "mail"], ("text",)),
              ("PII.SSN", ["ssn", "social_security"], ("text", "bigint", "integer")),
              ("PII.Phone", ["phone", "mobile", "telephone"], ("text", "bigint")),
              ("PII.CreditCard", ["credit_card", "card_number"], ("text", "bigint"))]

_BY_PATTERN = {p: cls for cls, patterns in NAME_PATTERNS.items() for p in patterns}
# The longest pattern wins, then the alphabetically first.
_RANKED = sorted(_BY_PATTERN, key=lambda p: (-len(p), p))


def class_of_name(name: str) -> str | None:
    name = name.lower()
    return _BY_PATTERN.get(name) or next((_BY_PATTERN[p] for p in _RANKED if p in name), None)


def names_of(columns: list[str]) -> dict[str, str]:
    return {c: cls for c in columns if (cls := class_of_name(c))}


def name_class(c: Column) -> Column:
    """``class_of_name`` as an expression over a column of names."""
    low = F.lower(c)
    out = F
    for p in _RANKED:
        out = out.when(low.contains(p), _BY_PATTERN[p])
    return out.otherwise(F.lit(None).cast("string"))


def type_class(name: Column, family: Column) -> Column:
    """Class by declared type; ``family`` is text, bigint, integer or anything else."""
    low, out = F.lower(name), F
    for cls, parts, families in TYPE_RULES:
        hit = low.contains(parts[0])
        for p in parts[1:]:
            hit = hit | low.contains(p)
        out = out.when(hit & family.isin(*families), cls)
    return out.otherwise(F.lit(None).cast("string"))


def _family(dt: T.DataType) -> str:
    if isinstance(dt, (T.StringType, T.VarcharType, T.CharType)):
        return "text"
    return "bigint" if isinstance(dt, T.LongType) else "integer" if isinstance(dt, T.IntegerType) else "other"


# label → function(column name, column) giving a boolean match expression, and its confidence
_PLUGINS: dict[str, tuple[Callable[[str, Column], Column], float]] = {}


def register_classifier(label: str, match: Callable[[str, Column], Column], confidence: float = 0.8) -> None:
    """Add a user classifier. ``match(column_name, column)`` returns a boolean Column per value (a built-in
    expression or a pandas UDF); the class applies when at least half of the rows match."""
    _PLUGINS[label] = (match, confidence)


def unregister_classifier(label: str) -> None:
    _PLUGINS.pop(label, None)


def classify_columns(df: DataFrame, sample: int | None = None, order: list[str] | None = None) -> DataFrame:
    """(column, pii_type, confidence, strategy) of every classified column of ``df``.

    Name and type rules need no data. All other columns are tested in one aggregation with a handful of
    counters per column; ``sample`` limits it to the first rows by ``order``, the default is the table.
    """
    known, open_columns = [], []
    for f in df.schema.fields:
        by_name = class_of_name(f.name)
        if by_name:
            known.append((f.name, by_name, 0.9, "ColumnName"))
        else:
            open_columns.append(f.name)
    rows = df.select(*open_columns) if sample is None else df.orderBy(*order).limit(sample).select(*open_columns)
    counters, labels = [F.count(F.lit(1)).alias("n")], []
    for i, c in enumerate(open_columns):
        text = F.col(f"`{c}`").cast("string")
        for j, (cls, test) in enumerate(RECOGNIZERS):
            counters.append(F.count_if(test(text)).alias(f"c{i}_{j}"))
        for j, (label, (match, confidence)) in enumerate(_PLUGINS.items()):
            counters.append(F.count_if(F.coalesce(match(c, F.col(f"`{c}`")), F.lit(False))).alias(f"p{i}_{j}"))
    counted = rows.agg(*counters)
    verdict = lambda column, cls, confidence, strategy: F.struct(
        F.lit(column).alias("column"), F.lit(cls).alias("pii_type"), F.lit(confidence).alias("confidence"), F.lit(strategy).alias("strategy"))
    half = F.floor((F.col("n") + 1) / 2)
    entries = [verdict(*k) for k in known]
    for i, c in enumerate(open_columns):
        out = F
        for j, (cls, _) in enumerate(RECOGNIZERS):
            out = out.when(F.col(f"c{i}_{j}") >= half, verdict(c, cls, 0.8, "RegexValue"))
        for j, (label, (_, confidence)) in enumerate(_PLUGINS.items()):
            out = out.when(F.col(f"p{i}_{j}") >= half, verdict(c, label, confidence, "Plugin"))
        entries.append(F.when(F.col("n") > 0, out))
    return counted.select(F.explode_outer(F.array(*entries)).alias("v")).filter(F.col("v").isNotNull()).select("v.*")


def recognize_values(df: DataFrame, column: str) -> DataFrame:
    """Add is_card, is_ssn, is_email, is_phone and the class that wins by precedence."""
    tests = {cls: F.coalesce(test(F.col(column)), F.lit(False)) for cls, test in RECOGNIZERS}
    out = F
    for cls, hit in tests.items():
        out = out.when(hit, cls)
    return df.withColumns({
        "is_card": tests["PII.CreditCard"], "is_ssn": tests["PII.SSN"], "is_email": tests["PII.Email"],
        "is_phone": tests["PII.Phone"], "value_class": out.otherwise("None")})


def scan_text(df: DataFrame, text: str) -> DataFrame:
    """Add one array column per class with the confirmed spans of the whole text."""
    found = {}
    for cls, span, test in SPANS:
        spans = F.regexp_extract_all(F.col(text), F.lit(span), F.lit(0))
        found[cls] = F.filter(spans, test)
    return df.withColumn("pii", F.array(*[
        F.struct(F.lit(cls).alias("pii_type"), spans.alias("spans")) for cls, spans in found.items()]))


def pii_counts(df: DataFrame, text: str, by: list[str], find: Callable[[Column, str], Column] = spans) -> DataFrame:
    """Spans and texts with spans per group and class; ``find`` gives the candidate spans of a text and a class.

    Texts are scanned once where they lie; the per-text counts are summed side by side and only the
    summed rows are turned into one row per class.
    """
    counts = df.select(*by, *[
        F.size(F.filter(find(F.col(text), cls), test)).alias(f"n{i}")
        for i, (cls, _, test) in enumerate(SPANS)])
    sums = counts.groupBy(*by).agg(*[
        F.struct(F.lit(cls).alias("pii_type"), F.sum(f"n{i}").alias("spans"), F.count_if(F.col(f"n{i}") > 0).alias("texts")).alias(f"c{i}")
        for i, (cls, _, _) in enumerate(SPANS)])
    return sums.select(*by, F.inline_outer(F.array(*[f"c{i}" for i in range(len(SPANS))])))


def derived_classes(projections: DataFrame, base: DataFrame, ids: list[str]) -> DataFrame:
    """Class of derived columns. ``projections``: ids + expr, sources (array of column names);
    ``base``: column, pii_type. A projection that is just its source keeps the source's class."""
    order = F.array(*[F.lit(p) for p in PII_TYPES])
    ranked = base.select(F.col("column").alias("source"), F.array_position(order, F.col("pii_type")).alias("rank"))
    destroyed = F.lower("expr").rlike("|".join(d.replace("(", r"\(") for d in DESTROYERS))
    exploded = projections.filter(~destroyed).select(*ids, F.explode("sources").alias("source"))
    best = exploded.join(small_side(ranked), "source").groupBy(*ids).agg(F.max("rank").alias("rank"))
    return best.filter(F.col("rank") > 1).select(
        *ids, F.element_at(order, F.col("rank").cast("int")).alias("pii_type"),
        F.lit(0.9).alias("confidence"), F.lit("DerivedColumn").alias("strategy"))
