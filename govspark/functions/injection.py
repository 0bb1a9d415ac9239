"""Injection signatures over a SQL text column.

Every check is a regular expression on one of a few prepared forms of the text: the raw text with
string contents blanked, or with comments removed as well. A form is decoded further (hexadecimal,
full-width, URL/HTML) only in rows where decoding changes it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govspark.functions import sqltext

# Pattern → threat level, in the order they are reported.
PATTERN_LEVELS = {
    "TAUTOLOGY": "HIGH", "UNION_INJECTION": "CRITICAL", "COMMENT_BYPASS": "MEDIUM",
    "COMMENT_OBFUSCATION": "HIGH", "COMMENT_KEYWORD_SPLIT": "CRITICAL", "STACKED_QUERIES": "HIGH",
    "TIME_BASED_BLIND": "HIGH", "ERROR_BASED": "MEDIUM", "HEX_ENCODING_BYPASS": "CRITICAL",
    "UNICODE_FULLWIDTH_BYPASS": "CRITICAL", "ENCODING_BYPASS": "MEDIUM",
}
BLOCK_LEVELS = ["HIGH", "CRITICAL"]

# Keyword pairs that must not appear only after comments are cut or text is decoded.
SPLIT_KEYWORDS = ["union select", "union all select", "drop table", "drop database", "insert into",
                  "delete from", "alter table", "truncate table", "create table", "exec "]
HIDDEN_KEYWORDS = ["union select", "union all select", "drop table", "drop database", "insert into",
                   "delete from", "alter table", "truncate table", "select ", "exec "]

_STRING = r"""'[^']*(?:'|\z)|"[^"]*(?:"|\z)"""
_BLOCK = r"/\*(?:[^*]|\*+[^*/])*+\*+/"
TAUTOLOGY_NUMERIC = (r"(?:^|[^0-9A-Za-z_.])(?:1\s*=\s*1|2\s*=\s*2|0\s*=\s*0|1\s*<>\s*2|1\s*!=\s*2)"
                     r"(?:[^0-9A-Za-z_.]|\z)")
TAUTOLOGY_BOOLEAN = r"(?i)(?:^|[^A-Za-z0-9])or\s+(?:true|false)(?:[^A-Za-z0-9]|\z)"
TAUTOLOGY_STRING = r"(?s)'(.)'\s*=\s*'\1'"
UNION = r"(?i)(?:^|[^A-Za-z0-9])union\s+(?:all\s+)?select(?:[^A-Za-z0-9]|\z)"
# The first keyword decides: what follows a later one follows it too. Anchored and atomic, so the text is passed once.
COMMENT_AFTER = r"(?is)\A(?>.*?(?:^|[^A-Za-z0-9])(?:where|and|or)(?=[^A-Za-z0-9])).*--"
COMMENT_BETWEEN = rf"(?s)[A-Za-z]\s*{_BLOCK}\s*[A-Za-z]"
STACKED = r"(?s);\s*[^\s]"
TIME_BASED = (r"(?i)(?:^|[^A-Za-z0-9])(?:pg_sleep(?:[^A-Za-z0-9]|\z)|sleep\s*\(|waitfor\s+delay(?:[^A-Za-z0-9]|\z)"
              r"|benchmark\s*\()")
ERROR_BASED = r"(?i)(?:extractvalue|updatexml|xmltype|geometrycollection)\s*\(|exp\s*\(\s*~"


def blank_strings(c: Column) -> Column:
    """Quoted parts emptied; everything else, comments included, as written."""
    return F.when(c.contains("'") | c.contains('"'), F.regexp_replace(c, rf"(?s){_STRING}", "''")).otherwise(c)


def cut_comments(c: Column, filler: str) -> Column:
    """Comments outside quotes replaced by ``filler``; quoted parts kept (and followed by it)."""
    cut = F.regexp_replace(c, rf"(?s)({_STRING})|/\*.*?(?:\*/|\z)|--[^\n\r]*", f"$1{filler}")
    return F.when(c.contains("--") | c.contains("/*"), cut).otherwise(c)


def _cut_block_comments(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?s)({_STRING})|/\*.*?(?:\*/|\z)", "$1")


def _keyword(blanked: Column, keyword: str) -> Column:
    return blanked.rlike(rf"(?i)(?:^|[^A-Za-z0-9]){keyword}(?:[^A-Za-z0-9]|\z)")


def _emerges(after: Column, before: Column | None, keywords: list[str]) -> Column:
    hits = [_keyword(after, k) & (~_keyword(before, k) if before is not None else F.lit(True)) for k in keywords]
    return reduce(lambda a, b: a | b, hits)


def _checks(text: str) -> dict[str, Column]:
    """The checks that are repeated on decoded text; ``text`` names a column with prepared forms."""
    raw = F.col(f"{text}.blank")
    code = F.col(f"{text}.code")
    plain = F.col(f"{text}.plain")
    return {
        "TAUTOLOGY": code.rlike(TAUTOLOGY_NUMERIC) | code.rlike(TAUTOLOGY_BOOLEAN) | plain.rlike(TAUTOLOGY_STRING),
        "UNION_INJECTION": code.rlike(UNION),
        "STACKED_QUERIES": raw.rlike(STACKED),
        "COMMENT_BYPASS": raw.rlike(COMMENT_AFTER),
        "COMMENT_OBFUSCATION": raw.rlike(COMMENT_BETWEEN) & ~raw.rlike(COMMENT_AFTER),
        "TIME_BASED_BLIND": code.rlike(TIME_BASED),
        "ERROR_BASED": code.rlike(ERROR_BASED),
    }


def _forms(c: Column) -> Column:
    plain = cut_comments(c, " ")
    return F.struct(blank_strings(c).alias("blank"), plain.alias("plain"), blank_strings(plain).alias("code"))


def scan_injection(df: DataFrame, sql_col: str = "sql", encodings: bool = True) -> DataFrame:
    """Add ``injection_patterns`` (array), ``threat_level`` and ``should_block``."""
    sql = F.col(sql_col)
    prepared = (df.withColumn("_hex", F.when(sql.rlike("0[xX][0-9A-Fa-f]{6}"), sqltext.decode_hex_tokens(sql)))
                .withColumn("_wide", F.when(F.octet_length(sql) > F.char_length(sql), sqltext.fold_width(sql)).otherwise(sql)))
    if encodings:
        prepared = prepared.withColumn("_dec", sqltext.decode_encodings(sql))
    else:
        prepared = prepared.withColumn("_dec", sql)
    prepared = (prepared
                .withColumn("_raw", _forms(sql))
                .withColumn("_cut", F.when(sql.contains("/*"), blank_strings(_cut_block_comments(sql))))
                .withColumn("_fh", F.when(F.col("_hex") != sql, _forms(F.col("_hex"))))
                .withColumn("_fw", F.when(F.col("_wide") != sql, _forms(F.col("_wide"))))
                .withColumn("_fd", F.when(F.col("_dec") != sql, _forms(F.col("_dec")))))
    raw_blank = F.col("_raw.blank")
    own, by_hex, by_width, by_decoding = (_checks(c) for c in ("_raw", "_fh", "_fw", "_fd"))
    hidden_hex = F.coalesce(F.col("_fh").isNotNull() & _emerges(F.col("_fh.blank"), raw_blank, HIDDEN_KEYWORDS), F.lit(False))
    hidden_width = F.coalesce(F.col("_fw").isNotNull() & _emerges(F.col("_fw.blank"), None, HIDDEN_KEYWORDS), F.lit(False))
    prepared = prepared.withColumn("_hh", hidden_hex).withColumn("_hw", hidden_width)

    def found(name: str) -> Column:
        if name == "COMMENT_KEYWORD_SPLIT":
            return F.col("_cut").isNotNull() & _emerges(F.col("_cut"), raw_blank, SPLIT_KEYWORDS)
        if name == "HEX_ENCODING_BYPASS":
            return F.col("_hh")
        if name == "UNICODE_FULLWIDTH_BYPASS":
            return F.col("_hw")
        if name == "ENCODING_BYPASS":
            return F.col("_fd").isNotNull()
        hit = own[name] | (F.col("_fd").isNotNull() & F.coalesce(by_decoding[name], F.lit(False)))
        if name in ("TAUTOLOGY", "UNION_INJECTION", "STACKED_QUERIES"):
            hit = hit | (~F.col("_hh") & F.coalesce(by_hex[name], F.lit(False)))
            hit = hit | (~F.col("_hw") & F.coalesce(by_width[name], F.lit(False)))
        return hit

    patterns = F.array_compact(F.array(*[
        F.when(F.coalesce(found(n), F.lit(False)), F.lit(n)) for n in PATTERN_LEVELS]))
    out = prepared.withColumn("injection_patterns", patterns)
    has = lambda level: F.arrays_overlap(F.col("injection_patterns"), F.array(*[
        F.lit(n) for n, at in PATTERN_LEVELS.items() if at == level]))
    threat = F.when(has("CRITICAL"), "CRITICAL").when(has("HIGH"), "HIGH").when(has("MEDIUM"), "MEDIUM").otherwise("NONE")
    return (out.withColumn("threat_level", threat)
            .withColumn("should_block", F.col("threat_level").isin(BLOCK_LEVELS))
            .drop("_hex", "_wide", "_dec", "_raw", "_cut", "_fh", "_fw", "_fd", "_hh", "_hw"))
