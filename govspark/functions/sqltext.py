"""SQL text columns: fingerprints, statement types, DDL targets, decoding. All of it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from govspark import schemas

# Fixed pattern: the lexical units a fingerprint distinguishes, tried in this order.
TOKEN = (r"(?s)/\*.*?(?:\*/|\z)"                     # block comment
         r"|--[^\n\r]*(?:[\n\r]|\z)"                 # line comment
         r"|'(?:[^'\\]|''|\\.)*+(?:'|\\?\z)"          # string literal
         r'|"(?:[^"\\]|\\.)*+(?:"|\\?\z)'             # quoted identifier
         r"|(?:[0-9]|[.][0-9])[0-9.eE+-]*"           # number, with the signs it swallows
         r"|[A-Za-z_$][A-Za-z0-9_$]*"                # word
         r"|[ \t\n\r]+"                              # blank
         r"|.")                                      # operator

# Fixed pattern: characters after which an operator follows without a blank.
PUNCT = r"""[!"#%&'()*+,\-./:;<=>?@\[\\\]^`{|}~]"""

# A token that needs a blank before it carries one of these until its left neighbour is known.
_LITERAL, _WORD, _OPERATOR, _INNER_BLANK = "\u0001", "\u0002", "\u0003", "\u0004"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _ascii_lower(c: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return _let(c, lambda t: F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, upper, lower)))


def _piece(t: Column) -> Column:
    quoted = F.translate(_ascii_lower(F.regexp_replace(t, r"(?s)\\.?", "")), " ", _INNER_BLANK)
    return (F.when(t.startswith("/*") | t.startswith("--"), F.lit(" "))
            .when(t.startswith("'") | t.rlike(r"^(?:[0-9]|[.][0-9])"), F.lit(_LITERAL + "?"))
            .when(t.startswith('"'), F.concat(F.lit(_WORD), quoted))
            .when(t.rlike("^[A-Za-z_$]"), F.concat(F.lit(_WORD), _ascii_lower(t)))
            .when(t.rlike(r"^[ \t\n\r]"), F.lit(" "))
            .otherwise(F.concat(F.lit(_OPERATOR), t)))


def _fold_in_lists(c: Column) -> Column:
    """Replace the bracket after the word ``in`` by ``(?)``, whatever brackets it holds inside.

    Spark has no recursive pattern, so the text is cut at brackets and one pass carries the depth:
    ``skip`` is the depth of the IN list being dropped, 0 when none is.
    """
    parts = F.regexp_extract_all(c, F.lit(r"(?s)[()]|[^()]+"), F.lit(0))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("depth"), F.lit(0).alias("skip"),
                     F.lit(False).alias("armed"))

    def step(s: Column, t: Column) -> Column:
        opens, closes = t == "(", t == ")"
        depth = s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        enters = opens & s["armed"] & (s["skip"] == 0)
        leaves = closes & (s["skip"] > 0) & (s["skip"] == s["depth"])
        out = (F.when(enters, F.concat(s["out"], F.lit("(?)")))
               .when((s["skip"] > 0), s["out"])
               .otherwise(F.concat(s["out"], t)))
        skip = F.when(enters, depth).when(leaves, F.lit(0)).otherwise(s["skip"])
        armed = t.rlike(r'(?:^|[^a-z0-9_$"])in ?\z')
        return F.struct(out.alias("out"), depth.cast("int").alias("depth"),
                        skip.cast("int").alias("skip"), armed.alias("armed"))

    return F.aggregate(parts, start, step, lambda s: s["out"])


# The same lexical units for texts without comments and quoted identifiers, where strings, then
# numbers, then words can be told apart by three replacements over the whole text.
_PLAIN_STRING = r"(?s)'(?:[^'\\]|''|\\.)*+(?:'|\\?\z)"
_PLAIN_NUMBER = r"(?:(?<![A-Za-z0-9_$])[0-9]|[.][0-9])[0-9.eE+-]*+"
_PLAIN_WORD = r"([A-Za-z_$][A-Za-z0-9_$]*+)"
_PLAIN_OPERATOR = rf"([^A-Za-z0-9_$ \t\n\r{_LITERAL}{_WORD}])"


def _mark_tokens(sql: Column) -> Column:
    return F.array_join(F.transform(F.regexp_extract_all(sql, F.lit(TOKEN), F.lit(0)), _piece), "")


def _mark_plain(sql: Column) -> Column:
    text = F.regexp_replace(sql, _PLAIN_STRING, _LITERAL)
    text = F.regexp_replace(text, _PLAIN_NUMBER, _LITERAL)
    text = F.regexp_replace(_ascii_lower(text), _PLAIN_WORD, f"{_WORD}$1")
    text = F.regexp_replace(text, _PLAIN_OPERATOR, f"{_OPERATOR}$1")
    return F.regexp_replace(F.regexp_replace(text, _LITERAL, _LITERAL + "?"), r"[\t\n\r]", " ")


def normalize_sql(sql: Column) -> Column:
    """One text per query shape: literals and IN lists become ``?``, comments vanish, case is folded."""
    text = F.when(sql.contains("--") | sql.contains("/*") | sql.contains('"'), _mark_tokens(sql)).otherwise(_mark_plain(sql))
    text = F.regexp_replace(text, rf"\({_LITERAL}", "(")
    text = F.regexp_replace(text, rf"({PUNCT}){_OPERATOR}", "$1")
    text = F.trim(F.regexp_replace(text, rf"[ {_LITERAL}{_WORD}{_OPERATOR}]+", " "))
    return _let(text, lambda t: F.rtrim(F.translate(
        F.when(t.rlike(r"(?:^|[^a-z0-9_$])in ?\("), _fold_in_lists(t)).otherwise(t), _INNER_BLANK, " ")))


def fingerprint_hash(normalized: Column) -> Column:
    return F.xxhash64(normalized)


# First keyword → statement type; CREATE/DROP are refined by the second word.
KEYWORD_TYPES = {
    "select": "SELECT", "insert": "INSERT", "update": "UPDATE", "delete": "DELETE",
    "create": "CREATE_TABLE", "alter": "ALTER_TABLE", "drop": "DROP_TABLE", "truncate": "TRUNCATE",
    "begin": "BEGIN", "start": "BEGIN", "commit": "COMMIT", "rollback": "ROLLBACK",
    "set": "SET", "show": "SHOW",
}
INDEX_TYPES = {"create": "CREATE_INDEX", "drop": "DROP_INDEX"}


def statement_type(sql: Column) -> Column:
    first = F.lower(F.regexp_extract(sql, r"^\s*([A-Za-z]+)", 1))
    second = F.lower(F.regexp_extract(sql, r"^\s*[A-Za-z]+\s*([A-Za-z]+)", 1))
    about_index = second.isin("index", "unique")
    out = F.when(about_index & (first == "create"), INDEX_TYPES["create"])
    out = out.when(about_index & (first == "drop"), INDEX_TYPES["drop"])
    for word, kind in KEYWORD_TYPES.items():
        out = out.when(first == word, kind)
    return out.otherwise("UNKNOWN")


def is_write(kind: Column) -> Column:
    return kind.isin(schemas.WRITE_STATEMENTS)


def is_dml(kind: Column) -> Column:
    return kind.isin(schemas.DML_STATEMENTS)


def is_ddl(kind: Column) -> Column:
    return kind.isin(schemas.DDL_STATEMENTS)


def is_txn(kind: Column) -> Column:
    return kind.isin(schemas.TXN_STATEMENTS)


def ddl_table_name(sql: Column) -> Column:
    """The name after the first ``table`` (else the first ``index on``), past IF [NOT] EXISTS."""
    name = r"\s*(?:if exists|if not exists)?\s*([^\s(;]+)"
    by_table = F.regexp_extract(sql, r"(?i)table" + name, 1)
    by_index = F.regexp_extract(sql, r"(?i)index on" + name, 1)
    return F.when(by_table != "", by_table).when(by_index != "", by_index).otherwise("unknown")


# --- decoding -------------------------------------------------------------------------------------

_QUOTED = r"""'[^']*(?:'|\z)|"[^"]*(?:"|\z)"""
_FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_ASCII = "".join(chr(c) for c in range(0x21, 0x7F))
# The named HTML entities that are decoded.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&amp;": "&", "&quot;": '"', "&apos;": "'"}


def fold_width(c: Column) -> Column:
    """Full-width forms U+FF01–U+FF5E → ASCII."""
    return F.translate(c, _FULL_WIDTH, _ASCII)


def _from_hex_pieces(tokens: Column, piece) -> Column:
    """Assemble text from tokens turned into hexadecimal byte strings; invalid UTF-8 is replaced."""
    return F.make_valid_utf8(F.unhex(F.array_join(F.transform(tokens, piece), "")).cast("string"))


def decode_hex_tokens(c: Column) -> Column:
    """``0x…`` of at least three printable bytes, outside quotes, → the text it spells."""
    tokens = F.regexp_extract_all(
        c, F.lit(rf"(?s){_QUOTED}|0[xX][0-9A-Fa-f]+|[^'\"0]+|."), F.lit(0))
    spelled = r"^0[xX](?:[2-6][0-9A-Fa-f]|7[0-9A-Ea-e]){3,}\z"
    return F.array_join(F.transform(tokens, lambda t: F.when(
        t.rlike(spelled), F.unhex(F.substr(t, F.lit(3))).cast("string")).otherwise(t)), "")


def _percent_pass(c: Column) -> Column:
    tokens = F.regexp_extract_all(c, F.lit(r"(?s)%[0-9A-Fa-f]{2}|[^%]+|%"), F.lit(0))
    decoded = _from_hex_pieces(tokens, lambda t: F.when(
        t.startswith("%") & (F.length(t) == 3), F.substr(t, F.lit(2))).otherwise(F.hex(t)))
    return F.when(c.contains("%"), decoded).otherwise(c)


def decode_encodings(c: Column) -> Column:
    """URL ``%XX`` and HTML entities once, then ``%XX`` again when something changed."""
    tokens = F.regexp_extract_all(c, F.lit(
        r"(?s)%[0-9A-Fa-f]{2}|&#[xX][0-9A-Fa-f]{1,4};|&#[0-9]{1,4};|&lt;|&gt;|&amp;|&quot;|&apos;|[^%&]+|."),
        F.lit(0))

    def piece(t: Column) -> Column:
        point = F.when(t.rlike("^&#[xX]"), F.conv(F.regexp_extract(t, "([0-9A-Fa-f]+);", 1), 16, 10)) \
            .when(t.rlike("^&#[0-9]"), F.regexp_extract(t, "([0-9]+);", 1)).cast("int")
        # Most tokens are plain text and end at the first test.
        out = F.when(~t.startswith("%") & ~t.startswith("&"), F.hex(t))
        out = out.when(t.startswith("%") & (F.length(t) == 3), F.substr(t, F.lit(2)))
        for entity, ch in ENTITIES.items():
            out = out.when(t == entity, F.lit(ch.encode().hex()))
        return out.when(t.startswith("&#"), _let(point, lambda p: F.when(
            p.between(1, 127), F.hex(F.char(p))).otherwise(F.hex(t)))).otherwise(F.hex(t))

    once = F.when(c.rlike("[%&]"), _from_hex_pieces(tokens, piece)).otherwise(c)
    return _let(once, lambda o: F.when(o != c, _percent_pass(o)).otherwise(o))
