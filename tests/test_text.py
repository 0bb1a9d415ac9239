"""Fingerprints, injection signatures, decoding and recognisers on known cases."""

import random

import pytest
from pyspark.sql import functions as F

from govspark.functions import injection, recognizers, sqltext
from govspark.operators import classify
from govspark.runtime import local_frame

PUNCT = set("!\"#%&'()*+,-./:;<=>?@[\\]^`{|}~")
SPACE = set(" \t\n\r")
START = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_$")


def normalize(sql):
    """The rules read one character at a time."""
    out, i, n = "", 0, len(sql)
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    gap = lambda: bool(out) and not out.endswith(" ")
    while i < n:
        c, two = sql[i], sql[i:i + 2]
        if two == "/*" or two == "--":
            stops = [p for p in ((sql.find("*/", i + 2),) if two == "/*" else (sql.find("\n", i), sql.find("\r", i))) if p >= 0]
            end = min(stops) if stops else n
            i = end + (2 if two == "/*" else 1) if stops else n
            if gap():
                out += " "
        elif c == "'":
            i += 1
            while i < n:
                if sql[i] == "\\":
                    i += 2
                elif sql[i:i + 2] == "''":
                    i += 2
                elif sql[i] == "'":
                    break
                else:
                    i += 1
            i += 1
            out += (" " if gap() and not out.endswith("(") else "") + "?"
        elif c == '"':
            body, i = "", i + 1
            while i < n and sql[i] != '"':
                if sql[i] == "\\":
                    i += 2
                else:
                    body, i = body + sql[i], i + 1
            closed = i < n
            i += 1
            out += (" " if gap() else "") + '"' + lower(body) + ('"' if closed else "")
        elif c in "0123456789" or (c == "." and i + 1 < n and sql[i + 1] in "0123456789"):
            i += 1
            while i < n and sql[i] in "0123456789.eE+-":
                i += 1
            out += (" " if gap() and not out.endswith("(") else "") + "?"
        elif c in START:
            j = i
            while j < n and (sql[j] in START or sql[j] in "0123456789"):
                j += 1
            out += (" " if gap() else "") + lower(sql[i:j])
            i = j
        elif c in SPACE:
            if gap():
                out += " "
            i += 1
        else:
            out += (" " if gap() and out[-1] not in PUNCT else "") + c
            i += 1
    return out.strip(" ")


CASES = ["SELECT * FROM Users WHERE id = 42", "select a from t where x='it''s' and y = 'a\\'b'", "SELECT /* c */ 1 -- x\n, \"My Col\"  FROM t",
         "SELECT 'unterminated", "select 1-2, .5, a.5, 1e5x, t1.c2 from x1", "a<=b and c<>d or (1)=( 2)", "x\ty\r\nz", "", "   ", "-- only", "/* open",
         "select \"A b\\\"c\" , 'x' from t", "select $1, ?, :p from t", "Ünï = 'é'", "f(a,b)(1)", "1'2'3"]


def normalized(spark, texts):
    df = local_frame(spark, list(enumerate(texts)), "i int, s string")
    return [r.n for r in df.select("i", sqltext.normalize_sql(F.col("s")).alias("n")).orderBy("i").collect()]


def test_fingerprints_follow_the_rules(spark):
    rnd = random.Random(5)
    bits = ["select", "X1", "'a'", "''", "12", ".5", "(", ")", ",", " ", "  ", "\n", "--", "/*", "*/", '"', "Q q", "=", "<", ">", "-", "e", "$", "\\", "é", "."]
    texts = CASES + ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 14))) for _ in range(1500)]
    texts = [t for t in texts if "in" not in t.lower()]
    got, want = normalized(spark, texts), [normalize(t) for t in texts]
    bad = [(t, g, w) for t, g, w in zip(texts, got, want) if g != w]
    assert not bad, bad[:5]


def test_in_lists(spark):
    got = normalized(spark, ["SELECT * FROM u WHERE id IN (1, 2,3)", "select 1 where a in (select b from c where d in (1,(2))) and e IN ('x')",
                             "select sin (1), min(2) from t", "x not in(((1)),2) or y in (3"])
    assert got == ["select * from u where id in (?)", "select ? where a in (?) and e in (?)", "select sin (?), min (?) from t", "x not in (?) or y in (?)"]


def test_long_texts_are_whole(spark):
    big = "select '" + "x''" * 30000 + "' from t where a in (" + ",".join(map(str, range(20000))) + ") and b = 7"
    assert normalized(spark, [big]) == ["select ? from t where a in (?) and b = ?"]


@pytest.mark.parametrize("sql, patterns, level", [
    ("SELECT * FROM users WHERE id = 1 OR 1=1", {"TAUTOLOGY"}, "HIGH"),
    ("SELECT * FROM users WHERE name = '' OR 'a'='a'", {"TAUTOLOGY"}, "HIGH"),
    ("SELECT 1 WHERE x OR true", {"TAUTOLOGY"}, "HIGH"),
    ("SELECT 1 UNION SELECT password FROM users", {"UNION_INJECTION"}, "CRITICAL"),
    ("SELECT 1 UNION ALL SELECT 2", {"UNION_INJECTION"}, "CRITICAL"),
    ("SELECT * FROM users WHERE name = 'admin' --", {"COMMENT_BYPASS"}, "MEDIUM"),
    ("UN/**/ION SE/**/LECT 1", {"COMMENT_OBFUSCATION", "COMMENT_KEYWORD_SPLIT"}, "CRITICAL"),
    ("SELECT 1; DROP TABLE users", {"STACKED_QUERIES"}, "HIGH"),
    ("SELECT 1;  ", set(), "NONE"), ("SELECT ';x' AS a", set(), "NONE"),
    ("SELECT pg_sleep(5)", {"TIME_BASED_BLIND"}, "HIGH"), ("SELECT SLEEP (5)", {"TIME_BASED_BLIND"}, "HIGH"),
    ("WAITFOR DELAY '0:0:5'", {"TIME_BASED_BLIND"}, "HIGH"), ("SELECT benchmark(1,2)", {"TIME_BASED_BLIND"}, "HIGH"),
    ("SELECT extractvalue(1, 2)", {"ERROR_BASED"}, "MEDIUM"), ("SELECT 'extractvalue(1)'", set(), "NONE"),
    ("SELECT exp(~1)", {"ERROR_BASED"}, "MEDIUM"),
    ("x 0x756E696F6E2073656C656374 y", {"HEX_ENCODING_BYPASS"}, "CRITICAL"),
    ("ＤＲＯＰ ＴＡＢＬＥ users", {"STACKED"} - {"STACKED"}, "NONE"),
    ("ＤＲＯＰ TABLE users", {"UNICODE_FULLWIDTH_BYPASS"}, "CRITICAL"),
    ("%31%20OR%20%31%3D%31", {"ENCODING_BYPASS", "TAUTOLOGY"}, "HIGH"),
    ("%2531%2520OR%2520%2531%253D%2531", {"ENCODING_BYPASS", "TAUTOLOGY"}, "HIGH"),
    ("SELECT id FROM t WHERE x=3 &#85;NION&#32;SELECT password FROM users", {"ENCODING_BYPASS", "UNION_INJECTION", "STACKED_QUERIES"}, "CRITICAL"),
    ("SELECT id, name FROM customers WHERE id = 42", set(), "NONE"), ("", set(), "NONE"),
])
def test_injection(spark, sql, patterns, level):
    r = injection.scan_injection(local_frame(spark, [(sql,)], "sql string")).first()
    if sql.startswith("ＤＲＯＰ ＴＡＢＬＥ"):
        patterns, level = {"UNICODE_FULLWIDTH_BYPASS"}, "CRITICAL"
    assert set(r.injection_patterns) == patterns and r.threat_level == level and r.should_block == (level in ("HIGH", "CRITICAL"))


def test_decoding(spark):
    texts = ["a%20b", "%zz%4", "&lt;&gt;&amp;&quot;&apos;", "&#x41;&#66;&#300;&#0;", "%2541", "%C3%A9", "plain", "%FF", "&#65"]
    df = local_frame(spark, list(enumerate(texts)), "i int, s string").select("i", sqltext.decode_encodings(F.col("s")).alias("d"))
    assert [r.d for r in df.orderBy("i").collect()] == ["a b", "%zz%4", "<>&\"'", "AB&#300;&#0;", "A", "é", "plain", "�", "&#65"]
    hexed = local_frame(spark, [("0x414243 '0x414243' 0x4142 0x0102FF 0x41424",)], "s string").select(sqltext.decode_hex_tokens(F.col("s")))
    assert hexed.first()[0] == "ABC '0x414243' 0x4142 0x0102FF 0x41424"


def test_statements(spark):
    df = local_frame(spark, [("  create unique index i on t(a)",), ("DROP INDEX i",), ("start transaction",), ("12",), ("create table if not exists Foo(a int)",),
                             ("alter table Bar;",), ("create index on baz (x)",)], "s string")
    got = [tuple(r) for r in df.select(sqltext.statement_type(F.col("s")), sqltext.ddl_table_name(F.col("s"))).collect()]
    assert got == [("CREATE_INDEX", "unknown"), ("DROP_INDEX", "unknown"), ("BEGIN", "unknown"), ("UNKNOWN", "unknown"), ("CREATE_TABLE", "Foo"),
                   ("ALTER_TABLE", "Bar"), ("CREATE_INDEX", "baz")]


@pytest.mark.parametrize("value, cls", [
    ("4111111111111111", "PII.CreditCard"), ("4111-1111 1111-1111", "PII.CreditCard"), ("4111111111111112", "None"),
    ("123-45-6789", "PII.SSN"), ("000-12-3456", "None"), ("666-12-3456", "None"), ("900-12-3456", "None"), ("123-00-6789", "None"), ("123-45-0000", "None"),
    ("a.b+c@x-y.org", "PII.Email"), ("a@b.c", "None"), ("a@b@c.org", "None"), ("@b.org", "None"), ("a@.org", "None"), ("é@b.org", "None"),
    ("555-123-4567", "PII.Phone"), ("+1 (555) 123-4567", "PII.Phone"), ("5551234567", "None"), ("555.123.4567", "None"), ("", "None"), (None, "None"),
    ("a@b.org\n", "None"), ("123-45-6789\n", "None")])
def test_recognizers(spark, value, cls):
    df = local_frame(spark, [(value,)], "v string")
    assert classify.recognize_values(df, "v").first().value_class == cls
    recognizers.register_sql(spark)
    r = spark.sql("SELECT is_card(v) c, is_ssn(v) s, is_email(v) e, is_phone(v) p FROM {d}", d=df).first()
    found = "PII.CreditCard" if r.c else "PII.SSN" if r.s else "PII.Email" if r.e else "PII.Phone" if r.p else "None"
    assert found == cls


@pytest.mark.parametrize("name, cls", [
    ("EMAIL", "PII.Email"), ("customer_email", "PII.Email"), ("client_ip_address", "PII.IpAddress"), ("home_address", "PII.Address"), ("pay", "Sensitive.Salary"),
    ("user_pwd", "Sensitive.Password"), ("id", None), ("passport_no", "PII.Passport"), ("cc_number", "PII.CreditCard"), ("social_security_number", "PII.SSN")])
def test_names(spark, name, cls):
    assert classify.class_of_name(name) == cls
    assert local_frame(spark, [(name,)], "n string").select(classify.name_class(F.col("n"))).first()[0] == cls


def test_classify_threshold_and_sample(spark):
    df = local_frame(spark, [(i, "x@y.org" if i < 10 else "n/a", None if i else "555-123-4567") for i in range(21)], "id long, v string, w string")
    assert classify.classify_columns(df).collect() == []
    got = classify.classify_columns(df, sample=20, order=["id"]).collect()
    assert [(r.column, r.pii_type, r.confidence, r.strategy) for r in got] == [("v", "PII.Email", 0.8, "RegexValue")]
    assert classify.classify_columns(df.limit(0)).collect() == []


@pytest.mark.parametrize("text, cls, want", [
    ("4111111111111111 123", "PII.CreditCard", ["4111111111111111"]),
    ("4111 1111 1111 1111 12/27", "PII.CreditCard", ["4111 1111 1111 1111"]),
    ("no 12 4111-1111-1111-1111, yes", "PII.CreditCard", ["4111-1111-1111-1111"]),
    ("41111111111111110000000", "PII.CreditCard", []),
    ("x@y.corporation and a.b@c.org.", "PII.Email", ["a.b@c.org"]),
    ("123 45 6789, 123-45-6789, 123-45-67890", "PII.SSN", ["123 45 6789", "123-45-6789"]),
])
def test_spans_end_where_they_should(spark, text, cls, want):
    from govspark.operators import classify
    row = classify.scan_text(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert {p.pii_type: list(p.spans) for p in row.pii}[cls] == want


def test_pii_scan_agrees_with_its_sql_on_neighbouring_spans(spark, tmp_path):
    import duckdb

    from govspark.plans import registry
    texts = ["a@x.com b@y.com", "a@x.com,b@y.com;  c@z.org", "123-45-6789 234-56-7891", "4111-1111-1111-1111 5500-0000-0000-0004",
             "4111111111111111 5500000000000004", "3782 822463 10005,3714 496353 98431\n", "a@x.com\nb@y.com\n", "", None]
    rows = [(i, t, f"s{i}") for i, t in enumerate(texts)]
    local_frame(spark, rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in registry.load()["pii_scan_text"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == set(con.execute(registry.ORACLES["pii_scan_text"]).fetchall())
    # The operator itself finds both of two that share a neighbour.
    pii = classify.scan_text(spark.createDataFrame([(texts[0],)], "t string"), "t").first().pii
    assert {p.pii_type: list(p.spans) for p in pii}["PII.Email"] == ["a@x.com", "b@y.com"]
