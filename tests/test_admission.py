"""What a governed query may be made of: probes that must be refused, ordinary queries that must pass, random plans."""

import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from govspark.operators import admission, governance
from govspark.operators.governance import AccessDenied
from govspark.runtime import local_frame
from tests.conftest import SMALL
from tests.test_governance import run


@pytest.fixture(scope="module")
def secrets(spark):
    local_frame(spark, [(1, "hidden")], "id int, word string").createOrReplaceTempView("secret_v")
    local_frame(spark, [(1, "hidden")], "id int, word string").createOrReplaceGlobalTempView("secret_g")
    return "secret_v"


FILE = f"parquet.`{SMALL}/orders.parquet`"
PROBES = [
    # programs, files and tables behind names that are made when the text is parsed
    "SELECT TRANSFORM(c_custkey) USING 'id' AS a FROM customer",
    "SELECT a FROM (SELECT TRANSFORM(c_custkey) USING 'cat /etc/passwd' AS a FROM customer)",
    "SELECT * FROM IDENTIFIER('sec' || 'ret_v')",
    f"SELECT * FROM IDENTIFIER('{FILE}')",
    "WITH x AS (SELECT * FROM IDENTIFIER('secret_v')) SELECT * FROM x",
    "SELECT (SELECT max(word) FROM IDENTIFIER('secret_v')) FROM customer",
    "SELECT * FROM customer WHERE c_custkey IN (SELECT id FROM IDENTIFIER('secret_v'))",
    "SELECT IDENTIFIER('reflect')('java.lang.System', 'getProperty', 'user.home') FROM customer",
    "SELECT IDENTIFIER('c_custkey') FROM customer",
    "EXECUTE IMMEDIATE 'SELECT * FROM secret_v'",
    "EXECUTE IMMEDIATE 'SELECT count(*) FROM secret_v' INTO x",
    "BEGIN SELECT 1; END",
    # commands
    "ALTER TABLE secret_v RENAME TO s2", "COMMENT ON TABLE secret_v IS 'x'", "CREATE OR REPLACE TABLE x AS SELECT 1", "REPAIR TABLE x",
    "CALL system.f()", "DECLARE VARIABLE v INT DEFAULT 1", "SET VAR v = 1", "EXPLAIN SELECT 1", "DESCRIBE customer", "REFRESH TABLE customer",
    "CACHE TABLE customer", "ANALYZE TABLE customer COMPUTE STATISTICS", "ADD JAR '/tmp/x.jar'", "LIST FILES", "CREATE TEMPORARY FUNCTION f AS 'x.Y'",
    "MERGE INTO customer USING customer s ON false WHEN MATCHED THEN DELETE", "UPDATE customer SET c_name = 'x'", "DELETE FROM customer",
    "INSERT OVERWRITE DIRECTORY '/tmp/x' USING parquet SELECT * FROM customer", "FROM customer INSERT INTO x SELECT *", "TRUNCATE TABLE customer",
    # relations
    "SELECT * FROM secret_v", "SELECT * FROM global_temp.secret_g", f"SELECT * FROM {FILE}", "SELECT * FROM spark_catalog.default.secret",
    "SELECT * FROM customer VERSION AS OF 1", "SELECT * FROM customer TIMESTAMP AS OF '2020-01-01'", "SELECT * FROM STREAM customer",
    "SELECT * FROM customer WITH ('path' = '/etc')", "SELECT * FROM range(3)", "SELECT * FROM explode(array(1))", "SELECT * FROM sql_keywords()",
    "SELECT * FROM python_data_source()", "SELECT * FROM customer, LATERAL range(3)", "TABLE secret_v",
    "WITH c AS (SELECT 1 AS a) SELECT * FROM (SELECT * FROM c) JOIN (WITH d AS (SELECT 1) SELECT * FROM secret_v)",
    # functions
    "SELECT reflect('java.lang.System', 'getProperty', 'user.home')", "SELECT try_reflect('java.lang.System', 'exit', 1)",
    "SELECT input_file_name() FROM customer", "SELECT current_user()", "SELECT current_user", "SELECT version()", "SELECT current_catalog()",
    "SELECT transform(array(1), x -> java_method('java.lang.System', 'getenv', 'HOME'))", "SELECT spark_partition_id() FROM customer",
    "SELECT sum(c_custkey) FILTER (WHERE input_file_name() = 'x') FROM customer", "SELECT count(*) OVER (ORDER BY input_file_name()) FROM customer",
    "SELECT c_name FROM customer ORDER BY input_file_name()", "SELECT c_name FROM customer GROUP BY c_name HAVING max(input_file_name()) > ''",
    "SELECT c FROM customer LATERAL VIEW explode(array(input_file_name())) e AS c", "SELECT * FROM VALUES (input_file_name()) AS v(a)",
    "SELECT spark_catalog.default.f(1)", "SELECT nowhere(1)", "SELECT :p", "SELECT from_protobuf(c_name, 'm', '/etc/passwd') FROM customer",
    "SELECT from_xml(c_name, 'a int', map('rowValidationXSDPath', '/etc/passwd')) FROM customer",
    "SELECT assert_true(false)", "SELECT raise_error('x')", "FROM customer |> SELECT input_file_name()", "FROM secret_v |> SELECT word",
]


@pytest.mark.parametrize("sql", PROBES)
def test_refused(spark, secrets, sql):
    with pytest.raises(AccessDenied):
        run(spark, sql)


def test_the_text_is_not_expanded(spark, monkeypatch):
    """Variables of the environment, the JVM and the session stay text."""
    home = spark._jvm.java.lang.System.getenv("HOME")
    assert home and os.environ["HOME"] == home
    for name in ("env:HOME", "system:user.home", "spark.app.name"):
        assert run(spark, "SELECT '${" + name + "}' AS v").df.first().v == "${" + name + "}"
    assert spark.sql("SELECT '${env:HOME}' AS v").first().v == home  # the caller's session is left as it was


def test_variables_of_the_session_are_not_there(spark):
    spark.sql("DECLARE OR REPLACE VARIABLE hidden_word STRING DEFAULT 'hidden'")
    with pytest.raises(Exception, match="hidden_word|UNRESOLVED"):
        run(spark, "SELECT hidden_word FROM customer")
    spark.sql("DROP TEMPORARY VARIABLE hidden_word")


ORDINARY = [
    "SELECT c_custkey + 1, -c_custkey, c_custkey % 3, c_custkey DIV 2, c_custkey & 1 | 2 ^ 3, ~c_custkey, c_name || 'x' FROM customer",
    "SELECT * EXCEPT (c_name) FROM customer WHERE c_custkey BETWEEN 1 AND 9 AND c_name LIKE '%a%' AND NOT c_name RLIKE 'zz' OR c_custkey IN (1, 2)",
    "SELECT * FROM customer WHERE c_name ILIKE ANY ('%a%', 'b') AND c_name IS NOT NULL AND (c_custkey > 1) IS NOT UNKNOWN AND c_name NOT LIKE ALL ('q', 'z')",
    "SELECT CASE WHEN c_custkey > 1 THEN 'a' ELSE 'b' END, CAST(c_custkey AS STRING), try_cast(c_name AS INT), c_custkey::double, coalesce(c_name, ''), nullif(1, 2), nvl(c_name, 'x'), if(true, 1, 2) FROM customer",
    "SELECT upper(c_name), lpad(c_name, 9, '*'), rpad('a', 3, 'b'), trim(BOTH 'x' FROM c_name), substring(c_name FROM 2 FOR 3), position('a' IN c_name), overlay(c_name PLACING 'x' FROM 2), startswith(c_name, 'a'), contains(c_name, 'b'), mask(c_name), split(c_name, ','), regexp_replace(c_name, 'a', 'b'), format_string('%s', c_name), to_char(12, '99') FROM customer",
    "SELECT o_orderdate, date_trunc('month', o_orderdate), extract(YEAR FROM o_orderdate), year(o_orderdate), to_date('2020-01-01'), current_date(), now() IS NULL, date_add(o_orderdate, 3), datediff(o_orderdate, DATE '2020-01-01'), o_orderdate + INTERVAL 1 DAY, make_date(2020, 1, 1), timestampadd(HOUR, 1, TIMESTAMP '2020-01-01'), timestampdiff(DAY, TIMESTAMP '2020-01-01', TIMESTAMP '2020-01-02'), hour(TIMESTAMP '2020-01-01'), to_timestamp('2020-01-01'), unix_timestamp('2020-01-01', 'yyyy-MM-dd'), TIMESTAMP '2020-01-02' - TIMESTAMP '2020-01-01' FROM orders",
    "SELECT round(o_totalprice, 2), ceil(o_totalprice), floor(o_totalprice, 1), abs(-1), sqrt(4), power(2, 3), greatest(1, 2), rand(1) < 2, bround(2.5), 1.5BD * 2, 1e3, X'1F' FROM orders",
    "SELECT c_nationkey, count(*), count(DISTINCT c_custkey), sum(c_custkey) FILTER (WHERE c_custkey > 3), max_by(c_custkey, c_name), collect_list(c_custkey), percentile(c_custkey, 0.5), percentile_cont(0.5) WITHIN GROUP (ORDER BY c_custkey), listagg(c_name, ',') , approx_count_distinct(c_name), stddev(c_custkey), first(c_name), bool_or(true), count_if(true) FROM customer GROUP BY 1 HAVING count(*) > 0 ORDER BY 2 DESC LIMIT 5 OFFSET 1",
    "SELECT c_nationkey, grouping(c_nationkey), count(*) FROM customer GROUP BY GROUPING SETS ((c_nationkey), ())",
    "SELECT c_nationkey, c_mktsegment, grouping_id(), count(*) FROM customer GROUP BY CUBE (c_nationkey, c_mktsegment)",
    "SELECT c_nationkey, count(*) FROM customer GROUP BY ROLLUP (c_nationkey)",
    "SELECT c_custkey, sum(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), rank() OVER w, lag(c_custkey) OVER w, ntile(3) OVER w, sum(c_custkey) OVER (ORDER BY c_custkey RANGE BETWEEN 2 PRECEDING AND 1 FOLLOWING) FROM customer WINDOW w AS (ORDER BY c_custkey)",
    "SELECT * FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey LEFT JOIN orders p USING (o_orderkey)",
    "SELECT * FROM customer NATURAL JOIN customer", "SELECT c.c_custkey FROM customer c LEFT SEMI JOIN orders o ON c.c_custkey = o.o_custkey",
    "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey < 3) AND c_custkey > (SELECT min(o_custkey) FROM orders)",
    "SELECT c_custkey, x.n FROM customer c, LATERAL (SELECT count(*) AS n FROM orders o WHERE o.o_custkey = c.c_custkey) x",
    "SELECT c_custkey FROM customer UNION ALL SELECT o_custkey FROM orders UNION SELECT 1", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders INTERSECT SELECT 3",
    "WITH a AS (SELECT * FROM customer), b AS (SELECT c_custkey FROM a) SELECT * FROM b JOIN a USING (c_custkey)",
    "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 3) SELECT * FROM r",
    "SELECT * FROM (SELECT c_nationkey, c_mktsegment, c_custkey FROM customer) PIVOT (sum(c_custkey) FOR c_mktsegment IN ('FURNITURE', 'BUILDING'))",
    "SELECT * FROM (SELECT c_custkey, c_nationkey FROM customer) UNPIVOT (v FOR k IN (c_custkey, c_nationkey))",
    "SELECT e, pos FROM customer LATERAL VIEW posexplode(array(1, 2)) t AS pos, e", "SELECT explode(sequence(1, c_nationkey + 1)), c_name FROM customer", "SELECT inline(array(struct(1 AS a, 2 AS b)))", "SELECT stack(2, 1, 2)",
    "SELECT transform(array(1, 2), x -> x + 1), filter(map_values(map('a', 1)), v -> v > 0), aggregate(array(1), 0, (a, x) -> a + x), array_sort(array(2, 1)), map('a', 1)['a'], array(1)[0], named_struct('f', 1).f, size(array(1)), element_at(array(1), 1), slice(array(1, 2), 1, 1), exists(array(1), x -> x = 1)",
    "SELECT from_json('{\"a\":1}', 'a int').a, to_json(struct(1 AS a)), get_json_object('{}', '$.a'), parse_json('{\"a\":1}'):a::int, variant_get(parse_json('[1]'), '$[0]', 'int'), from_csv('1', 'a int'), xpath_string('<a>b</a>', 'a')",
    "SELECT md5('a'), sha2('a', 256), xxhash64(1), crc32('a'), base64('a'), hex(1), parse_url('http://a/b', 'HOST'), url_encode('a'), uuid() IS NULL, typeof(1), 'a' COLLATE UTF8_LCASE = 'A'",
    "SELECT /*+ BROADCAST(c) */ DISTINCT c_nationkey FROM customer TABLESAMPLE (50 PERCENT) c DISTRIBUTE BY c_nationkey SORT BY c_nationkey",
    "VALUES (1, 'a'), (2, 'b')", "SELECT * FROM VALUES (1, abs(-2)) AS v(a, b)", "TABLE customer", "FROM customer |> WHERE c_custkey > 1 |> SELECT c_custkey, c_nationkey |> AGGREGATE count(*) AS n GROUP BY c_nationkey |> ORDER BY n |> LIMIT 2",
    "SELECT window.start, count(*) FROM orders GROUP BY window(o_orderdate, '30 days')", "SELECT c_custkey AS a, a + 1 AS b FROM customer ORDER BY ALL",
    "SELECT c_nationkey, any_value(c_name) IGNORE NULLS FROM customer GROUP BY ALL",
]


@pytest.mark.parametrize("sql", ORDINARY)
def test_ordinary_queries_pass(spark, secrets, sql):
    assert run(spark, sql).df.columns


# Random plans: pieces that are allowed and pieces that are not, at random places of random queries.
GOOD = ["c_custkey", "upper(c_name)", "c_custkey + 1", "(SELECT max(o_custkey) FROM orders)", "CASE WHEN c_custkey > 1 THEN 1 END", "transform(array(1), x -> x)"]
BAD = ["input_file_name()", "reflect('java.lang.System', 'lineSeparator')", "IDENTIFIER('abs')(1)", "current_user()", "(SELECT max(word) FROM secret_v)",
       "(SELECT max(word) FROM IDENTIFIER('secret_v'))", "transform(array(1), x -> java_method('java.lang.System', 'lineSeparator'))"]
FROM_GOOD = ["customer", "(SELECT * FROM customer WHERE c_custkey > 0)", "customer LEFT JOIN orders ON c_custkey = o_custkey"]
FROM_BAD = ["customer JOIN secret_v ON true", "customer, LATERAL (SELECT word FROM secret_v)", "(SELECT TRANSFORM(*) USING 'cat' AS (c_custkey, c_name) FROM customer)",
            "customer JOIN range(3) ON true", f"customer JOIN {FILE} ON true"]
SHAPES = ["SELECT {0} AS a FROM {1}", "SELECT c_custkey FROM {1} WHERE {0} IS NOT NULL", "SELECT max({0}) AS a FROM {1} GROUP BY c_custkey", "SELECT c_custkey FROM {1} ORDER BY {0}",
          "SELECT a FROM (SELECT {0} AS a FROM {1}) UNION ALL SELECT 'x'", "WITH q AS (SELECT {0} AS a FROM {1}) SELECT * FROM q", "SELECT c_custkey FROM {1} WHERE EXISTS (SELECT {0} FROM customer)",
          "SELECT count(*) OVER (PARTITION BY {0}) FROM {1}", "SELECT e FROM {1} LATERAL VIEW explode(array({0})) t AS e"]


@settings(max_examples=40, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.sampled_from(SHAPES), st.sampled_from(GOOD + BAD), st.sampled_from(FROM_GOOD + FROM_BAD))
def test_random_plans(spark, secrets, shape, expression, relation):
    sql = shape.format(expression, relation)
    if expression in BAD or relation in FROM_BAD:
        with pytest.raises(AccessDenied):
            run(spark, sql)
    else:
        try:
            run(spark, sql)
        except AccessDenied:
            raise
        except Exception as e:  # a query that Spark itself does not accept proves nothing
            assert "AnalysisException" in type(e).__name__ or "ParseException" in type(e).__name__


def test_analyzed_plan_must_read_secured_views_only(spark, secrets):
    """The second proof stands without the first."""
    for sql in ("SELECT * FROM secret_v", "SELECT * FROM global_temp.secret_g", f"SELECT * FROM {FILE}", "SELECT * FROM range(3)", "SELECT 1 WHERE EXISTS (SELECT * FROM secret_v)"):
        with pytest.raises(AccessDenied):
            admission.prove_analyzed(spark.sql(sql), {"customer"})
    with pytest.raises(AccessDenied):
        admission.prove_analyzed(spark.sql("SELECT reflect('java.lang.System', 'lineSeparator')"), set())
    admission.prove_analyzed(spark.sql("SELECT word, upper(word) FROM secret_v"), {"secret_v"})


def test_row_guard_runs_the_query_once(spark):
    counted = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            counted.add(b.num_rows)
            yield b

    rows = spark.range(0, 40, 1, 4).mapInArrow(seen, "id long")
    assert sorted(r.id for r in governance.max_rows_guard(rows, 40).collect()) == list(range(40)) and counted.value == 40
    with pytest.raises(governance.ResultTooLarge, match="more than 39 rows"):
        governance.guarded(governance.max_rows_guard(rows, 39).collect)
    ordered = governance.max_rows_guard(spark.range(100).orderBy(spark.range(1).select("id").columns[0], ascending=False), 100)
    assert [r.id for r in ordered.collect()] == list(range(99, -1, -1))
    small = local_frame(spark, [(1,), (2,)], "id long").union(local_frame(spark, [(3,)], "id long"))
    assert governance.max_rows_guard(small, 3).count() == 3
    with pytest.raises(governance.ResultTooLarge):
        governance.guarded(governance.max_rows_guard(small, 2).collect)
    with pytest.raises(ZeroDivisionError):
        governance.guarded(lambda: 1 / 0)
