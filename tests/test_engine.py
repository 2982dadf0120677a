import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tamarack.engine.check import analyse, builtin_functions, split_statements
from tamarack.engine.execute import database_fingerprint, execute, ordered_fingerprint, projection_matches, result_fingerprint, table_fingerprint
from tamarack.engine.repair import FixedGenerator, Service, extract_sql, repair_loop

KNOWN = ["orders", "nation"]


@pytest.fixture(scope="module")
def views(spark):
    found = {"orders": spark.range(20).selectExpr("id AS ord_id", "id % 3 AS k", "id * 1.5 AS total"), "nation": spark.createDataFrame([(1, "A"), (2, "B")], "id int, name string")}
    for name, df in found.items():
        df.createOrReplaceTempView(name)
    return found


BAD = {
    "DROP TABLE orders": "dangerous_sql",
    "delete from orders": "dangerous_sql",
    "INSERT INTO orders VALUES (1)": "dangerous_sql",
    "UPDATE orders SET k = 1": "dangerous_sql",
    "CREATE TABLE x AS SELECT 1": "dangerous_sql",
    "SET spark.sql.ansi.enabled=false": "dangerous_sql",
    "GRANT ALL ON orders TO x": "dangerous_sql",
    "/* x */ TRUNCATE TABLE orders": "dangerous_sql",
    "EXPLAIN SELECT 1": "dangerous_sql",
    "CACHE TABLE orders": "dangerous_sql",
    "SELECT 1; DROP TABLE orders": "multiple_statements",
    "SELECT 1; SELECT 2": "multiple_statements",
    "SELECT * FROM parquet.`/etc/passwd`": "unknown_table",
    "SELECT * FROM other": "unknown_table",
    "SELECT * FROM orders WHERE k IN (SELECT id FROM hidden)": "unknown_table",
    "WITH a AS (SELECT * FROM secret) SELECT * FROM a": "unknown_table",
    "SELECT reflect('java.lang.System', 'exit', 1)": "dangerous_sql",
    "SELECT (SELECT java_method('java.lang.Runtime', 'getRuntime'))": "dangerous_sql",
    "INSERT INTO orders SELECT * FROM nation": "dangerous_sql",
    "selec x": "unparseable",
    "": "unparseable",
    "-- only a comment": "unparseable",
}


@pytest.mark.parametrize("sql,reason", BAD.items())
def test_rejected(spark, views, sql, reason):
    assert analyse(spark, sql, KNOWN).failure_reason == reason
    assert not execute(spark, sql, KNOWN).ok


GOOD = ["SELECT * FROM orders", "select k, count(*) from Orders group by 1 having count(*) > 1 order by 2 desc limit 3;", "WITH a AS (SELECT k FROM orders) SELECT * FROM a UNION ALL SELECT id FROM nation", "SELECT o.*, rank() OVER (PARTITION BY k ORDER BY total) AS r FROM orders o LEFT JOIN nation n ON n.id = o.k WHERE EXISTS (SELECT 1 FROM nation)", "SELECT 'a;b' AS x FROM nation", "SELECT * FROM nation EXCEPT SELECT * FROM nation", "SELECT k, sum(total) FROM orders GROUP BY ROLLUP (k)", "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 5) SELECT * FROM r", "SELECT * FROM VALUES (1), (2) AS t(x)", "SELECT k FROM orders WHERE k BETWEEN 0 AND 2 AND k IS DISTINCT FROM 1 AND cast(k AS string) LIKE '2%'", "SELECT x FROM nation LATERAL VIEW explode(array(1, 2)) AS x", "SELECT percentile_cont(0.5) WITHIN GROUP (ORDER BY total) FROM orders", "SELECT * FROM (SELECT k, total FROM orders) PIVOT (sum(total) FOR k IN (0, 1))"]


@pytest.mark.parametrize("sql", GOOD)
def test_accepted(spark, views, sql):
    assert analyse(spark, sql, KNOWN).failure_reason is None
    assert execute(spark, sql, KNOWN).ok


def test_errors_are_classified(spark, views):
    assert execute(spark, "SELECT nope FROM orders").error_class == "unknown_column"
    assert execute(spark, "SELECT * FROM nope").error_class == "unknown_table"
    assert execute(spark, "SELECT 1 / (k - k) FROM orders").error_class == "division_by_zero"
    assert execute(spark, "SELECT FROM WHERE").ok is False
    assert execute(spark, "SELECT nofunc(1)").error_class == "unknown_function"


def test_fetch_is_bounded_and_time_limited(spark, views):
    out = execute(spark, "SELECT * FROM orders", max_rows=5)
    assert out.truncated and len(out.rows) == 5
    assert not execute(spark, "SELECT * FROM orders", max_rows=20).truncated
    slow = execute(spark, "SELECT sum(hash(a.id, b.id)) FROM range(3000000) a CROSS JOIN range(3000000) b", timeout_s=2)
    assert slow.error_class == "timeout"
    assert execute(spark, "SELECT 1 AS one").rows == [(1,)]


@given(st.lists(st.tuples(st.integers(), st.text(max_size=3))), st.randoms())
def test_fingerprint_ignores_order_only(rows, rng):
    mixed = list(rows)
    rng.shuffle(mixed)
    assert result_fingerprint(rows) == result_fingerprint(mixed)
    assert result_fingerprint([*rows, (0, "x")]) != result_fingerprint(rows)
    if mixed != rows:
        assert ordered_fingerprint(rows) != ordered_fingerprint(mixed)


def test_table_fingerprint(spark):
    rows = [(i % 7, None if i % 5 else "x") for i in range(100)]
    mixed = list(rows)
    random.Random(1).shuffle(mixed)
    make = lambda r, n: table_fingerprint(spark.createDataFrame(r, "a int, b string").repartition(n)).collect()[0]
    assert make(rows, 2) == make(mixed, 5) != make(rows[1:], 3)
    assert table_fingerprint(spark.createDataFrame([], "a int")).collect()[0].rows == 0


def test_projection(spark, views):
    gold = execute(spark, "SELECT name FROM nation")
    assert projection_matches(spark, "SELECT id, name FROM nation", ["name"], gold.fingerprint)
    assert not projection_matches(spark, "SELECT id FROM nation", ["name"], gold.fingerprint)


def test_extraction():
    assert extract_sql("<think>x</think>Here:\n```sql\nSELECT 1;\n```\nbye") == "SELECT 1"
    assert extract_sql("Sure. SELECT a FROM b; SELECT 2") == "SELECT a FROM b"
    assert extract_sql(None) == "" and extract_sql("<think>never") == ""
    assert split_statements("SELECT ';' -- ;\n; /* ; */ SELECT 2") == ["SELECT ';'", "SELECT 2"]


def test_one_repair(spark, views):
    asked = []
    fix = lambda q, s, p: asked.append(p) or "SELECT k FROM orders"
    out = repair_loop(spark, "SELECT nope FROM orders", "?", KNOWN, fix)
    assert out.repaired and len(asked) == 1 and "nope" in asked[0]
    stuck = repair_loop(spark, "SELECT nope FROM orders", "?", KNOWN, lambda q, s, p: s)
    assert not stuck.repaired and len(stuck.attempts) == 1


def test_service(spark, views):
    service = Service(spark, views, FixedGenerator({"how many?": "```sql\nSELECT count(*) AS n FROM orders\n```", "drop": "DROP TABLE orders"}, "SELECT name FROM nation"))
    assert service.answer("how many?").rows == [["20"]]
    bad = service.answer("drop", repair=False)
    assert not bad.ok and bad.problem == "dangerous_sql" and bad.rows == []
    assert service.answer("drop").repaired
    assert service.answer("names", max_rows=1).truncated
    assert service.health()["ok"]
    with pytest.raises(ValueError):
        service.answer(" ")
    with pytest.raises(ValueError):
        service.answer("x", max_rows=5000)
    assert database_fingerprint(views) == database_fingerprint(dict(reversed(views.items())))


def test_registered_functions_are_no_part_of_the_allowlist(spark, views):
    spark.udf.register("plus_one", lambda x: x + 1, "int")
    assert analyse(spark, "SELECT plus_one(1)", KNOWN).failure_reason == "dangerous_sql"
    assert analyse(spark, "SELECT upper('a'), nofunc(1)", KNOWN).failure_reason is None
    assert {"upper", "explode", "range"} <= builtin_functions(spark)


def test_reasons_come_in_order(spark, views):
    assert analyse(spark, "SELEC 1; DROP TABLE orders", KNOWN).failure_reason == "unparseable"
    assert analyse(spark, "DROP TABLE orders; SELECT * FROM other", KNOWN).failure_reason == "multiple_statements"
    assert analyse(spark, "SELECT reflect('a', 'b') FROM other", KNOWN).failure_reason == "dangerous_sql"


def test_fingerprints_tell_the_whole_of_a_longer_result(spark, views):
    run = lambda sql: execute(spark, sql, max_rows=100)
    up, down, few = run("SELECT id FROM range(5000)"), run("SELECT id FROM range(5000) ORDER BY id DESC"), run("SELECT id FROM range(5000) LIMIT 101")
    assert up.truncated and len(up.rows) == 100 and up.fingerprint == down.fingerprint != few.fingerprint
    again = run("SELECT id FROM range(5000) ORDER BY -id")
    assert down.ordered_fingerprint == again.ordered_fingerprint != run("SELECT id FROM range(5000) ORDER BY id").ordered_fingerprint
    assert projection_matches(spark, "SELECT id, id + 1 AS b FROM range(5000) ORDER BY id DESC", ["id"], up.fingerprint, 100)
    assert not projection_matches(spark, "SELECT a.id, b.id AS b FROM range(3000000) a CROSS JOIN range(3000000) b", ["id"], up.fingerprint, 100, timeout_s=2)
