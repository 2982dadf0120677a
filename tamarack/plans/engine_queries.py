"""Queries over fixed tables of statements: checked, run, repaired and scored by the engine.

The statements are the data here, some thirty of them; each runs over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tamarack.engine.check import analyse
from tamarack.engine.execute import execute, projection_matches
from tamarack.engine.repair import extract_sql, repair_loop
from tamarack.evaluation.score import Example, failure_bucket, rescore, run_benchmark
from tamarack.sources.tables import table

#: The views that statements may read, and the stored tables behind them.
VIEWS = {"g_nation": "nation", "g_region": "region", "g_orders": "orders", "g_customer": "customer"}

#: Statement, reason why it may not run (None where it may), tables it reads.
CHECKED: list[tuple[str, str | None, str]] = [
    ("SELECT n_name FROM g_nation", None, "g_nation"),
    ("select o_orderstatus, count(*) from G_ORDERS group by 1 having count(*) > 1 order by 2 desc limit 3;", None, "g_orders"),
    ("WITH a AS (SELECT * FROM g_nation) SELECT * FROM a JOIN g_region ON r_regionkey = n_regionkey", None, "g_nation,g_region"),
    ("SELECT rank() OVER (ORDER BY n_name) AS place FROM g_nation WHERE EXISTS (SELECT 1 FROM g_region)", None, "g_nation,g_region"),
    ("SELECT 'a;b' AS x", None, ""),
    ("DROP TABLE g_orders", "dangerous_sql", ""),
    ("DELETE FROM g_orders", "dangerous_sql", ""),
    ("UPDATE g_orders SET o_orderstatus = 'x'", "dangerous_sql", ""),
    ("INSERT INTO g_customer (c_name) VALUES ('injected')", "dangerous_sql", ""),
    ("TRUNCATE TABLE g_customer", "dangerous_sql", ""),
    ("ALTER TABLE g_customer ADD COLUMN pwned STRING", "dangerous_sql", ""),
    ("CREATE TABLE evil (x INT)", "dangerous_sql", ""),
    ("GRANT ALL ON g_customer TO PUBLIC", "dangerous_sql", ""),
    ("DROP DATABASE somewhere", "dangerous_sql", ""),
    ("SELECT 1; DROP TABLE g_customer", "multiple_statements", ""),
    ("SELECT * FROM g_customer; DELETE FROM g_orders", "multiple_statements", ""),
    ("SELECT 1; SELECT 2", "multiple_statements", ""),
    ("SELECT 1; SELEC 2", "unparseable", ""),
    ("SELECT reflect('java.lang.System', 'exit', 1)", "dangerous_sql", ""),
    ("SELECT input_file_name() FROM g_orders", "dangerous_sql", "g_orders"),
    ("SELECT current_user()", "dangerous_sql", ""),
    ("SELECT * FROM parquet.`/etc`", "unknown_table", "parquet./etc"),
    ("SELECT * FROM g_orders WHERE o_custkey IN (SELECT id FROM hidden)", "unknown_table", "g_orders,hidden"),
    ("WITH x AS (DELETE FROM g_orders RETURNING 1) SELECT * FROM x", "unparseable", ""),
    ("SELEC n_name FROM g_nation", "unparseable", ""),
    ("", "unparseable", ""),
    ("-- a comment", "unparseable", ""),
]

#: Name and statement; the SQL of the query counts the same rows by another engine.
RUN: list[tuple[str, str]] = [
    ("all nations", "SELECT * FROM g_nation"),
    ("orders by status", "SELECT o_orderstatus, count(*) AS n FROM g_orders GROUP BY o_orderstatus"),
    ("large orders", "SELECT o_orderkey FROM g_orders WHERE o_totalprice > 100000"),
    ("no such column", "SELECT nope FROM g_orders"),
    ("no such table", "SELECT * FROM nope"),
    ("no such function", "SELECT nofunc(n_name) FROM g_nation"),
    ("division", "SELECT n_nationkey / (n_nationkey - n_nationkey) FROM g_nation"),
    ("write", "DROP TABLE g_nation"),
]
_FETCH = 100

#: Name, first statement, the statement a generator gives when asked again.
REPAIRED: list[tuple[str, str, str]] = [
    ("sound", "SELECT n_name FROM g_nation", "SELECT 1"),
    ("wrong column", "SELECT name FROM g_nation", "SELECT n_name FROM g_nation"),
    ("wrong table", "SELECT n_name FROM nations", "SELECT n_name FROM g_nation"),
    ("stays wrong", "SELECT name FROM g_nation", "SELECT label FROM g_nation"),
    ("same again", "SELECT name FROM g_nation", "SELECT name FROM g_nation"),
    ("write", "DELETE FROM g_nation", "SELECT n_name FROM g_nation"),
]

#: Question, gold statement, raw reply, outcome, strict, right columns among others. Two examples share a question.
SCORED: list[tuple[str, str, str, str, bool | None, bool | None]] = [
    ("nations?", "SELECT n_name FROM g_nation", "```sql\nSELECT n_name FROM g_nation ORDER BY n_name DESC;\n```", "correct", None, None),
    ("nations?", "SELECT n_name, n_regionkey FROM g_nation", "SELECT n_name, n_regionkey FROM g_nation", "correct", None, None),
    ("sorted nations?", "SELECT n_name FROM g_nation ORDER BY n_name", "SELECT n_name FROM g_nation ORDER BY n_name DESC", "correct", False, None),
    ("again?", "SELECT n_name FROM g_nation ORDER BY n_name", "<think>easy</think> SELECT n_name FROM g_nation ORDER BY 1", "correct", True, None),
    ("more columns?", "SELECT n_name FROM g_nation", "SELECT n_name, n_nationkey FROM g_nation", "wrong_result", None, True),
    ("orders backwards?", "SELECT o_orderkey FROM g_orders", "SELECT o_orderkey FROM g_orders ORDER BY o_orderkey DESC", "correct", None, None),
    ("sorted orders?", "SELECT o_orderkey FROM g_orders ORDER BY o_orderkey", "SELECT o_orderkey FROM g_orders ORDER BY o_orderkey DESC", "correct", False, None),
    ("first orders?", "SELECT o_orderkey FROM g_orders ORDER BY o_orderkey", "SELECT o_orderkey FROM g_orders ORDER BY o_orderkey LIMIT 101", "wrong_result", False, False),
    ("orders and dates?", "SELECT o_orderkey FROM g_orders", "SELECT o_orderdate, o_orderkey FROM g_orders", "wrong_result", None, True),
    ("nothing?", "SELECT r_name FROM g_region", "I cannot tell.", "invalid_sql", None, False),
    ("silence?", "SELECT r_name FROM g_region", "<think>hm", "no_sql", None, None),
    ("write?", "SELECT r_name FROM g_region", "DROP TABLE g_region", "unsafe_sql", None, False),
    ("wrong column?", "SELECT r_name FROM g_region", "SELECT label FROM g_region", "unknown_column", None, False),
    ("wrong table?", "SELECT r_name FROM g_region", "SELECT r_name FROM regions", "unknown_table", None, False),
]

#: Gold statement, wrong statement, bucket, tag.
BUCKETS: list[tuple[str, str, str, str]] = [
    ("SELECT n_nationkey, n_name FROM g_nation", "SELECT n_nationkey FROM g_nation", "projection_only", "missing n_name"),
    ("SELECT n_name FROM g_nation", "SELECT n_name, n_nationkey FROM g_nation", "projection_only", "extra n_nationkey"),
    ("SELECT n_name FROM g_nation", "SELECT n_name AS label FROM g_nation", "wrong_rows", "filter_logic"),
    ("SELECT n_regionkey, count(*) AS n FROM g_nation GROUP BY n_regionkey", "SELECT n_regionkey, count(*) AS amount FROM g_nation GROUP BY n_regionkey", "projection_only", "renamed n to amount"),
    ("SELECT n_regionkey, count(*) AS n FROM g_nation GROUP BY n_regionkey", "SELECT n_regionkey, max(n_name) AS top FROM g_nation GROUP BY n_regionkey", "wrong_values", "computed column missing: n"),
    ("SELECT n_nationkey, n_name FROM g_nation", "SELECT n_name, n_nationkey FROM g_nation", "column_order", "column_order"),
    ("SELECT n_name FROM g_nation ORDER BY n_name", "SELECT n_name FROM g_nation ORDER BY n_name DESC", "row_order", "row_order"),
    ("SELECT n_name FROM g_nation", "SELECT n_name FROM g_nation WHERE n_regionkey = 1", "wrong_rows", "filter_logic"),
    ("SELECT n_name FROM g_nation", "SELECT DISTINCT n_name FROM g_nation WHERE n_regionkey = 1", "wrong_rows", "distinct"),
    ("SELECT n_name FROM g_nation", "SELECT n_name FROM g_nation JOIN g_region ON n_regionkey = r_regionkey WHERE r_regionkey = 1", "wrong_rows", "wrong_tables"),
    ("SELECT n_name FROM g_nation ORDER BY n_name LIMIT 3", "SELECT n_name FROM g_nation ORDER BY n_name", "wrong_rows", "limit_or_ranking"),
    ("SELECT n_name FROM g_nation", "SELECT nope FROM g_nation", "execution_error", "unknown_column"),
]


def _views(spark: SparkSession, d: str) -> list[str]:
    for view, stored in VIEWS.items():
        table(spark, d, stored).createOrReplaceTempView(view)
    return list(VIEWS)


def g01_static_check(spark: SparkSession, d: str) -> DataFrame:
    known = _views(spark, d)
    found = [(i, (c := analyse(spark, sql, known)).failure_reason, ",".join(sorted(c.tables))) for i, (sql, *_) in enumerate(CHECKED)]
    return spark.createDataFrame(found, "statement int, reason string, tables string")


def g02_execution(spark: SparkSession, d: str) -> DataFrame:
    known = _views(spark, d)
    rows = []
    for name, sql in RUN:
        r = execute(spark, sql, [*known, "nope"], max_rows=_FETCH)
        rows.append((name, r.ok, r.error_class, r.row_count, r.truncated))
    return spark.createDataFrame(rows, "name string, ok boolean, error string, fetched int, truncated boolean")


def g03_extraction(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(i, extract_sql(reply)) for i, (_, _, reply, *_) in enumerate(SCORED)], "reply int, sql string")


def g04_repair(spark: SparkSession, d: str) -> DataFrame:
    known, rows = _views(spark, d), []
    for name, sql, again in REPAIRED:
        out = repair_loop(spark, sql, "?", known, lambda q, s, p, again=again: again)
        rows.append((name, len(out.attempts), out.repaired, out.diagnosis.problem))
    return spark.createDataFrame(rows, "name string, attempts int, repaired boolean, problem string")


class _Replies:
    """Gives the replies in order, for questions may be asked twice."""

    def __init__(self) -> None:
        self.left = [reply for _, _, reply, *_ in SCORED]

    def generate(self, question: str, schema: str) -> str:
        return self.left.pop(0)


def _scored(spark: SparkSession, d: str) -> tuple[DataFrame, list[Example], list[str]]:
    known = _views(spark, d)
    examples = [Example(f"x{i:02}", q, gold) for i, (q, gold, *_) in enumerate(SCORED)]
    return run_benchmark(spark, examples, _Replies(), known, max_rows=_FETCH), examples, known


def g05_scoring(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)[0].select("example_id", "outcome", "strict_correct", "projection_match")


def g06_rescoring(spark: SparkSession, d: str) -> DataFrame:
    scored, examples, known = _scored(spark, d)
    return rescore(spark, scored, examples, known, max_rows=_FETCH).select("example_id", "outcome", "strict_correct", "projection_match")


def g07_failure_buckets(spark: SparkSession, d: str) -> DataFrame:
    _views(spark, d)
    stored = {c for t in VIEWS.values() for c in table(spark, d, t).columns}
    found = [(i, *failure_bucket(execute(spark, gold), execute(spark, wrong), stored)) for i, (gold, wrong, *_) in enumerate(BUCKETS)]
    return spark.createDataFrame(found, "pair int, bucket string, tag string")


def g08_projection(spark: SparkSession, d: str) -> DataFrame:
    _views(spark, d)
    gold = execute(spark, "SELECT o_orderkey FROM g_orders", max_rows=_FETCH)
    tried = ["SELECT o_orderkey, o_orderdate FROM g_orders", "SELECT o_orderkey, o_orderdate FROM g_orders WHERE o_orderkey > 1", "SELECT o_orderdate FROM g_orders", "SELECT o_orderkey FROM g_orders"]
    return spark.createDataFrame([(i, projection_matches(spark, sql, gold.columns, gold.fingerprint, _FETCH)) for i, sql in enumerate(tried)], "statement int, matches boolean")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "g01_static_check": g01_static_check,
    "g02_execution": g02_execution,
    "g03_extraction": g03_extraction,
    "g04_repair": g04_repair,
    "g05_scoring": g05_scoring,
    "g06_rescoring": g06_rescoring,
    "g07_failure_buckets": g07_failure_buckets,
    "g08_projection": g08_projection,
}


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value).upper()


def _values(rows: list[tuple], columns: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) AS t({columns})"


_OUTCOMES = _values([(f"x{i:02}", outcome, strict, more) for i, (_, _, _, outcome, strict, more) in enumerate(SCORED)], "example_id, outcome, strict_correct, projection_match")
ORACLE = {
    "g01_static_check": _values([(i, reason, tables) for i, (_, reason, tables) in enumerate(CHECKED)], "statement, reason, tables"),
    "g02_execution": f"""WITH r AS (SELECT 'all nations' AS name, count(*) AS n FROM nation UNION ALL SELECT 'orders by status', count(DISTINCT o_orderstatus) FROM orders UNION ALL SELECT 'large orders', count(*) FROM orders WHERE o_totalprice > 100000)
SELECT name, TRUE AS ok, NULL AS error, CAST(least(n, {_FETCH}) AS INTEGER) AS fetched, n > {_FETCH} AS truncated FROM r
UNION ALL SELECT * FROM (VALUES ('no such column', FALSE, 'unknown_column', NULL, FALSE), ('no such table', FALSE, 'unknown_table', NULL, FALSE), ('no such function', FALSE, 'unknown_function', NULL, FALSE), ('division', FALSE, 'division_by_zero', NULL, FALSE), ('write', FALSE, 'dangerous_sql', NULL, FALSE))""",
    "g03_extraction": _values([(i, sql) for i, sql in enumerate(["SELECT n_name FROM g_nation ORDER BY n_name DESC", *(r for _, _, r, *_ in SCORED[1:3]), "SELECT n_name FROM g_nation ORDER BY 1", *(r for _, _, r, *_ in SCORED[4:10]), "", *(r for _, _, r, *_ in SCORED[11:])])], "reply, sql"),
    "g04_repair": _values([("sound", 1, False, None), ("wrong column", 2, True, None), ("wrong table", 2, True, None), ("stays wrong", 2, False, "unknown_column"), ("same again", 1, False, "unknown_column"), ("write", 2, True, None)], "name, attempts, repaired, problem"),
    "g05_scoring": _OUTCOMES,
    "g06_rescoring": _OUTCOMES,
    "g07_failure_buckets": _values([(i, bucket, tag) for i, (_, _, bucket, tag) in enumerate(BUCKETS)], "pair, bucket, tag"),
    "g08_projection": _values([(0, True), (1, False), (2, False), (3, False)], "statement, matches"),
}
