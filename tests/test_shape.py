import os

import duckdb
import pytest

from tamarack.evaluation.shape import Shape, shape_tag, statement_shape

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_parts_of_a_statement():
    s = statement_shape("WITH a AS (SELECT x FROM t1) SELECT DISTINCT coalesce(a.x, 0), rank() OVER (ORDER BY y) FROM a JOIN s.t2 AS b USING (x), t3 WHERE x IS DISTINCT FROM 3 AND EXTRACT(YEAR FROM d) = 2 AND y IN (SELECT z FROM t4) GROUP BY 1 HAVING count(*) > 1 ORDER BY 1 LIMIT 3; -- end FROM t9")
    assert s == Shape(True, ("t1", "t2", "t3", "t4"), 2, True, True, True, True, True, True, 2, True)
    assert statement_shape("select 'from t1 join' as \"Join\" from \"T\"").tables == ("t",)


@pytest.mark.parametrize("sql", [None, "", "  ", "drop table x", "select a from", "select a from t where b = 'x", "select (a from t", "select a from t; select 2", "select a from t where b = 3x", "select a, from t"[:9]])
def test_not_parsed(sql):
    assert statement_shape(sql) == Shape(False)


def test_tags():
    g = statement_shape("SELECT a FROM t ORDER BY a LIMIT 3")
    tag = lambda sql, n=3: shape_tag(g, statement_shape(sql), 3, n)
    assert tag("SELECT a FROM u") == "wrong_tables" and tag("SELECT a FROM t ORDER BY a") == "limit_or_ranking" and tag("SELECT a FROM t LIMIT 3", 2) == "limit_or_ranking"
    assert tag("SELECT a FROM t WHERE b LIMIT 3") == "filter_logic" and tag("SELECT DISTINCT a FROM t LIMIT 3") == "distinct" and tag("oops") == "unparsed"


def test_equals_a_parser_on_the_stored_statements():
    rows = duckdb.connect().sql(f"""WITH s AS (SELECT DISTINCT gold_sql AS s FROM '{SF}/results_smoke.parquet' UNION SELECT DISTINCT predicted_sql FROM '{SF}/results_smoke.parquet'), j AS (SELECT s, json_serialize_sql(s) AS j FROM s WHERE s IS NOT NULL)
      SELECT s, [x FOR x IN (j->>'$..table_name') IF x <> '' AND NOT list_contains(coalesce(j->>'$..cte_map.map[*].key', []), x)], len(regexp_extract_all(j::VARCHAR, '"ref_type":"')) FROM j WHERE (j->>'error') = 'false'""").fetchall()
    assert len(rows) > 300
    for sql, tables, joins in rows:
        s = statement_shape(sql)
        assert not s.parsed or (s.tables, s.joins) == (tuple(sorted({t.lower() for t in tables})), joins)
    assert sum(not statement_shape(sql).parsed for sql, *_ in rows) <= 0.01 * len(rows)
