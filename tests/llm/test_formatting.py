from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tamarack.llm.formatting import collapsed, copies, formatting_classes
from tamarack.llm.sqltext import statement_parts


def key(s):
    p = statement_parts(s)
    return p and (sorted(p[0]), p[1])


SAME = [
    ("SELECT a, b FROM t WHERE x = 'Q r' AND y > 1", 'select\n\t"B", `A` from T where ((X = ‘q  R’)) and (y>1) ;;\n'),
    ("SELECT DISTINCT t.a, t.b FROM t", 'SELECT\n  DISTINCT "T"."B","T"."A" FROM "T"'),
    ("SELECT a - b AS m, c FROM t WHERE a OR b AND c", "SELECT c, (a - b) AS m FROM t WHERE a OR (b AND c)"),
    ("WITH s AS (SELECT a, b FROM t) SELECT x, y FROM s", "with s as (select a, b from t) select y, x from s;"),
    ("SELECT SUM(a * b) AS r, p FROM o JOIN p ON o.i = p.i", "SELECT p, SUM((a * b)) AS r FROM o JOIN p ON ((o.i = p.i))"),
    ("SELECT a FROM t WHERE x BETWEEN 1 AND 2 AND z = 3", "SELECT a FROM t WHERE (x BETWEEN 1 AND 2) AND (z = 3)"),
    ("SELECT a FROM t WHERE NOT EXISTS (SELECT 1 FROM u)", "SELECT a FROM t WHERE (NOT EXISTS ((SELECT 1 FROM u)))"),
]
DIFFERENT = [
    ("SELECT a FROM t WHERE (a OR b) AND c", "SELECT a FROM t WHERE a OR b AND c"),
    ("SELECT a FROM t WHERE x > 1", "SELECT a FROM t WHERE x > -1"),
    ("SELECT a FROM t WHERE x > 13.5", "SELECT a FROM t WHERE x > 135"),
    ("SELECT a FROM t ORDER BY a, b", "SELECT a FROM t ORDER BY b, a"),
    ("SELECT a, a, b FROM t", "SELECT a, b, b FROM t"),
    ("SELECT a FROM t WHERE x < y", "SELECT a FROM t WHERE y < x"),
    ("SELECT a - (b - c) FROM t", "SELECT a - b - c FROM t"),
    ("SELECT a - (b + c) FROM t", "SELECT a - b + c FROM t"),
    ("SELECT a FROM t WHERE x = 'ab'", "SELECT a FROM t WHERE x = 'a b'"),
    ("SELECT a FROM t WHERE NOT (a = 1 AND b = 2)", "SELECT a FROM t WHERE NOT a = 1 AND b = 2"),
    ("WITH s AS (SELECT a, b FROM t) SELECT x FROM s", "WITH s AS (SELECT b, a FROM t) SELECT x FROM s"),
    ("SELECT a FROM t WHERE x = 'it''s'", "SELECT a FROM t WHERE x = 'its'"),
    ("SELECT (a + b) * c FROM t", "SELECT a + b * c FROM t"),
    (None, ""),
]


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    assert key(a) == key(b)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_different(a, b):
    assert key(a) != key(b)


def test_broken_statements():
    for s in ["", ";", "(((", "SELECT (a, b FROM", "select", "SELECT a, b", "'x", "Sorry, no.", ")("]:
        statement_parts(s)


@pytest.mark.parametrize("bits", ["all", "none"])
def test_against_brute_force(spark, bits):
    texts = [x for pair in SAME + DIFFERENT for x in pair] + ["", None, ";;", "SELECT"]
    rows = [(f"r{i:03}", texts[i % len(texts)], texts[(i * 7) % len(texts)], i, "x") for i in range(150)]
    rows += [("r000", "older", None, -5, "x"), rows[3], (None, "a", "b", 1, "x")]
    df = spark.createDataFrame(rows, "rid string, g string, p string, at int, id string")
    half = (lambda c: c) if bits == "all" else (lambda c: F.pmod(c, F.lit(3)))
    classes = formatting_classes(df.where("at >= 0"), "rid", ["g", "p"], "at", bits=half)
    want = defaultdict(list)
    for i, g, p, at, _ in set(rows):
        if i is not None and at >= 0:
            want[str((key(g), key(p)))].append(i)
    pairs = {(min(v), x) for v in want.values() for x in v if x != min(v)}
    assert {tuple(r) for r in copies(classes).collect()} == pairs
    assert sorted(r.copies for r in collapsed(classes).collect()) == sorted(len(set(v)) for v in want.values())


def test_empty(spark):
    df = spark.createDataFrame([], "rid string, g string")
    assert formatting_classes(df, "rid", ["g"]).count() == 0
