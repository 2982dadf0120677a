import os

import pytest

from tamarack.llm import queries as llm
from tests.compare import spark_rows, sql_rows, tables

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return tables(SF)


@pytest.mark.parametrize("name", list(llm.queries()))
def test_equals_sql_or_runs(spark, con, name):
    df = llm.queries()[name](spark, SF)
    sql = llm.oracle_sql().get(name)
    if sql is None:
        assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)
    else:
        assert spark_rows(df) == sql_rows(con, sql)


FIXED = {"p2_found": ["template_a", "template_b"], "p3_found": ["plan_id", "difficulty", "domain"], "p4_found": ["first_id", "copy_id"], "p5_found": ["example_id", "defect"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id"]}


@pytest.mark.parametrize("name", FIXED)
def test_columns_and_distinct_rows(spark, name):
    df = llm.queries()[name](spark, SF)
    assert df.columns == FIXED[name]
    rows = list(map(str, df.collect()))
    assert len(rows) == len(set(rows))
