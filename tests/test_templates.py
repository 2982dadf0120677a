import os

import pytest

from tamarack.plans import registry
from tamarack.plans.mart import Mart

from .compare import spark_rows, sql_rows, tables

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return tables(SF)


@pytest.mark.parametrize("name", list(registry.queries()))
def test_equals_sql(spark, con, name):
    sql = registry.oracle_sql().get(name)
    df = registry.queries()[name](spark, SF)
    if sql is None:
        assert df.columns
        df.count()
    else:
        assert spark_rows(df) == sql_rows(con, sql)


@pytest.mark.parametrize("name,slots", [("e01_customers_of_country", {"value": "O'Neil"}), ("e15_largest_orders", {"n": 3}), ("m25_orders_in_year", {"year": 1996}), ("v02_top_parts_of_each_brand", {"n": 1})])
def test_other_slots(spark, con, name, slots):
    template = registry.templates()[name]
    assert spark_rows(template.run(Mart(spark, SF), **slots)) == sql_rows(con, template.oracle(**slots))


def test_year_filter_reaches_the_scan(spark):
    plan = registry.queries()["e13_orders_of_year"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan


def test_left_join_null_is_an_anti_join(spark):
    plan = registry.queries()["h11_customers_without_recent_order"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan
