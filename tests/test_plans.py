import os

import pytest

from tamarack.operators.ranking import latest_of_each
from tamarack.plans.registry import templates
from tamarack.plans.mart import Mart
from tamarack.streaming import events

from .compare import spark_rows, sql_rows, tables

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name,joins", [("h32_most_valuable_warehouses", 4), ("x31_low_stock_by_brand", 1), ("m22_stock_by_warehouse", 0), ("m32_parts_above_stock", 0)])
def test_parts_are_joined_once_or_not_at_all(spark, name, joins):
    plan = templates()[name].run(Mart(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == joins  # h32 names its few warehouses at the end


def test_latest_of_each_class(spark):
    rows = [(c, i, f"2020-01-{1 + (i * 7) % 28:02} 0{i % 9}:00:00") for i in range(200) for c in ("a", "b", None)] + [("c", 1, "2020-05-05 00:00:00"), ("a", 999, None)]
    df = spark.createDataFrame(rows, "c string, id int, t string").selectExpr("c", "id", "cast(t as timestamp_ntz) AS t")
    got = sorted((str(r.c), r.place, r.id) for r in latest_of_each(df, "c", "t", ["id"], 4).collect())
    want = []
    for c in ("a", "b", None, "c"):
        mine = sorted([r for r in rows if r[0] == c and r[2]], key=lambda r: (r[2],), reverse=True)
        mine = sorted(mine, key=lambda r: r[1])
        mine.sort(key=lambda r: r[2], reverse=True)
        want += [(str(c), i + 1, r[1]) for i, r in enumerate(mine[:4])]
    assert got == sorted(want)


def test_appended_windows_are_closed_by_the_watermark(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{i % 5}:10:00", i, "x", 1.0, None) for i in range(40)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").selectExpr("event_id", "cast(ts as timestamp_ntz) AS ts", "user_id", "event_type", "value", "props").write.parquet(str(tmp_path / "e"))
    open_ = events.run_available(events.windowed_totals(events.event_stream(spark, str(tmp_path / "e"))), "append").count()
    closed = events.run_available(events.windowed_totals(events.with_end(spark, str(tmp_path / "e"))), "append")
    assert open_ < 5 and closed.count() == 5 and {r.n for r in closed.collect()} == {8}


@pytest.mark.parametrize("name", ["v07_mean_days_to_arrival", "v23_mean_days_to_payment"])
def test_day_counts_beyond_a_long(spark, tmp_path, name):
    """6,000 lines that each take nearly 10,000 years: their microseconds exceed a bigint, as those of millions of ordinary lines do."""
    con = tables(SF)
    con.sql(f"COPY (SELECT * REPLACE (TIMESTAMP '0001-01-01' AS o_orderdate) FROM orders) TO '{tmp_path}/orders.parquet'")
    con.sql(f"COPY (SELECT * REPLACE (l_shipdate + INTERVAL 7900 YEAR AS l_shipdate) FROM lineitem) TO '{tmp_path}/lineitem.parquet'")
    for t in ("orders", "lineitem"):
        con.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    assert spark_rows(templates()[name].query(spark, str(tmp_path))) == sql_rows(con, templates()[name].oracle())


def test_lines_that_have_not_arrived_are_not_joined(spark, tmp_path):
    """They count neither in the sum nor in the number, and sorted for a join they took the memory of large runs."""
    name = "v07_mean_days_to_arrival"
    plan = templates()[name].run(Mart(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert any("Filter" in line and "l_linestatus" in line for line in plan.split("Join Inner")[1].splitlines())
    con = tables(SF)
    con.sql(f"COPY orders TO '{tmp_path}/orders.parquet'")
    con.sql(f"COPY (SELECT * REPLACE ('O' AS l_linestatus) FROM lineitem) TO '{tmp_path}/lineitem.parquet'")
    con.sql(f"CREATE OR REPLACE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    assert spark_rows(templates()[name].query(spark, str(tmp_path))) == sql_rows(con, templates()[name].oracle()) == (["days"], [(None,)])
