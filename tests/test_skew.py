import pytest

from tamarack.operators.skew import FEW_ROWS, hot_aware_join, salted_join, side
from tamarack.storage import materialize


@pytest.mark.parametrize("join", [hot_aware_join, salted_join])
@pytest.mark.parametrize("least", [3, 50_000])
def test_same_as_a_plain_join(spark, join, least):
    rows = spark.createDataFrame([(1 if i % 3 == 0 else i, f"r{i}", i) for i in range(120)] + [(None, "none", 0), (5000, "lost", 0)], "k int, name string, n int")
    unique = spark.createDataFrame([(k, f"wide {k}", 40 if k == 1 else 1) for k in range(120)], "k int, text string, size int")
    out = join(rows, unique, ["k"], "size", 122, least)
    assert out.columns == ["k", "name", "n", "text", "size"]
    assert sorted((r.k, r.name, r.text) for r in out.collect()) == sorted((1 if i % 3 == 0 else i, f"r{i}", f"wide {1 if i % 3 == 0 else i}") for i in range(120))
    assert join(rows.limit(0), unique, ["k"], "size", 0, least).count() == 0


def test_a_side_of_many_rows_is_never_broadcast(spark):
    rows = spark.range(FEW_ROWS + 1).withColumnRenamed("id", "k")
    for n, broadcast in ((FEW_ROWS, True), (FEW_ROWS + 1, False)):
        stored = materialize(rows.limit(n))
        plan = rows.join(side(stored), "k")._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" in plan) == broadcast
