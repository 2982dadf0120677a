import os
import random
from statistics import quantiles

import pytest
from pyspark.sql import functions as F

from tamarack.dataset import expand, pipeline, pools
from tamarack.operators import ranking
from tamarack.plans.mart import Mart

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def pairs(spark, rows):
    return spark.createDataFrame(rows, "id string, question string, sql string, fingerprint string, row_count int, error string")


def test_full_screening(spark):
    ok = "SELECT a FROM t"
    rows = [("1", "q", ok, "f", 1, None), ("2", "q", "select  a from T", "f", 1, None), ("3", " ", ok, "f", 1, None), ("4", "r", None, "f", 1, None), ("5", "r", "DROP TABLE t", "f", 1, None), ("6", "r", "SELECT a FROM", "f", 1, None), ("7", "r", "SELECT a FROM hidden", "f", 1, None), ("8", "r", "SELECT b FROM t", "f", 1, "boom"), ("9", "r", "SELECT c FROM t", "f", 0, None)]
    rows += [("a", "two ways", "SELECT a FROM t", "f", 1, None), ("b", "two ways", "SELECT b FROM t", "g", 2, None), ("c", "two ways", "SELECT b FROM t", "g", 2, None)]
    got = {r.id: r.reason for r in pipeline.screen_fully(pairs(spark, rows), ["t"]).collect()}
    assert got == {"1": None, "2": "duplicate_pair", "3": "empty_question", "4": "empty_sql", "5": "dangerous_sql", "6": "unparseable", "7": "unknown_table", "8": "failed", "9": "empty_result", "a": "conflicting_question", "b": "conflicting_question", "c": "duplicate_pair"}
    assert pipeline.screen_fully(pairs(spark, []), ["t"]).count() == 0


def test_combinations_are_drawn_without_their_product(spark):
    pool = lambda n: spark.range(n).selectExpr("cast(id as string) AS value")
    many = {n: pool(5000) for n in "abcd"}
    first, again, other = (sorted(map(str, expand.slot_combinations(many, seed=s).collect())) for s in (1, 1, 2))
    assert len(set(first)) == 120 and first == again != other
    few = {tuple(r.slots.values()) for r in expand.slot_combinations({"a": pool(3), "b": pool(4)}).collect()}
    assert len(few) == 12


def test_combinations_are_drawn_from_pools_of_any_size(spark, monkeypatch):
    pool = lambda n: spark.range(n).selectExpr("concat('name ', id) AS value")
    large = [r.slots for r in expand.slot_combinations({"a": pool(expand.MOST_VALUES + 2000), "b": pool(3)}).collect()]
    assert len({tuple(s.values()) for s in large}) == 120
    assert {s["a"] for s in large} <= {f"name {i}" for i in range(12_000)} and {s["b"] for s in large} == {"name 0", "name 1", "name 2"}
    both = {"a": pool(700), "b": pool(5)}
    held = sorted(map(str, expand.slot_combinations(both).collect()))
    vast = {n: pool(5000) for n in "abcdef"}
    assert len(set(map(str, expand.slot_combinations(vast).collect()))) == 120  # more combinations than a bigint counts
    monkeypatch.setattr(expand, "MOST_VALUES", 10)
    assert sorted(map(str, expand.slot_combinations(both).collect())) == held


def test_quotes_in_slots_and_missing_slots(spark):
    templates = spark.createDataFrame([("t", ["Who is {name}?", "Who?"], "SELECT 1 FROM x WHERE name = '{name}'")], "template_id string, questions array<string>, sql string")
    slots = spark.createDataFrame([("t", {"name": "O'Neil"})], "template_id string, slots map<string,string>")
    found = expand.expand(templates, slots)
    rows = {r.question: r.sql for r in found.collect()}
    assert rows == {"Who is O'Neil?": "SELECT 1 FROM x WHERE name = 'O''Neil'", "Who?": "SELECT 1 FROM x WHERE name = 'O''Neil'"}
    assert [r.missing for r in expand.slots_missing(found).collect()] == [["O'Neil"]]
    s = expand.statistics(found).first()
    assert (s.examples, s.templates, s.questions, s.statements, s.fewest, s.most) == (2, 1, 2, 1, 2, 2)


def test_overlay_of_templates(spark):
    make = lambda rows: spark.createDataFrame(rows, "template_id string, questions array<string>, sql string")
    old, new = make([("a", ["x?"], "S1"), ("b", ["y?"], "S2"), ("c", ["z?"], "S3")]), make([("b", ["y?"], "S2 changed"), ("c", ["z?"], "S3"), ("d", ["w?"], "S4")])
    assert {tuple(r) for r in expand.changes(old, new).collect()} == {("a", "removed"), ("b", "changed"), ("d", "added")}
    assert {r.template_id: r.sql for r in expand.overlay(old, new).collect()} == {"a": "S1", "b": "S2 changed", "c": "S3", "d": "S4"}


def test_every_pool_has_a_name_of_its_own():
    names = [*pools.STRUCTURAL, *pools.CALENDAR, *pools.CATEGORICAL, *pools.NUMERIC]
    assert len(names) == len(set(names)) and len(pools.NUMERIC) == 23 and len(pools.CATEGORICAL) == 16


def test_split_checks(spark):
    rows = [("i1", "q1", "SELECT 1", "t1", "train"), ("i2", "q1", "SELECT 2", "t2", "test"), ("i3", "q3", "SELECT  1", "t3", "train"), ("i4", "q4 for i4", "SELECT 9", "t1", "validation"), ("i5", "q4 for i4", "SELECT 9", "t5", "validation")]
    df = spark.createDataFrame(rows, "id string, question string, sql string, template_id string, split string")
    chats = pipeline.chat_records(df.select("id", "question", "sql"), "do", schema="a(b)").select("id", "messages")
    got = {(r.split, r.check): r.failed for r in pipeline.split_checks(chats.join(df, "id"), "do", "a(b)").collect()}
    assert got == {("train", "question in test"): 1, ("validation", "id in prompt"): 1, ("validation", "repeated pair"): 1, ("validation", "repeated question"): 1, ("validation", "template in train"): 1}
    other = {(r.split, r.check) for r in pipeline.split_checks(chats.join(df, "id"), "other", "z(b)").collect()}
    assert {("train", "other instruction"), ("train", "schema not whole")} <= other


def test_numeric_pools_are_made_one_after_the_other(spark):
    """The stages of all pools at once are more than a driver of 1.5 GB holds; the last query only reads what was written."""
    plan = pools.numeric_pools(Mart(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation" in plan and not any(x in plan for x in ("Join", "Aggregate", "Sort", "Window"))


@pytest.mark.parametrize("kind", ["different", "tied", "skewed"])
def test_quantiles_of_many_values_without_ranking_them(spark, monkeypatch, kind):
    draw = random.Random(3)
    values = [{"different": draw.gauss(0, 1e6), "tied": float(draw.randrange(7)), "skewed": draw.choice([0.0, draw.random()])}[kind] for _ in range(30_000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(5)
    monkeypatch.setattr(ranking, "range_rank", lambda *_: pytest.fail("all values were ranked"))
    got = ranking.exact_quantiles(df, F.col("v"), [i / 10 for i in range(1, 10)], one_task_rows=1000).collect()[0].q
    assert got == pytest.approx(quantiles(values, n=10, method="inclusive"), rel=1e-12, abs=1e-12)
