import pytest

from tamarack.engine.execute import execute
from tamarack.engine.repair import FixedGenerator
from tamarack.evaluation import metrics
from tamarack.evaluation.score import Example, drift, failure_kind, gold_results, rescore, run_benchmark


@pytest.fixture(scope="module")
def setup(spark):
    spark.createDataFrame([(1, "a", 3), (2, "b", 2), (3, "a", 1)], "id int, k string, v int").createOrReplaceTempView("items")
    examples = [Example("1", "all?", "SELECT id, k FROM items ORDER BY v", "easy"), Example("2", "count?", "SELECT k, count(*) AS n FROM items GROUP BY k", "medium"), Example("3", "again?", "SELECT id, k FROM items ORDER BY v", "easy")]
    return examples


def test_gold_answers_score_in_full(spark, setup):
    oracle = FixedGenerator({e.question: f"```sql\n{e.gold_sql};\n```" for e in setup})
    scored = run_benchmark(spark, setup, oracle, ["items"])
    row = metrics.summarise(scored).collect()[0]
    assert (row.n, row.accuracy, row.executable, row.strict_ordered) == (3, 100.0, 100.0, 100.0)
    again = metrics.summarise(rescore(spark, scored, setup, ["items"])).collect()[0]
    assert again.accuracy == 100.0


def test_outcomes(spark, setup):
    replies = {"all?": "SELECT id, k FROM items ORDER BY id DESC", "count?": "SELECT k, count(*) AS n, max(v) AS m FROM items GROUP BY k", "again?": "DROP TABLE items"}
    got = {r.example_id: r for r in run_benchmark(spark, setup, FixedGenerator(replies), ["items"]).collect()}
    assert got["1"].correct and got["1"].strict_correct is True
    assert got["2"].outcome == "wrong_result" and got["2"].projection_match and got["2"].failure == "columns"
    assert got["3"].outcome in ("unsafe_sql", "no_sql") and not got["3"].correct
    other = {r.example_id: r for r in run_benchmark(spark, setup, FixedGenerator({"all?": "SELECT id, k FROM items ORDER BY v DESC", "count?": "SELECT nope FROM items"}), ["items"]).collect()}
    assert other["1"].correct and other["1"].strict_correct is False
    assert other["2"].outcome == "unknown_column" and other["3"].outcome == "no_sql"


def test_generator_errors(spark, setup):
    class Broken:
        def generate(self, question, schema):
            raise OSError

    assert {r.outcome for r in run_benchmark(spark, setup, Broken(), ["items"]).collect()} == {"generation_failed"}
    with pytest.raises(RuntimeError):
        run_benchmark(spark, setup, Broken(), ["items"], most_fatal=2)


def test_kinds_of_failure(spark, setup):
    run = lambda sql: execute(spark, sql)
    gold = run("SELECT id, k FROM items")
    kinds = {"SELECT id, k FROM items WHERE id > 9": "empty", "SELECT id FROM items": "columns", "SELECT id, k FROM items WHERE id > 1": "missing_rows", "SELECT id, k FROM items UNION ALL SELECT 9, 'z'": "extra_rows", "SELECT id, k FROM items UNION ALL SELECT id, k FROM items": "repeated_rows", "SELECT k, id FROM items": "order_of_columns", "SELECT id + 1, k FROM items": "values", "SELECT x FROM items": "unknown_column"}
    assert {sql: failure_kind(gold, run(sql)) for sql in kinds} == kinds
    results = gold_results(spark, setup)
    assert len(results) == 2 and drift(results, {setup[0].gold_sql: "other"}) == [setup[0].gold_sql]


def test_examples_that_share_a_question_keep_their_own_statements(spark, setup):
    pair = [Example("1", "same?", "SELECT id FROM items", "easy"), Example("2", "same?", "SELECT k FROM items", "easy")]
    rows = spark.createDataFrame([("1", "SELECT id FROM items"), ("2", "SELECT k FROM items"), ("3", "SELECT 1")], "example_id string, predicted_sql string")
    assert {r.example_id: r.outcome for r in rescore(spark, rows, pair, ["items"]).collect()} == {"1": "correct", "2": "correct"}
