import json
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tamarack.dataset import expand, pipeline
from tamarack.evaluation import metrics
from tamarack.operators.ranking import bucket_rank, exact_quantiles, place_rows, range_rank
from tamarack.operators.skew import hot_aware_join
from tamarack.plans import harness_queries
from tamarack.retrieval import schema as retrieval
from tamarack.retrieval import shop
from tamarack.sources import records

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_latency_by_hand(spark):
    values = [5.0, 1.0, 9.0, 3.0, 3.0, 8.0, 2.0, 7.0, 6.0, 4.0, 10.0]
    row = metrics.latency(spark.createDataFrame([(v,) for v in values], "execution_latency_ms double")).collect()[0]
    ordered = sorted(values)
    assert (row.n, row.median, row.p90, row.low, row.high) == (11, ordered[5], ordered[min(int(0.9 * 11), 10)], 1.0, 10.0)
    assert metrics.latency(spark.createDataFrame([], "execution_latency_ms double")).collect()[0].n == 0


@pytest.mark.parametrize("n,rows", [(7, 100), (100, 7), (1, 5), (0, 5), (3, 3), (97, 1000)])
def test_stride_sample(spark, n, rows):
    df = spark.createDataFrame([(i,) for i in range(rows)], "x int").repartition(3)
    got = sorted(r.x for r in records.stride_sample(df, n, ["x"], bucket_rows=50).collect())
    assert got == ([int(i * rows / n) for i in range(n)] if 0 < n < rows else list(range(rows)) if n else [])


def test_ranks_are_dense_in_every_class(spark):
    rows = [(None if i % 4 == 0 else i % 3, i, i) for i in range(500)]
    df = spark.createDataFrame(rows, "c int, x int, rank_in int").repartition(5)
    for ranked in (bucket_rank(df, ["c"], ["x"], bucket_rows=30), range_rank(df, ["c"], ["x"], bucket_rows=30)):
        by = {}
        for r in ranked.collect():
            by.setdefault(r.c, []).append((r.rank, r.x))
        assert all(sorted(k for k, _ in v) == list(range(len(v))) for v in by.values())
    assert all([x for _, x in sorted(v)] == sorted(x for _, x in v) for v in by.values())


@pytest.mark.parametrize("classes", [[], ["c"]])
@pytest.mark.parametrize("kind", ["rank", "dense_rank", "row_number", "ntile"])
def test_places_are_the_same_however_many_rows(spark, kind, classes):
    rows = [(i % 3, None if i == 5 else float(i * 7 % 40), i) for i in range(200)]
    df = spark.createDataFrame(rows, "c int, v double, id int").repartition(4)
    few, many = (place_rows(df, kind, "v", ["id"], classes, tiles=7, one_task_rows=n) for n in (1000, 10))
    assert sorted(map(str, few.select("c", "v", "id", "place").collect())) == sorted(map(str, many.select("c", "v", "id", "place").collect()))


@pytest.mark.parametrize("classes", [[], ["c"]])
def test_quantiles_are_the_same_however_many_rows(spark, classes):
    df = spark.createDataFrame([(i % 3, None if i % 9 == 0 else float(i * 7 % 50)) for i in range(160)], "c int, v double").repartition(3)
    few, many = (exact_quantiles(df, F.col("v"), [0.0, 0.25, 0.5, 0.9, 1.0], classes, one_task_rows=n) for n in (1000, 10))
    assert sorted(map(str, few.select(*classes, F.transform("q", lambda x: F.round(x, 9))).collect())) == sorted(map(str, many.select(*classes, F.transform("q", lambda x: F.round(x, 9))).collect()))


def test_hot_keys_meet_everything(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2000, F.lit(0)).otherwise(F.col("id") % 50).cast("int").alias("k"), "id")
    sizes = rows.groupBy("k").agg(F.count("*").alias("n"))
    joined = hot_aware_join(rows, sizes, ["k"], "n", 3000, least=100)
    assert joined.count() == 3000 and joined.where("k = 0").select("n").distinct().count() == 1


def test_header_and_resume(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text("\n".join(map(json.dumps, [{"_header": {"v": 1}}, {"example_id": "a", "n": 1}, {"example_id": "b", "n": 2}])))
    rows, header = records.read_with_header(spark, str(path), "example_id string, n int")
    assert rows.count() == 2 and header.count() == 1
    records.append_checkpoint(rows.where("n = 1"), str(tmp_path / "done"))
    records.append_checkpoint(rows.where("n = 1"), str(tmp_path / "done"))
    done = records.read_lines(spark, str(tmp_path / "done"), "example_id string, n int")
    assert [r.example_id for r in records.not_done(rows, done).collect()] == ["b"]
    records.write_lines(rows, str(tmp_path / "out"))
    assert records.read_lines(spark, str(tmp_path / "out"), "example_id string, n int", 1, "n").collect()[0].example_id == "a"
    with pytest.raises(ValueError):
        records.export(rows, ["n"], {"n"})


def test_screening_order(spark):
    rows = [("1", "q", "SELECT 1", 1, None), ("2", " Q ", "select  1", 1, None), ("3", "", "SELECT 1", 1, None), ("4", "q", None, 1, None), ("5", "q", "DROP TABLE x", 1, None), ("6", "q", "SELECT 2", 1, "boom"), ("7", "q", "SELECT 3", 0, None)]
    df = spark.createDataFrame(rows, "id string, question string, sql string, row_count int, error string")
    assert {r.id: r.reason for r in pipeline.screen(df).collect()} == {"1": None, "2": "duplicate", "3": "empty_question", "4": "empty_sql", "5": "not_read_only", "6": "failed", "7": "empty_result"}


def test_groups_split_and_leaks(spark):
    df = spark.createDataFrame([("a", "S1"), ("b", "s1 "), ("c", "S2"), (None, "S2"), ("d", "S3")], "template_id string, sql string")
    groups = {r.value: r.grp for r in pipeline.equivalence_groups(df).collect()}
    assert groups["a"] == groups["b"] and len(set(groups.values())) == 3
    g = spark.createDataFrame([(f"g{i}", "t", 10) for i in range(100)], "grp string, tier string, n int")
    assert Counter(r.split for r in pipeline.stratified_split(g).collect()) == {"train": 70, "validation": 15, "test": 15}
    pins = spark.createDataFrame([("g1", "test"), ("g2", "test"), ("g2", "train")], "grp string, split string")
    pinned = {r.grp: (r.split, r.conflict) for r in pipeline.pinned_split(g, pins).collect()}
    assert pinned["g1"] == ("test", False) and pinned["g2"][1] and pinned["g3"] == ("train", False)
    leaks = pipeline.leakage(spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "a"), (None, "a"), (None, "b")], "v string, split string"), "v")
    assert [r.value for r in leaks.collect()] == ["x"]


def test_template_checks(spark):
    t = spark.createDataFrame([("a", ["in {x}?", "all?"], "SELECT {x}"), ("a", ["in {x}?"], "SELECT 2 * {x}")], "template_id string, questions array<string>, sql string")
    assert expand.repeated_ids(t).count() == 1
    assert [r.question for r in expand.uncovered_slots(t).collect()] == ["all?"] and expand.question_collisions(t).count() == 1
    pool = spark.createDataFrame([(i,) for i in range(300)], "value int")
    assert expand.slot_combinations({"x": pool}).select(F.col("slots")["x"]).distinct().count() == 120
    with pytest.raises(ValueError):
        expand.slot_combinations({"x": pool.limit(0)})
    values = [r.value for r in expand.quantile_pool(pool, F.col("value"), 0).collect()]
    assert values and 0 not in values and 299 not in values


def test_gate_and_outcomes(spark):
    rows = [(str(i), "easy", "SELECT a FROM t ORDER BY a", "wrong_result" if i % 2 else "correct", i % 2 == 0) for i in range(10)]
    df = spark.createDataFrame(rows, "example_id string, difficulty string, gold_sql string, outcome string, correct boolean")
    gate = {r.check: r.passed for r in metrics.release_gate(df, df.withColumn("correct", F.lit(True)), 40, 90, 30).collect()}
    assert gate == {"accuracy": True, "executable": True, "lost in easy": False}
    assert metrics.outcome_of(None, True) == "correct" and metrics.outcome_of("unparseable", False) == "invalid_sql" and metrics.outcome_of("x", False) == "execution_error"


def test_retrieval(spark):
    infos = [retrieval.TableInfo("customers", {"customer_id": "integer", "city": "text"}, "customer_id"), retrieval.TableInfo("orders", {"order_id": "integer", "customer_id": "integer"}, "order_id", {"customer_id": "customers"}), retrieval.TableInfo("items", {"order_id": "integer", "sku": "text"}, None, {"order_id": "orders"}), retrieval.TableInfo("lone", {"x": "text"})]
    values = retrieval.value_index({"customers": spark.createDataFrame([("New Oslo",), ("Rome",)], "city string")})
    asked = spark.createDataFrame([("1", "How many items were sold in Rome?"), ("2", "zzz")], "id string, question string")
    scores = {(r.key, r.table): r.score for r in retrieval.score_tables(asked, infos, values).collect()}
    assert scores["1", "items"] >= retrieval.NAME and scores["1", "customers"] == retrieval.VALUE and not any(k == "2" for k, _ in scores)
    assert retrieval.select_tables({"items": 3.0, "customers": 2.5}, infos) == ["customers", "orders", "items"]
    assert len(retrieval.select_tables({}, infos)) == 4
    assert retrieval.shortest_path(retrieval.neighbours(infos), "items", "lone") == []
    assert "orders.customer_id -> customers" in retrieval.render_schema(infos) and "->" not in retrieval.render_schema(infos[1:2])
    words = ["categories", "boxes", "status", "address", "orders", "glasses", "is", "bus"]
    col = spark.createDataFrame([(" ".join(words),)], "t string").select(retrieval.terms_column(F.col("t")).alias("x")).collect()[0].x
    assert col == [retrieval.singular(w) for w in words] == ["category", "box", "status", "address", "order", "glass", "is", "bus"]


def test_selection_for_all_questions_follows_select_tables(spark):
    rng = random.Random(5)
    names = [t.name for t in shop.TABLES]
    scores = {str(i): {t: rng.choice([0.4, 1.0, 3.0, 5.5, 20.0]) for t in rng.sample(names, rng.randint(0, 6))} for i in range(60)}
    rows = [(k, t, s) for k, v in scores.items() for t, s in v.items()]
    keys = spark.createDataFrame([(k,) for k in scores], "key string")
    got = {r.key: r.selected for r in retrieval.selected_tables(keys, spark.createDataFrame(rows, "key string, table string, score double"), shop.TABLES).collect()}
    assert got == {k: retrieval.select_tables(v, shop.TABLES) for k, v in scores.items()}


@pytest.mark.parametrize(
    "sql,tables",
    [
        ("SELECT EXTRACT(YEAR FROM order_date) FROM orders o JOIN public.customers c ON c.x = o.x", {"orders", "customers"}),
        ("WITH spend AS (SELECT * FROM payments), b (x) AS (SELECT 1 FROM spend) SELECT * FROM spend JOIN b ON TRUE JOIN \"Inventory\" USING (x)", {"payments", "inventory"}),
        ("SELECT 'from nowhere' -- from nothing\nFROM order_items AS i, products p WHERE i.a IS DISTINCT FROM p.a AND EXISTS (SELECT 1 FROM lost)", {"order_items", "products", "lost"}),
        ("SELECT * FROM generate_series(1, 2) g", set()),
        ("SELECT (SELECT max(a) FROM orders), b FROM shipments ORDER BY a, b", {"orders", "shipments"}),
    ],
)
def test_tables_of_statements(spark, sql, tables):
    row = spark.createDataFrame([(sql,)], "q string").select(retrieval.tables_of(F.col("q")).alias("t")).collect()[0]
    assert set(row.t) == tables and len(row.t) == len(tables)


def test_retrieval_counts_every_question(spark, tmp_path):
    rows = [("1", "Which payments failed?", "SELECT * FROM payments"), ("2", "Which payments failed in store?", "SELECT * FROM payments JOIN stores USING (x)"), ("3", "zzz", "SELECT * FROM inventory")]
    schema = spark.read.parquet(f"{SF}/results_smoke.parquet").schema
    full = spark.createDataFrame([tuple({"example_id": i, "question": q, "gold_sql": s}.get(f.name) for f in schema) for i, q, s in rows], schema)
    full.write.parquet(str(tmp_path / "results_smoke.parquet"))
    for name in ("categories", "products", "suppliers", "customer", "orders", "nation", "region"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    got = harness_queries.t03_retrieval_quality(spark, str(tmp_path)).collect()[0]
    assert got.n == 3 and got.recall == 75.0 and round(got.complete, 2) == 66.67


def test_stored_values_reach_the_scores(spark, tmp_path):
    schema = spark.read.parquet(f"{SF}/results_smoke.parquet").schema
    question = "Anything for Zyxland or Qarth or the ASIA people?"
    row = tuple({"example_id": "1", "question": question, "gold_sql": "SELECT 1 FROM suppliers"}.get(f.name) for f in schema)
    spark.createDataFrame([row], schema).write.parquet(str(tmp_path / "results_smoke.parquet"))
    for name in ("categories", "products", "customer", "orders", "nation", "region"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    suppliers = spark.read.parquet(f"{SF}/suppliers.parquet").limit(3).withColumn("country", F.lit("Zyxland")).withColumn("city", F.lit("Qarth for the people"))
    suppliers.write.parquet(str(tmp_path / "suppliers.parquet"))
    scores = {r.table_name: r.score for r in harness_queries.t01_table_scores(spark, str(tmp_path)).collect()}
    assert scores["suppliers"] >= 2 * retrieval.VALUE and scores["region"] == retrieval.VALUE
    got = harness_queries.t03_retrieval_quality(spark, str(tmp_path)).collect()[0]
    assert got.recall == 100.0 and got.precision < 100.0  # ASIA tells of customers


def test_dealing_in_bulk_is_dealing_one_by_one():
    rng = random.Random(11)
    for _ in range(300):
        lack = [rng.randint(-50, 4000) / rng.choice([1, 3]) for _ in range(3)]
        n, groups = rng.randint(1, 30), rng.randint(0, 200)
        one, want = list(lack), [0, 0, 0]
        for _ in range(groups):
            i = max(range(3), key=lambda k: (one[k], -k))
            one[i] -= n
            want[i] += 1
        assert pipeline.deal(list(lack), n, groups) == want


def test_split_holds_every_record_and_keeps_templates_whole(spark, tmp_path):
    schema = spark.read.parquet(f"{SF}/results_smoke.parquet").schema
    typed = ["m011", "M-11", " m011", "m０１１"]
    rows = [(str(i), typed[i % 4] if i < 40 else None if i < 80 else f"e{i % 20:03}", f"SELECT {i}", " Easy") for i in range(200)]
    rows += [("same", None, "select  199", None), ("no_sql", "h001", None, "hard"), ("neither", None, None, None)]
    full = [tuple({"example_id": i, "template_id": t, "gold_sql": q, "difficulty": k}.get(f.name) for f in schema) for i, t, q, k in rows]
    spark.createDataFrame(full, schema).write.parquet(str(tmp_path / "results_smoke.parquet"))
    d = str(tmp_path)
    split = {r.grp: (r.tier, r.split) for r in harness_queries.QUERIES["d05_stratified_split"](spark, d).collect()}
    records = {r.id: r.grp for r in harness_queries._grouped(spark, d).collect()}
    assert len(records) == len(rows) and set(records.values()) == set(split)
    assert len({records[str(i)] for i in range(40)}) == 1 and len({records[str(i)] for i in range(40, 80)}) == 40
    assert records["same"] == records["199"] and split[records["40"]][0] == "e" and split[records["no_sql"]][0] == "h"
    assert harness_queries.QUERIES["d16_split_leakage"](spark, d).count() == 0
    assert harness_queries.QUERIES["d06_pinned_split"](spark, d).count() == len(split)
