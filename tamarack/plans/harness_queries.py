"""Queries over scored answers, replies, the dataset built from them, retrieval, streams and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.dataset import expand, pipeline, pools
from tamarack.engine.execute import table_fingerprint
from tamarack.evaluation import metrics, shape
from tamarack.functions.text import letters, letters_sql, name_key, name_key_sql
from tamarack.plans.mart import SQL_VIEWS, Mart, exact_mean
from tamarack.retrieval import schema as retrieval
from tamarack.retrieval import shop
from tamarack.sources import records
from tamarack.sources.catalog import quality, quality_sql, register
from tamarack.sources.synthetic import synthetic_schema
from tamarack.sources.tables import table
from tamarack.storage import materialize
from tamarack.streaming import events as streams

_SCORED = ["difficulty", "domain", "query_type", "gold_sql", "predicted_sql", "outcome", "correct", "strict_correct", "projection_match", "gold_row_count", "predicted_row_count", "execution_latency_ms"]
#: The distinct results in SQL; labels by their letters.
_RES = r"""res AS (SELECT DISTINCT example_id, regexp_replace(lower(difficulty), '[^\p{L}]+', '', 'g') AS difficulty, regexp_replace(lower(domain), '[^\p{L}]+', '', 'g') AS domain, query_type,
  gold_sql, predicted_sql, outcome, correct, strict_correct, projection_match, gold_row_count, predicted_row_count, execution_latency_ms, question, template_id, gold_fingerprint FROM results_smoke)"""
_NOT_RUN = ", ".join(f"'{o}'" for o in metrics.NOT_EXECUTED)
_ORDERED = r"regexp_matches(gold_sql, '(?i)order\s+by')"
_FIGURES = f"""count(*) AS n, count(*) FILTER (correct) AS correct, 100.0::DOUBLE * count(*) FILTER (correct) / CAST(count(*) AS DOUBLE) AS accuracy,
  100.0::DOUBLE * count(*) FILTER (outcome NOT IN ({_NOT_RUN})) / CAST(count(*) AS DOUBLE) AS executable,
  CASE WHEN count(*) FILTER ({_ORDERED}) > 0 THEN 100.0::DOUBLE * count(*) FILTER (coalesce(strict_correct, FALSE) AND {_ORDERED}) / CAST(count(*) FILTER ({_ORDERED}) AS DOUBLE) END AS strict_ordered,
  100.0::DOUBLE * count(*) FILTER (coalesce(projection_match, FALSE) OR correct) / CAST(count(*) AS DOUBLE) AS right_columns_or_more"""
_NORMAL = r"lower(trim(regexp_replace({}, '\s+', ' ', 'g')))"


def _res(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return metrics.distinct_results(table(spark, d, "results_smoke"), [*_SCORED, *more])


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "results_smoke").select("example_id", "template_id", "question", "gold_sql", "gold_fingerprint", "gold_row_count", "error_message").dropDuplicates(["example_id"])
    return r.select(F.col("example_id").alias("id"), "template_id", "question", F.col("gold_sql").alias("sql"), F.col("gold_fingerprint").alias("fingerprint"), F.col("gold_row_count").alias("row_count"), F.lit(None).cast("string").alias("error"))


_PAIRS = "pairs AS (SELECT DISTINCT example_id AS id, template_id, question, gold_sql AS sql, gold_fingerprint AS fingerprint, gold_row_count AS row_count FROM results_smoke)"


def _latency_sql(group: str = "", column: str = "execution_latency_ms", where: str = "TRUE") -> str:
    res = _RES.replace("question,", f"question, {column} AS measured,")
    part = f"PARTITION BY {group} " if group else ""
    key = f"{group}, " if group else ""
    tail = f" GROUP BY {group}" if group else ""
    n = f"count(*) OVER ({part})"
    return f"""WITH {res}, ranked AS (SELECT {key}measured AS v, row_number() OVER ({part}ORDER BY measured) - 1 AS r, {n} AS n FROM res WHERE measured IS NOT NULL AND {where})
SELECT {key}count(*) AS n, {exact_mean('v')} AS mean, (max(CASE WHEN r = (n - 1) // 2 THEN v END) + max(CASE WHEN r = n // 2 THEN v END)) / 2 AS median,
  max(CASE WHEN r = least(floor(0.9::DOUBLE * n), n - 1) THEN v END) AS p90, min(v) AS low, max(v) AS high FROM ranked{tail}"""


def _runs(spark: SparkSession, d: str) -> DataFrame:
    res = _res(spark, d)
    return res.select("example_id", "difficulty", "correct").withColumn("run", F.lit("strict")).unionByName(res.select("example_id", "difficulty", (F.col("correct") | F.coalesce("projection_match", F.lit(False))).alias("correct")).withColumn("run", F.lit("columns")))


#: The tier of each difficulty.
_TIERS = {"easy": "e", "medium": "m", "hard": "h", "veryhard": "v", "enterprise": "x"}


def _grouped(spark: SparkSession, d: str) -> DataFrame:
    """(id, template_id, sql, grp, tier) of every record: templates, however typed, that share a statement are one group.

    A record without a template stands alone, unless its statement is in a group. The tier is
    that of the difficulty, or of the template where none is known.
    """
    rated = table(spark, d, "results_smoke").select("example_id", "template_id", F.col("gold_sql").alias("sql"), letters(F.col("difficulty")).alias("rated"))
    once = rated.groupBy(F.col("example_id").alias("id")).agg(F.max(F.struct("template_id", "sql", "rated")).alias("r")).select("id", "r.*")
    keyed = materialize(once.withColumn("key", F.coalesce(name_key(F.col("template_id")), F.concat(F.lit("record:"), F.col("id")))))
    groups = pipeline.equivalence_groups(keyed, "key").withColumnRenamed("value", "key")
    known = F.create_map(*(F.lit(x) for pair in _TIERS.items() for x in pair))
    tier = F.coalesce(known[F.col("rated")], F.when(~F.col("key").startswith("record:"), F.substring("key", 1, 1)))
    return keyed.join(groups, "key", "left").select("id", "template_id", "sql", F.coalesce("grp", "key").alias("grp"), tier.alias("tier"))


def _tagged(records: DataFrame) -> DataFrame:
    return pipeline.stratified_split(records.groupBy("grp").agg(F.count("*").alias("n"), F.min("tier").alias("tier")))


def _pinned(spark: SparkSession, d: str) -> DataFrame:
    tagged = materialize(_tagged(_grouped(spark, d)))
    return pipeline.pinned_split(tagged.select("grp"), tagged.where("tier = 'e'").select("grp", "split"))


def _split_leakage(spark: SparkSession, d: str) -> DataFrame:
    """Templates and statements in more than one split of d05; there should be none."""
    records = materialize(_grouped(spark, d))
    placed = records.join(_tagged(records).select("grp", "split"), "grp", "left").withColumn("split", F.coalesce("split", F.lit("none")))
    keys = {"template": name_key(F.col("template_id")), "statement": F.md5(pipeline.normal_text(F.col("sql")))}
    found = [pipeline.leakage(placed.select(key.alias("k"), "split"), "k").select(F.lit(kind).alias("kind"), "value", F.concat_ws("+", "splits").alias("splits")) for kind, key in keys.items()]
    return found[0].unionByName(found[1])


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Conversations over the shop's schema, split by the last digit of the id."""
    rendered = retrieval.render_schema(shop.TABLES)
    pairs = _pairs(spark, d).select("id", "template_id", "question", "sql")
    chats = pipeline.chat_records(pairs, "Answer with one SQL statement.", schema=rendered).select("id", "messages")
    digit = F.substring("id", -1, 1)
    split = F.when(digit.isin("0", "1"), "test").when(digit.isin("2", "3"), "validation").otherwise("train")
    once = pairs.withColumn("split", split)
    return pipeline.split_checks(chats.join(once, "id"), "Answer with one SQL statement.", rendered)


def _statistics(spark: SparkSession, d: str) -> DataFrame:
    m = Mart(spark, d)
    templates = spark.createDataFrame(_POOL_TEMPLATES, "template_id string, questions array<string>, sql string")
    slots = {"p1": ["warehouse", "limit"], "p2": ["region", "segment", "quarter"]}
    drawn = [expand.slot_combinations({n: pools.pool(m, n) for n in names}).select(F.lit(t).alias("template_id"), "slots") for t, names in slots.items()]
    found = expand.expand(templates, drawn[0].unionByName(drawn[1]))
    return expand.statistics(found).withColumn("slots_missing", F.lit(expand.slots_missing(found).count()))


_POOL_TEMPLATES = [
    ("p1", ["Which {limit} parts does {warehouse} hold most of?", "Show {limit} parts of {warehouse}."], "SELECT part_id FROM inv JOIN wh USING (wh_id) WHERE wh = '{warehouse}' ORDER BY on_hand DESC LIMIT {limit}"),
    ("p2", ["How many {segment} customers of {region} ordered in quarter {quarter}?"], "SELECT count(DISTINCT cust_id) FROM ord JOIN cust USING (cust_id) WHERE segment = '{segment}' AND region = '{region}' AND extract(quarter FROM placed) = {quarter}"),
]


#: Rows of invented tables in ``l06``, in the order of the shop's tables.
_INVENTED = dict(zip((t.name for t in shop.TABLES), (200, 40, 12, 10, 400, 3000, 1500, 20_000, 60_000, 20_000, 20_000, 6000), strict=True))


def _invented(spark: SparkSession, d: str) -> DataFrame:
    """Rows, keys and foreign keys without a match of invented tables."""
    tables, out = synthetic_schema(spark, shop.TABLES, _INVENTED, seed=7), None
    for info in shop.TABLES:
        frame = tables[info.name]
        lost = [frame.where(F.col(c).isNotNull()).join(tables[to].select(F.col(_SHOP_KEY[to]).alias(c)), c, "left_anti").count() for c, to in info.foreign.items()]
        one = frame.agg(F.lit(info.name).alias("table_name"), F.count("*").alias("rows"), F.countDistinct(info.key).alias("keys"), F.lit(sum(lost)).alias("orphans"))
        out = one if out is None else out.unionByName(one)
    return out


_SHOP_KEY = {t.name: t.key for t in shop.TABLES}


def _shop(spark: SparkSession, d: str) -> tuple[list[retrieval.TableInfo], dict[str, DataFrame]]:
    frames = {n: table(spark, d, n) for n in ("categories", "products", "suppliers", "customer", "orders", "nation", "region")}
    foreign = {"products": {"category_id": "categories", "supplier_id": "suppliers"}, "categories": {"parent_category_id": "categories"}, "customer": {"c_nationkey": "nation"}, "orders": {"o_custkey": "customer"}, "nation": {"n_regionkey": "region"}}
    return [retrieval.TableInfo.of(n, f, foreign=foreign.get(n)) for n, f in frames.items()], frames


def _shop_values(frames: dict[str, DataFrame]) -> DataFrame:
    """The value index over all stored tables of the shop, as small as their vocabularies."""
    return materialize(retrieval.value_index(frames))


def t01_table_scores(spark: SparkSession, d: str) -> DataFrame:
    infos, frames = _shop(spark, d)
    asked = table(spark, d, "results_smoke").select("example_id", "question").dropDuplicates(["example_id"])
    return retrieval.score_tables(asked, infos, _shop_values(frames), key="example_id").select(F.col("key").alias("example_id"), F.col("table").alias("table_name"), "score")


def _names_index(spark: SparkSession, d: str) -> DataFrame:
    _, frames = _shop(spark, d)
    return retrieval.value_index({n: frames[n] for n in ("nation", "region", "orders")})


def t03_retrieval_quality(spark: SparkSession, d: str) -> DataFrame:
    """How often the tables of a gold statement are among those selected from the questions' twelve tables; needed tables outside these are missed."""
    asked = table(spark, d, "results_smoke").select("example_id", "question", "gold_sql", "predicted_sql", "correct").dropDuplicates(["example_id"])
    place = F.split("place", r"\.")
    values = _shop_values(_shop(spark, d)[1]).withColumn("place", F.concat_ws(".", F.coalesce(*(F.when(place[0] == stored, name) for stored, name in shop.STANDS_FOR.items()), place[0]), place[1]))
    scored = retrieval.score_tables(asked, shop.TABLES, values, key="example_id").withColumnRenamed("key", "example_id")
    selected = retrieval.selected_tables(asked, scored, shop.TABLES, "example_id")
    read = lambda sql: F.coalesce(retrieval.tables_of(F.col(sql)), F.array().cast("array<string>"))
    needed = asked.select("example_id", read("gold_sql").alias("needed"), read("predicted_sql").alias("used"), "correct")
    return retrieval.retrieval_quality(needed.join(selected, "example_id"))


def w01_events_by_hour(spark: SparkSession, d: str) -> DataFrame:
    out = streams.run_available(streams.windowed_totals(streams.with_end(spark, f"{d}/[e]vents.parquet")), "append")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "value")


def w02_sessions(spark: SparkSession, d: str) -> DataFrame:
    out = streams.run_available(streams.sessions(streams.with_end(spark, f"{d}/[e]vents.parquet")), "append")
    return out.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("began"), "n")


def w03_events_once(spark: SparkSession, d: str) -> DataFrame:
    out = streams.run_available(streams.without_repeats(streams.event_stream(spark, f"{d}/[e]vents.parquet")), "append")
    return out.groupBy("event_type").agg(F.count("*").alias("n"))


def _expanded(spark: SparkSession, d: str) -> DataFrame:
    m = Mart(spark, d)
    rows = [("c1", ["Which customers are from {country}?", "Show customers of {country}."], "SELECT * FROM cust WHERE country = '{country}'"), ("c2", ["How many orders are there in {year} with status {status}?"], "SELECT count(*) FROM ord WHERE status = '{status}' AND year(placed) = {year}")]
    templates = spark.createDataFrame(rows, "template_id string, questions array<string>, sql string")
    one = expand.slot_combinations({"country": expand.categorical_pool(m.area, "country")}).select(F.lit("c1").alias("template_id"), "slots")
    two = expand.slot_combinations({"status": expand.categorical_pool(m.ord, "status"), "year": expand.calendar_pool(m.ord, "placed")}).select(F.lit("c2").alias("template_id"), "slots")
    return expand.expand(templates, one.unionByName(two)).select("template_id", "question", "sql")


def _cube(how: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = Mart(spark, d).ord.select("status", "priority", "ord_id")
        return getattr(rows, how)("status", "priority").agg(F.count("*").alias("n"), F.grouping_id().cast("bigint").alias("level"))

    return query


def _staff_sql(view: str) -> str:
    return f"WITH RECURSIVE chart (emp_id, depth) AS (SELECT emp_id, CAST(0 AS BIGINT) FROM {view} WHERE boss_id IS NULL UNION ALL SELECT e.emp_id, c.depth + 1 FROM chart c JOIN {view} e ON e.boss_id = c.emp_id) SELECT emp_id, depth FROM chart"


def _recursive(spark: SparkSession, d: str) -> DataFrame:
    Mart(spark, d).emp.createOrReplaceTempView("tamarack_staff")
    return spark.sql(_staff_sql("tamarack_staff"))


QUERIES = {
    "a01_metric_totals": lambda s, d: metrics.summarise(_res(s, d)),
    "a02_metrics_by_difficulty": lambda s, d: metrics.breakdown(_res(s, d), "difficulty"),
    "a03_metrics_by_domain": lambda s, d: metrics.breakdown(_res(s, d), "domain"),
    "a04_metrics_by_query_type": lambda s, d: metrics.breakdown(_res(s, d), "query_type"),
    "a05_latency": lambda s, d: metrics.latency(_res(s, d)),
    "a06_latency_by_difficulty": lambda s, d: metrics.latency(_res(s, d), bucket="difficulty"),
    "a07_outcome_rates": lambda s, d: metrics.outcome_rates(_res(s, d)),
    "a08_failure_patterns": lambda s, d: metrics.failure_patterns(_res(s, d)),
    "a09_failure_tags": lambda s, d: metrics.failure_tags(_res(s, d)).groupBy("tag").agg(F.count("*").alias("n")),
    "a10_row_count_failures": lambda s, d: metrics.row_count_failures(_res(s, d)),
    "a11_repairs_folded_in": lambda s, d: metrics.outcome_rates(metrics.with_repairs(_res(s, d), _res(s, d).where("projection_match").select("example_id", F.lit(True).alias("correct"), F.lit("correct").alias("outcome")))),
    "a12_ablation": lambda s, d: metrics.ablation(_runs(s, d)),
    "a13_release_gate": lambda s, d: metrics.release_gate(_res(s, d), _runs(s, d).where("run = 'columns'"), 45.0, 60.0, 20.0),
    "a14_full_summary": lambda s, d: metrics.full_summary(_res(s, d, "prompt_tokens", "completion_tokens")),
    "a15_generation_latency": lambda s, d: metrics.latency(_res(s, d, "generation_latency_ms").where(~F.col("outcome").isin(*metrics.ERROR_RATES["generation_failed"])), "generation_latency_ms"),
    "a16_total_latency_by_domain": lambda s, d: metrics.latency(_res(s, d, "total_latency_ms"), "total_latency_ms", bucket="domain"),
    "a17_report_patterns": lambda s, d: metrics.report_patterns(_res(s, d)),
    "a18_failure_shapes": lambda s, d: shape.tagged(_res(s, d)).groupBy("tag").agg(F.count("*").alias("n")),
    "d01_screening": lambda s, d: pipeline.screen(_pairs(s, d)).groupBy("reason").agg(F.count("*").alias("n")),
    "d02_question_conflicts": lambda s, d: pipeline.question_conflicts(_pairs(s, d)),
    "d03_result_collisions": lambda s, d: pipeline.result_collisions(_pairs(s, d)),
    "d04_equivalence_groups": lambda s, d: pipeline.equivalence_groups(_pairs(s, d)),
    "k02_components_in_small_tasks": lambda s, d: pipeline.equivalence_groups(_pairs(s, d), task_links=40, hot_rows=10),
    "d05_stratified_split": lambda s, d: _tagged(_grouped(s, d)),
    "d06_pinned_split": _pinned,
    "d07_leakage": lambda s, d: pipeline.leakage(_pairs(s, d).select("template_id", F.when(F.substring("id", -1, 1).cast("int") < 3, "test").otherwise("train").alias("split")), "template_id").withColumn("splits", F.concat_ws("+", "splits")),
    "d08_chat_records": lambda s, d: pipeline.chat_records(_pairs(s, d), "Answer with one SQL statement.").select("id", F.element_at("messages", 2)["content"].alias("user"), F.size("messages").cast("bigint").alias("n"), F.col("meta.template_id").alias("template_id")),
    "d09_record_checks": lambda s, d: pipeline.record_checks(pipeline.chat_records(_pairs(s, d), "Answer."), _pairs(s, d).where("template_id like 'h%'")),
    "d10_answer_lengths": lambda s, d: pipeline.length_stats(_pairs(s, d), F.col("sql")),
    "d11_categorical_pool": lambda s, d: expand.categorical_pool(Mart(s, d).vend, "country"),
    "d12_calendar_pool": lambda s, d: expand.calendar_pool(Mart(s, d).ord, "placed", before_last=True),
    "d13_quantile_pool": lambda s, d: expand.quantile_pool(Mart(s, d).ord, F.col("total"), 0),
    "d14_discrete_pool": lambda s, d: expand.discrete_pool(Mart(s, d).item, F.col("line")),
    "d15_expanded_questions": _expanded,
    "d16_split_leakage": _split_leakage,
    "d17_split_table": lambda s, d: _tagged((g := materialize(_grouped(s, d)))).join(g.groupBy("grp").agg(F.count("*").alias("n")), "grp").groupBy("tier", "n", "split").agg(F.count("*").alias("groups")),
    "d18_pinned_table": lambda s, d: _pinned(s, d).groupBy("split", "conflict").agg(F.count("*").alias("groups")),
    "d19_screening_in_full": lambda s, d: pipeline.screen_fully(_pairs(s, d), [t.name for t in shop.TABLES]).groupBy("reason").agg(F.count("*").alias("n")),
    "d20_split_checks": _records,
    "d21_named_pools": lambda s, d: pools.named_pools(Mart(s, d)),
    "d22_numeric_pools": lambda s, d: pools.numeric_pools(Mart(s, d)),
    "d23_expansion_statistics": _statistics,
    "l01_stride_sample": lambda s, d: records.stride_sample(Mart(s, d).ord.select("ord_id", "placed"), 97, ["placed", "ord_id"]),
    "l02_not_done_yet": lambda s, d: records.not_done(table(s, d, "results_smoke").select("example_id").distinct(), table(s, d, "generations_smoke")),
    "l03_statements_side_by_side": lambda s, d: records.showcase({"gold": _pairs(s, d).select(F.col("id").alias("example_id"), "sql"), "reply": table(s, d, "generations_smoke").select("example_id", "sql").distinct()}),
    "l04_table_fingerprint": lambda s, d: table_fingerprint(table(s, d, "orders").select("o_orderkey", "o_orderstatus")),
    "l05_quality_of_tables": lambda s, d: quality(register(s, d)),
    "l06_invented_tables": _invented,
    "t01_table_scores": t01_table_scores,
    "t02_value_index": _names_index,
    "t03_retrieval_quality": t03_retrieval_quality,
    "t04_value_index_of_all_tables": lambda s, d: retrieval.value_index(_shop(s, d)[1]),
    "u01_union": lambda s, d: Mart(s, d).vend.select("country").union(Mart(s, d).area.select("country")).distinct(),
    "u02_intersect": lambda s, d: Mart(s, d).ord.select("cust_id").where("cust_id % 3 = 0").intersect(Mart(s, d).cust.where("not active").select("cust_id")),
    "u03_except": lambda s, d: Mart(s, d).cust.select("cust_id").subtract(Mart(s, d).ord.where("status = 'P'").select("cust_id")),
    "u04_rollup": _cube("rollup"),
    "u05_cube": _cube("cube"),
    "u06_predicates": lambda s, d: Mart(s, d).ord.where(F.col("priority").like("%-H%") & F.col("total").between(100000, 300000) & ~F.col("rep_id").eqNullSafe(7) & F.col("status").isin("F", "O") & (F.to_date("placed") < F.col("due"))).select("ord_id", "priority", "rep_id"),
    "u07_recursion_in_sql": lambda s, d: _recursive(s, d),
    "u08_bounds_cross_join": lambda s, d: (lambda o: o.crossJoin(F.broadcast(o.agg(F.min("total").alias("lo"), F.max("total").alias("hi")))).where("total < lo * 1.05 or total > hi * 0.99").select("ord_id", "total"))(Mart(s, d).ord),
    "w01_events_by_hour": w01_events_by_hour,
    "w02_sessions": w02_sessions,
    "w03_events_once": w03_events_once,
}

#: Groups of templates that share a statement, dealt one by one: in each tier, largest first, to the split that lacks most.
_GREEDY = f"""WITH RECURSIVE recs AS (SELECT DISTINCT example_id AS id, gold_sql AS sql, {letters_sql("difficulty")} AS rated, coalesce({name_key_sql("template_id")}, 'record:' || example_id) AS key FROM results_smoke),
e AS (SELECT DISTINCT key AS k, md5({_NORMAL.format("sql")}) AS q FROM recs WHERE sql IS NOT NULL), near AS (SELECT DISTINCT x.k AS a, y.k AS b FROM e x JOIN e y USING (q) WHERE x.k <> y.k),
reach AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b), top AS (SELECT a AS key, min(least(a, b)) AS grp FROM reach GROUP BY 1),
tiered AS (SELECT coalesce(grp, key) AS grp, coalesce(CASE rated {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TIERS.items())} END, CASE WHEN key NOT LIKE 'record:%' THEN key[1] END) AS tier FROM recs LEFT JOIN top USING (key)),
grps AS (SELECT grp, coalesce(min(tier), '') AS tier, count(*) AS n FROM tiered GROUP BY 1),
seq AS (SELECT tier, n, row_number() OVER (PARTITION BY tier ORDER BY n DESC) AS i FROM grps),
walk AS (SELECT tier, 0::BIGINT AS i, 0::BIGINT AS n, CAST(7000 * sum(n) AS BIGINT) AS a, CAST(1500 * sum(n) AS BIGINT) AS b, CAST(1500 * sum(n) AS BIGINT) AS c, '' AS pick FROM grps GROUP BY tier
  UNION ALL SELECT tier, i, n, a - CASE p WHEN 'train' THEN 10000 * n ELSE 0 END, b - CASE p WHEN 'validation' THEN 10000 * n ELSE 0 END, c - CASE p WHEN 'test' THEN 10000 * n ELSE 0 END, p
  FROM (SELECT s.tier, s.i, s.n, a, b, c, CASE WHEN a >= b AND a >= c THEN 'train' WHEN b >= c THEN 'validation' ELSE 'test' END AS p FROM walk w JOIN seq s ON s.tier = w.tier AND s.i = w.i + 1))"""


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _asked_sql() -> str:
    """Words, kept words and terms of every question."""
    return f"""asked AS (SELECT example_id, any_value(regexp_extract_all(lower(question), '[a-z0-9]+')) AS words, any_value(gold_sql) AS gold_sql FROM results_smoke GROUP BY 1),
kept AS (SELECT DISTINCT example_id, w FROM (SELECT example_id, unnest(words) AS w FROM asked) WHERE w NOT IN ({_list(sorted(retrieval.STOPWORDS))})),
terms AS (SELECT DISTINCT example_id, CASE WHEN length(w) > 4 AND w LIKE '%ies' THEN w[:-4] || 'y' WHEN length(w) > 4 AND regexp_matches(w, '(x|ch|sh|ss)es$') THEN w[:-3] WHEN length(w) > 3 AND regexp_matches(w, 's$') AND NOT regexp_matches(w, '(ss|us|is)$') THEN w[:-2] ELSE w END AS term FROM kept)"""


def _scores_sql(tables: list[tuple[str, list[str], list[str]]], stored: dict[str, list[str]], renamed: dict[str, str]) -> str:
    """Scores of tables (name, columns, comments), with the values of the stored text columns; ``renamed`` tells what a stored table stands for."""
    rows = []
    for t, columns, comments in tables:
        parts = [("name", t, retrieval._known(t)), *(("column", c, retrieval._known(c)) for c in columns), ("comment", "", sorted({w for c in comments for w in retrieval._known(c)}))]
        rows += [f"('{t}', '{kind}', '{place}', '{term}', {len(found)})" for kind, place, found in parts for term in found]
    values = [f"SELECT lower(trim({c})) AS v, '{renamed.get(t, t)}.{c}' AS place, '{renamed.get(t, t)}' AS tbl FROM {t} WHERE {c} IS NOT NULL AND (SELECT count(DISTINCT {c}) FROM {t}) <= {retrieval.MOST_VALUES}" for t, columns in stored.items() for c in columns]
    return f"""{_asked_sql()}, scheme (tbl, kind, place, term, size) AS (VALUES {", ".join(rows)}),
hits AS (SELECT example_id, tbl, kind, size, count(*) AS k FROM terms JOIN scheme USING (term) GROUP BY example_id, tbl, kind, place, size),
vals AS (SELECT DISTINCT * FROM ({" UNION ALL ".join(values)})), stored AS (SELECT DISTINCT term, place, tbl FROM (SELECT v AS term, place, tbl FROM vals UNION ALL SELECT term, place, tbl FROM (SELECT unnest(regexp_extract_all(v, '[a-z0-9]+')) AS term, place, tbl FROM vals) WHERE length(term) > 2) WHERE length(term) > 1),
shared AS (SELECT term, tbl, CAST({retrieval.VALUE}::DOUBLE / count(*) OVER (PARTITION BY term) AS DECIMAL(18,6)) AS weight FROM stored),
single AS (SELECT DISTINCT example_id, w FROM (SELECT example_id, w FROM kept UNION ALL SELECT example_id, term FROM terms)),
told AS (SELECT example_id, tbl, weight FROM single JOIN shared ON w = term WHERE term NOT LIKE '% %'
  UNION ALL SELECT example_id, tbl, weight FROM asked JOIN (SELECT *, array_to_string(regexp_extract_all(term, '[a-z0-9]+'), ' ') AS said FROM shared WHERE term LIKE '% %') m ON said <> '' AND contains(' ' || array_to_string(words, ' ') || ' ', ' ' || said || ' ') WHERE contains(said, ' ') OR said IN (SELECT w FROM single s WHERE s.example_id = asked.example_id)),
scored AS (SELECT example_id, tbl, round(CAST(sum(weight) AS DOUBLE), 6) AS score FROM (
  SELECT example_id, tbl, CAST(CASE kind WHEN 'name' THEN {retrieval.NAME}::DOUBLE * k WHEN 'column' THEN {retrieval.COLUMN}::DOUBLE * k * k / size ELSE {retrieval.COMMENT}::DOUBLE * k END AS DECIMAL(18,6)) AS weight FROM hits UNION ALL SELECT example_id, tbl, weight FROM told) GROUP BY 1, 2)"""


_SHOP_COLUMNS = {
    "categories": "category_id category_name* parent_category_id description* created_at",
    "products": "product_id product_name* sku* category_id supplier_id unit_price unit_cost weight_kg is_discontinued created_at",
    "suppliers": "supplier_id supplier_name* contact_name* contact_email* phone* country* city* rating is_active created_at",
    "customer": "c_custkey c_name* c_nationkey c_acctbal c_mktsegment*",
    "orders": "o_orderkey o_custkey o_orderstatus* o_totalprice o_orderdate o_orderpriority*",
    "nation": "n_nationkey n_name* n_regionkey",
    "region": "r_regionkey r_name*",
}
_TEXTS = {t: [c[:-1] for c in columns.split() if c.endswith("*")] for t, columns in _SHOP_COLUMNS.items()}
_SHOP_SQL = _scores_sql([(t, columns.replace("*", "").split(), []) for t, columns in _SHOP_COLUMNS.items()], _TEXTS, {})

def _quality_sql() -> str:
    graph, names = retrieval.neighbours(shop.TABLES), [t.name for t in shop.TABLES]
    ways = ", ".join(f"('{a}', '{b}', [{_list(retrieval.shortest_path(graph, a, b))}])" for a in names for b in names if a != b)
    tables = [(t.name, list(t.columns), [t.comment, *t.comments.values()]) for t in shop.TABLES]
    read = lambda sql: f"""(CASE WHEN {sql} IS NULL THEN [] WHEN (json_serialize_sql({sql})->>'error') = 'false' THEN list_distinct([lower(x) FOR x IN (json_serialize_sql({sql})->>'$..table_name') IF x <> '' AND NOT list_contains(coalesce(json_serialize_sql({sql})->>'$..cte_map.map[*].key', []), x)])
  ELSE list_filter(list_distinct(regexp_extract_all(regexp_replace(lower({sql}), 'extract\\s*\\(\\s*\\w+\\s+from\\s', '(', 'g'), '\\b(?:from|join)\\s+["`]?([a-z_]+)', 1)), lambda t: NOT regexp_matches(lower({sql}), '(with|,)\\s+' || t || '\\s+as\\s*\\(')) END)"""  # noqa: E731
    return f"""WITH {_scores_sql(tables, _TEXTS, shop.STANDS_FOR)}, pos (tbl, place_no) AS (VALUES {", ".join(f"('{n}', {i})" for i, n in enumerate(names))}), ways (a, b, path) AS (VALUES {ways}),
ranked AS (SELECT example_id, tbl, score, row_number() OVER (PARTITION BY example_id ORDER BY score DESC, place_no) AS rk, max(score) OVER (PARTITION BY example_id) AS best FROM scored JOIN pos USING (tbl)),
chosen AS (SELECT * FROM ranked WHERE rk <= {retrieval.MOST_TABLES} AND score >= {retrieval.FLOOR}::DOUBLE * best AND score > 0),
reached AS (SELECT example_id, tbl FROM chosen UNION SELECT x.example_id, unnest(path) FROM chosen x JOIN chosen y ON x.example_id = y.example_id AND x.rk < y.rk JOIN ways ON a = x.tbl AND b = y.tbl),
f AS (SELECT coalesce(selected, [{_list(names)}]) AS selected, {read("gold_sql")} AS needed, {read("predicted_sql")} AS used, correct
  FROM (SELECT DISTINCT example_id, gold_sql, predicted_sql, correct FROM results_smoke) r LEFT JOIN (SELECT example_id, list(tbl) AS selected FROM reached GROUP BY 1) USING (example_id)),
g AS (SELECT *, len(list_intersect(selected, needed)) AS found_n, len(list_intersect(selected, needed)) = len(needed) AS whole FROM f)
SELECT count(*) AS n, 100.0::DOUBLE * sum(found_n) / sum(len(needed)) AS recall, 100.0::DOUBLE * count(*) FILTER (whole) / count(*) AS complete, 100.0::DOUBLE * sum(found_n) / sum(len(selected)) AS precision, CAST(sum(len(selected)) AS DOUBLE) / count(*) AS tables_shown,
  100.0::DOUBLE * count(*) FILTER (correct AND whole) / nullif(count(*) FILTER (whole), 0) AS accuracy_complete, 100.0::DOUBLE * count(*) FILTER (correct AND NOT whole) / nullif(count(*) FILTER (NOT whole), 0) AS accuracy_incomplete,
  100.0::DOUBLE * count(*) FILTER (len([x FOR x IN used IF NOT list_contains(selected, x)]) > 0) / count(*) AS used_unseen FROM g"""


_R = f"WITH {_RES}"
_RATES = ", ".join(f"100.0::DOUBLE * count(*) FILTER (outcome IN ({', '.join(repr(o) for o in outcomes)})) / CAST(count(*) AS DOUBLE) AS {name}_pct" for name, outcomes in metrics.ERROR_RATES.items())
_TOKENS_SQL = ", ".join(f"CAST(sum({c}) FILTER ({c} <> 0) AS BIGINT) AS {c}_total, CAST(sum({c}) FILTER ({c} <> 0) AS DOUBLE) / count(*) FILTER ({c} <> 0) AS {c}_mean" for c in ("prompt_tokens", "completion_tokens"))
#: The shape of a statement by the other engine's own parser.
_PARSED = """j AS (SELECT s, json_serialize_sql(s) AS j FROM (SELECT gold_sql AS s FROM wrong UNION SELECT predicted_sql FROM wrong)),
shape AS (SELECT s, (j->>'error') <> 'true' AS parsed, list_sort(list_distinct([lower(x) FOR x IN (j->>'$..table_name') IF x <> '' AND NOT list_contains(coalesce(j->>'$..cte_map.map[*].key', []), x)])) AS tables,
  len(regexp_extract_all(j::VARCHAR, '"ref_type":"')) AS joins, regexp_matches(j::VARCHAR, '"group_expressions":\\[\\{') AS grouped, regexp_matches(j::VARCHAR, '"having":\\{') AS having_, regexp_matches(j::VARCHAR, '"class":"WINDOW"') AS windows,
  regexp_matches(j::VARCHAR, '"LIMIT_MODIFIER","limit":\\{') AS lim, regexp_matches(j::VARCHAR, '"OPERATOR_COALESCE"|"function_name":"nullif"') AS nulls, regexp_matches(j::VARCHAR, '"DISTINCT_MODIFIER"|"distinct":true') AS dist FROM j)"""
_P = f"WITH {_PAIRS}"
_M = f"WITH {SQL_VIEWS}"
_SHAPE = [("joins", r"len(regexp_extract_all({}, '(?i)\bjoin\b'))"), ("groups", r"regexp_matches({}, '(?i)\bgroup\s+by\b')"), ("having", r"regexp_matches({}, '(?i)\bhaving\b')"), ("limit", r"regexp_matches({}, '(?i)\blimit\b')"), ("windows", r"regexp_matches({}, '(?i)\bover\s*\(')"), ("distinct", r"regexp_matches({}, '(?i)\bdistinct\b')"), ("sorted", r"regexp_matches({}, '(?i)\border\s+by\b')")]
_TAGS = ", ".join(f"CASE WHEN {e.format('gold_sql')} <> {e.format('predicted_sql')} THEN 'other_{n}' END" for n, e in _SHAPE)
_PATTERN_SQL = "CASE " + " ".join(f"WHEN regexp_matches(gold_sql, '{p}') THEN '{n}'" for n, p in metrics._PATTERNS) + " ELSE 'plain' END"
ORACLE = {
    "a01_metric_totals": f"{_R} SELECT {_FIGURES} FROM res",
    "a02_metrics_by_difficulty": f"{_R} SELECT difficulty AS value, {_FIGURES} FROM res GROUP BY 1",
    "a03_metrics_by_domain": f"{_R} SELECT domain AS value, {_FIGURES} FROM res GROUP BY 1",
    "a04_metrics_by_query_type": f"{_R} SELECT value, {_FIGURES} FROM (SELECT *, unnest(query_type) AS value FROM res) GROUP BY 1",
    "a05_latency": _latency_sql(),
    "a06_latency_by_difficulty": _latency_sql("difficulty"),
    "a07_outcome_rates": f"{_R} SELECT outcome, count(*) AS n, 100.0::DOUBLE * count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS pct FROM res GROUP BY outcome",
    "a08_failure_patterns": f"{_R} SELECT {_PATTERN_SQL} AS pattern, outcome, count(*) AS n FROM res WHERE NOT correct GROUP BY 1, 2",
    "a09_failure_tags": f"{_R}, t AS (SELECT [x FOR x IN [{_TAGS}] IF x IS NOT NULL] AS tags FROM res WHERE NOT correct AND predicted_sql IS NOT NULL) SELECT tag, count(*) AS n FROM (SELECT unnest(CASE WHEN len(tags) > 0 THEN tags ELSE ['values_only'] END) AS tag FROM t) GROUP BY 1",
    "a10_row_count_failures": f"{_R} SELECT CASE WHEN predicted_row_count = 0 THEN 'empty' WHEN predicted_row_count < gold_row_count THEN 'fewer' WHEN predicted_row_count > gold_row_count THEN 'more' ELSE 'as_many' END AS rows, count(*) AS n FROM res WHERE NOT correct AND predicted_row_count IS NOT NULL GROUP BY 1",
    "a11_repairs_folded_in": f"{_R} SELECT CASE WHEN projection_match THEN 'correct' ELSE outcome END AS outcome, count(*) AS n, 100.0::DOUBLE * count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS pct FROM res GROUP BY 1",
    "a12_ablation": f"{_R} SELECT difficulty, 100.0::DOUBLE * count(*) FILTER (correct OR coalesce(projection_match, FALSE)) / CAST(count(*) AS DOUBLE) AS columns, 100.0::DOUBLE * count(*) FILTER (correct) / CAST(count(*) AS DOUBLE) AS strict FROM res GROUP BY difficulty",
    "a13_release_gate": f"""{_R}, f AS (SELECT {_FIGURES} FROM res), g AS (SELECT difficulty, 100.0::DOUBLE * count(*) FILTER (correct) / CAST(count(*) AS DOUBLE) AS mine, 100.0::DOUBLE * count(*) FILTER (correct OR coalesce(projection_match, FALSE)) / CAST(count(*) AS DOUBLE) AS old FROM res GROUP BY 1),
v AS (SELECT 'accuracy' AS "check", accuracy AS value, 45.0::DOUBLE AS threshold, accuracy >= 45 AS passed FROM f UNION ALL SELECT 'executable', executable, 60.0, executable >= 60 FROM f UNION ALL SELECT 'lost in ' || coalesce(difficulty, 'none'), old - mine, 20.0, old - mine <= 20 FROM g) SELECT * FROM v""",
    "a14_full_summary": f"""WITH {_RES.replace("question,", "question, prompt_tokens, completion_tokens,")} SELECT count(*) AS n, count(*) FILTER (correct) AS correct, 100.0::DOUBLE * count(*) FILTER (correct) / CAST(count(*) AS DOUBLE) AS accuracy,
  count(*) FILTER (outcome NOT IN ({_NOT_RUN})) AS executable, 100.0::DOUBLE * count(*) FILTER (outcome NOT IN ({_NOT_RUN})) / CAST(count(*) AS DOUBLE) AS executable_pct, count(*) FILTER (outcome = 'wrong_result') AS wrong_result,
  count(*) FILTER (projection_match) AS projection_only, count(*) FILTER (outcome = 'wrong_result' AND projection_match IS NOT TRUE) AS other_rows, count(*) FILTER (correct) + count(*) FILTER (projection_match) AS tolerant_correct,
  100.0::DOUBLE * (count(*) FILTER (correct) + count(*) FILTER (projection_match)) / CAST(count(*) AS DOUBLE) AS tolerant_accuracy, {_RATES},
  count(strict_correct) AS strict_n, count(*) FILTER (strict_correct) AS strict_correct, 100.0::DOUBLE * count(*) FILTER (strict_correct) / CAST(count(strict_correct) AS DOUBLE) AS strict_accuracy, {_TOKENS_SQL} FROM res""",
    "a15_generation_latency": _latency_sql(column="generation_latency_ms", where="outcome NOT IN ('generation_failed', 'generation_error')"),
    "a16_total_latency_by_domain": _latency_sql("domain", "total_latency_ms"),
    "a17_report_patterns": f"""{_R}, w AS (SELECT upper(gold_sql) AS g, upper(coalesce(predicted_sql, '')) AS p, coalesce(gold_row_count, 0) AS gn, coalesce(predicted_row_count, -1) AS pn FROM res WHERE outcome = 'wrong_result' AND projection_match IS NOT TRUE)
SELECT CASE WHEN pn = 0 AND gn > 0 THEN 'no rows' WHEN g LIKE '%LIMIT%' AND p NOT LIKE '%LIMIT%' THEN 'limit dropped' WHEN p LIKE '%LIMIT%' AND g NOT LIKE '%LIMIT%' THEN 'limit added' WHEN p LIKE '%LEFT JOIN%' AND g NOT LIKE '%LEFT JOIN%' THEN 'left join for inner'
  WHEN g LIKE '%LEFT JOIN%' AND p NOT LIKE '%LEFT JOIN%' THEN 'inner join for left' WHEN p LIKE '%DISTINCT%' AND g NOT LIKE '%DISTINCT%' THEN 'distinct added' WHEN gn > 0 AND pn > 0 AND pn > gn * 1.05::DOUBLE THEN 'too many rows'
  WHEN gn > 0 AND pn > 0 AND pn < gn * 0.95::DOUBLE THEN 'too few rows' ELSE 'other values' END AS pattern, count(*) AS n FROM w GROUP BY 1""",
    "a18_failure_shapes": f"""{_R}, wrong AS (SELECT * FROM res WHERE outcome = 'wrong_result' AND predicted_sql IS NOT NULL), {_PARSED}
SELECT CASE WHEN NOT (g.parsed AND p.parsed) THEN 'unparsed' WHEN g.tables <> p.tables THEN 'wrong_tables' WHEN g.joins <> p.joins THEN 'join_structure' WHEN g.grouped <> p.grouped OR g.having_ <> p.having_ THEN 'aggregation_structure' WHEN g.windows <> p.windows THEN 'window_function'
  WHEN g.lim AND (predicted_row_count <> gold_row_count OR NOT p.lim) THEN 'limit_or_ranking' WHEN g.nulls <> p.nulls THEN 'null_handling' WHEN g.dist <> p.dist THEN 'distinct' ELSE 'filter_logic' END AS tag, count(*) AS n
FROM wrong JOIN shape g ON g.s = gold_sql JOIN shape p ON p.s = predicted_sql GROUP BY 1""",
    "d01_screening": f"""{_P} SELECT CASE WHEN trim(coalesce(question, '')) = '' THEN 'empty_question' WHEN trim(coalesce(sql, '')) = '' THEN 'empty_sql' WHEN NOT regexp_matches(sql, '(?is)^\\s*(select|with)\\b') OR regexp_matches(sql, '(?i)\\b(insert|update|delete|drop|alter|create|truncate)\\s') THEN 'not_read_only'
  WHEN coalesce(row_count, 0) = 0 THEN 'empty_result' WHEN place > 1 THEN 'duplicate' END AS reason, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY {_NORMAL.format('question')}, {_NORMAL.format('sql')} ORDER BY id) AS place FROM pairs) GROUP BY 1""",
    "d02_question_conflicts": f"{_P} SELECT {_NORMAL.format('question')} AS question, count(DISTINCT {_NORMAL.format('sql')}) AS statements, count(DISTINCT fingerprint) AS results FROM pairs GROUP BY 1 HAVING count(DISTINCT {_NORMAL.format('sql')}) > 1 OR count(DISTINCT fingerprint) > 1",
    "d03_result_collisions": f"{_P} SELECT fingerprint AS result, count(DISTINCT {_NORMAL.format('sql')}) AS statements FROM pairs WHERE fingerprint IS NOT NULL GROUP BY 1 HAVING count(DISTINCT {_NORMAL.format('sql')}) > 1",
    "d04_equivalence_groups": f"""WITH RECURSIVE {_PAIRS}, e AS (SELECT DISTINCT template_id AS k, md5({_NORMAL.format('sql')}) AS q FROM pairs WHERE template_id IS NOT NULL AND sql IS NOT NULL),
near AS (SELECT DISTINCT x.k AS a, y.k AS b FROM e x JOIN e y USING (q)), reach AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b) SELECT a AS value, min(b) AS grp FROM reach GROUP BY a""",
    "d07_leakage": f"{_P}, v AS (SELECT template_id, CASE WHEN CAST(right(id, 1) AS INTEGER) < 3 THEN 'test' ELSE 'train' END AS split FROM pairs) SELECT template_id AS value, array_to_string(list_sort(list(DISTINCT split)), '+') AS splits FROM v WHERE template_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1",
    "d09_record_checks": f"""{_P}, h AS (SELECT DISTINCT {_NORMAL.format('question')} AS q FROM pairs WHERE template_id LIKE 'h%')
SELECT unnest(['three messages', 'order of roles', 'empty question', 'empty answer', 'answer is no query', 'fence in answer', 'repeated ids', 'in held-out questions']) AS "check",
  unnest([0, 0, count(*) FILTER (trim(coalesce(question, '')) = ''), count(*) FILTER (trim(coalesce(sql, '')) = ''), count(*) FILTER (NOT regexp_matches(coalesce(sql, ''), '(?is)^\\s*(select|with)\\b')), count(*) FILTER (contains(coalesce(sql, ''), '```')), count(*) - count(DISTINCT id), count(*) FILTER ({_NORMAL.format('question')} IN (SELECT q FROM h))]) AS failed FROM pairs""",
    "d10_answer_lengths": f"{_P}, w AS (SELECT CAST(len(regexp_split_to_array(trim(sql), '\\s+')) AS DOUBLE) AS v FROM pairs), r AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS r, count(*) OVER () AS n FROM w) SELECT count(*) AS n, {exact_mean('v')} AS mean, max(v) AS high, max(CASE WHEN r = least(floor(0.99::DOUBLE * n), n - 1) THEN v END) AS p99 FROM r",
    "d08_chat_records": f"{_P} SELECT id, question AS user, 3::BIGINT AS n, template_id FROM pairs",
    "d11_categorical_pool": f"{_M} SELECT DISTINCT country AS value FROM vend",
    "d12_calendar_pool": f"{_M} SELECT DISTINCT extract(year FROM placed) AS value FROM ord WHERE extract(year FROM placed) < (SELECT max(extract(year FROM placed)) FROM ord)",
    "d13_quantile_pool": f"{_M}, q AS (SELECT unnest(quantile_cont(total, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS x, min(total) AS lo, max(total) AS hi FROM ord) SELECT DISTINCT round(x, 0) AS value FROM q WHERE round(x, 0) > lo AND round(x, 0) < hi",
    "d14_discrete_pool": f"{_M} SELECT DISTINCT CAST(line AS BIGINT) AS value FROM item WHERE line < (SELECT max(line) FROM item)",
    "d15_expanded_questions": f"""{_M}, y AS (SELECT DISTINCT extract(year FROM placed) AS year FROM ord), st AS (SELECT DISTINCT status FROM ord)
SELECT 'c1' AS template_id, replace(q, '*', country) AS question, 'SELECT * FROM cust WHERE country = ''' || country || '''' AS sql FROM area, (SELECT unnest(['Which customers are from *?', 'Show customers of *.']) AS q)
UNION ALL SELECT 'c2', 'How many orders are there in ' || year || ' with status ' || status || '?', 'SELECT count(*) FROM ord WHERE status = ''' || status || ''' AND year(placed) = ' || year FROM y, st""",
    "d16_split_leakage": "SELECT '' AS kind, '' AS value, '' AS splits WHERE FALSE",
    "d17_split_table": f"{_GREEDY} SELECT tier, n, pick AS split, count(*) AS groups FROM walk WHERE i > 0 GROUP BY 1, 2, 3",
    "d18_pinned_table": f"{_GREEDY} SELECT CASE WHEN tier = 'e' THEN pick ELSE 'train' END AS split, FALSE AS conflict, count(*) AS groups FROM walk WHERE i > 0 GROUP BY 1",
    "d19_screening_in_full": f"""{_P}, read AS (SELECT *, CASE WHEN trim(coalesce(question, '')) = '' THEN 'empty_question' WHEN trim(coalesce(sql, '')) = '' THEN 'empty_sql' WHEN regexp_matches(sql, '(?i)^[\\s(]*(insert|update|delete|merge|drop|create|alter|truncate|grant|revoke|call|copy)\\b') THEN 'dangerous_sql'
  WHEN (json_serialize_sql(sql)->>'error') = 'true' THEN 'unparseable' WHEN len([x FOR x IN (json_serialize_sql(sql)->>'$..table_name') IF x <> '' AND NOT list_contains(coalesce(json_serialize_sql(sql)->>'$..cte_map.map[*].key', []), x) AND lower(x) NOT IN ({_list(t.name for t in shop.TABLES)})]) > 0 THEN 'unknown_table'
  WHEN coalesce(row_count, 0) = 0 THEN 'empty_result' END AS reason FROM pairs),
passed AS (SELECT *, row_number() OVER (PARTITION BY trim(question), {_NORMAL.format('sql')} ORDER BY id) AS place FROM read WHERE reason IS NULL),
asked AS (SELECT trim(question) AS q, count(DISTINCT {_NORMAL.format('sql')}) AS k FROM passed GROUP BY 1)
SELECT reason, count(*) AS n FROM (SELECT reason FROM read WHERE reason IS NOT NULL UNION ALL SELECT CASE WHEN place > 1 THEN 'duplicate_pair' WHEN k > 1 THEN 'conflicting_question' END FROM passed JOIN asked ON q = trim(question)) GROUP BY 1""",
    "d20_split_checks": f"""{_P}, r AS (SELECT *, {_NORMAL.format('sql')} AS norm, CASE WHEN right(id, 1) IN ('0', '1') THEN 'test' WHEN right(id, 1) IN ('2', '3') THEN 'validation' ELSE 'train' END AS split FROM pairs),
v AS (SELECT 'question' AS key, question AS v, split FROM r UNION ALL SELECT 'statement', norm, split FROM r UNION ALL SELECT 'template', template_id, split FROM r UNION ALL SELECT 'pair', question || chr(31) || norm, split FROM r),
b AS (SELECT key, v, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'validation') AS validation, count(*) FILTER (split = 'test') AS test FROM v WHERE v IS NOT NULL GROUP BY 1, 2),
f AS (SELECT s AS split, 'repeated ' || key AS "check" FROM b, (SELECT unnest(['train', 'validation']) AS s) WHERE key IN ('pair', 'question') AND CASE s WHEN 'train' THEN train ELSE validation END > 1
  UNION ALL SELECT s, key || ' in test' FROM b, (SELECT unnest(['train', 'validation']) AS s) WHERE key <> 'pair' AND CASE s WHEN 'train' THEN train ELSE validation END > 0 AND test > 0
  UNION ALL SELECT 'validation', key || ' in train' FROM b WHERE key IN ('question', 'template') AND train > 0 AND validation > 0
  UNION ALL SELECT split, 'comment in answer' FROM r WHERE split <> 'test' AND regexp_matches(coalesce(sql, ''), '--|```')
  UNION ALL SELECT split, 'id in prompt' FROM r WHERE split <> 'test' AND contains(question, id)
  UNION ALL SELECT split, 'evaluation data in prompt' FROM r WHERE split <> 'test' AND regexp_matches(lower(question), '{"|".join(pipeline.FORBIDDEN)}'))
SELECT split, "check", count(*) AS failed FROM f GROUP BY 1, 2""",
    "d21_named_pools": f"{_M} {pools.named_pools_sql()}",
    "d22_numeric_pools": f"{_M} {pools.numeric_pools_sql()}",
    "d23_expansion_statistics": f"""{_M}, k AS (SELECT least((SELECT count(DISTINCT wh) FROM wh) * {len(pools.STRUCTURAL['limit'])}, 120) AS a, least((SELECT count(DISTINCT region) FROM cust) * (SELECT count(DISTINCT segment) FROM cust) * 4, 120) AS b)
SELECT 2 * a + b AS examples, 2 * a + b AS questions, a + b AS statements, 2::BIGINT AS templates, least(2 * a, b) AS fewest, greatest(2 * a, b) AS most, 0 AS slots_missing FROM k""",
    "l01_stride_sample": f"{_M}, r AS (SELECT ord_id, placed, row_number() OVER (ORDER BY placed, ord_id) - 1 AS k, count(*) OVER () AS n FROM ord) SELECT ord_id, placed FROM r WHERE k IN (SELECT CAST(floor(i * (SELECT count(*) FROM ord) / 97.0::DOUBLE) AS BIGINT) FROM range(97) t(i))",
    "l02_not_done_yet": "SELECT DISTINCT example_id FROM results_smoke WHERE example_id NOT IN (SELECT example_id FROM generations_smoke)",
    "l03_statements_side_by_side": f"{_P} SELECT id AS example_id, pairs.sql AS gold_sql, g.sql AS reply_sql FROM pairs LEFT JOIN (SELECT DISTINCT example_id, sql FROM generations_smoke) g ON g.example_id = id",
    "l04_table_fingerprint": "SELECT count(*) AS rows, CAST(sum(('0x' || substr(h, 1, 12))::BIGINT) AS VARCHAR) || ':' || CAST(sum(('0x' || substr(h, 13, 12))::BIGINT) AS VARCHAR) AS checksum FROM (SELECT md5(coalesce(CAST(o_orderkey AS VARCHAR), 'NULL') || chr(31) || coalesce(o_orderstatus, 'NULL')) AS h FROM orders)",
    "l05_quality_of_tables": quality_sql(),
    "l06_invented_tables": "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {k}, {k}, 0)" for n, k in _INVENTED.items()) + ") AS t(table_name, rows, keys, orphans)",
    "t01_table_scores": f"WITH {_SHOP_SQL} SELECT example_id, tbl AS table_name, score FROM scored",
    "t02_value_index": """WITH v AS (SELECT DISTINCT lower(trim(n_name)) AS v, 'nation.n_name' AS place FROM nation UNION ALL SELECT DISTINCT lower(trim(r_name)), 'region.r_name' FROM region UNION ALL SELECT DISTINCT lower(trim(o_orderstatus)), 'orders.o_orderstatus' FROM orders
UNION ALL SELECT DISTINCT lower(trim(o_orderpriority)), 'orders.o_orderpriority' FROM orders) SELECT DISTINCT term, place FROM (SELECT v AS term, place FROM v UNION ALL SELECT term, place FROM (SELECT unnest(regexp_extract_all(v, '[a-z0-9]+')) AS term, place FROM v) WHERE length(term) > 2)""",
    "t03_retrieval_quality": _quality_sql(),
    "t04_value_index_of_all_tables": f"""WITH v AS (SELECT DISTINCT * FROM ({" UNION ALL ".join(f"SELECT lower(trim({c})) AS v, '{t}.{c}' AS place FROM {t} WHERE {c} IS NOT NULL AND (SELECT count(DISTINCT {c}) FROM {t}) <= {retrieval.MOST_VALUES}" for t, columns in _TEXTS.items() for c in columns)}))
SELECT DISTINCT term, place FROM (SELECT v AS term, place FROM v UNION ALL SELECT term, place FROM (SELECT unnest(regexp_extract_all(v, '[a-z0-9]+')) AS term, place FROM v) WHERE length(term) > 2)""",
    "u01_union": f"{_M} SELECT country FROM vend UNION SELECT country FROM area",
    "u02_intersect": f"{_M} SELECT cust_id FROM ord WHERE cust_id % 3 = 0 INTERSECT SELECT cust_id FROM cust WHERE NOT active",
    "u03_except": f"{_M} SELECT cust_id FROM cust EXCEPT SELECT cust_id FROM ord WHERE status = 'P'",
    "u04_rollup": f"{_M} SELECT status, priority, count(*) AS n, CAST(grouping_id(status, priority) AS BIGINT) AS level FROM ord GROUP BY ROLLUP (status, priority)",
    "u05_cube": f"{_M} SELECT status, priority, count(*) AS n, CAST(grouping_id(status, priority) AS BIGINT) AS level FROM ord GROUP BY CUBE (status, priority)",
    "u06_predicates": f"{_M} SELECT ord_id, priority, rep_id FROM ord WHERE priority LIKE '%-H%' AND total BETWEEN 100000 AND 300000 AND rep_id IS DISTINCT FROM 7 AND status IN ('F', 'O') AND CAST(placed AS DATE) < due",
    "u07_recursion_in_sql": f"{_M} SELECT * FROM ({_staff_sql('emp')}) c",
    "u08_bounds_cross_join": f"{_M}, b AS (SELECT min(total) AS lo, max(total) AS hi FROM ord) SELECT ord_id, total FROM ord, b WHERE total < lo * 1.05 OR total > hi * 0.99",
    "w01_events_by_hour": "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS value FROM events GROUP BY 1, 2",
    "w02_sessions": "SELECT user_id, min(ts) AS began, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s",
    "w03_events_once": "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1",
}
ORACLE["k02_components_in_small_tasks"] = ORACLE["d04_equivalence_groups"]
