"""Queries over scored answers and replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.functions.text import name_key
from tamarack.llm.formatting import collapsed, copies, formatting_classes
from tamarack.llm.replies import defective_replies
from tamarack.llm.sampling import sample_report, target_sampler
from tamarack.llm.splits import same_names, split_report, template_splits
from tamarack.sources.tables import table
from tamarack.storage import materialize


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = same_names(table(spark, sf_dir, "results_smoke"), "template_id")
    return pairs.select(F.col("a").alias("template_a"), F.col("b").alias("template_b"))


def p2_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_splits(table(spark, sf_dir, "results_smoke")).select(F.col("id").alias("example_id"), "split")


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_report(template_splits(table(spark, sf_dir, "results_smoke")))


def p2_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(check, failed): what must hold of the splits. Records are counted; templates in several splits, records split twice, and cells further from their target than their largest group, there must be none."""
    results = table(spark, sf_dir, "results_smoke")
    placed = materialize(template_splits(results))
    named = results.select(F.col("example_id").alias("id"), name_key(F.col("template_id")).alias("name")).distinct()
    torn = placed.join(named, "id").where("name is not null").groupBy("name").agg(F.countDistinct("split").alias("k")).where("k > 1")
    far = split_report(placed).where("abs(deviation) > largest + 1e-9")
    count = lambda df, name: df.agg(F.lit(name).alias("check"), F.count("*").alias("failed"))
    parts = [count(placed, "records"), count(torn, "template in several splits"), count(placed.groupBy("id").count().where("count > 1"), "record split twice"), count(far, "further from target than the largest group")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def p3_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(plan_id, drawn, records, misplaced, below_floor): the size of each plan's sample, its different records, those outside their cell, and cells below what their floor and records allow."""
    sampler = _sampler(spark, sf_dir)
    drawn = materialize(sampler.draw())
    whole = drawn.groupBy("plan_id").agg(F.count("*").alias("drawn"), F.countDistinct("id").alias("records"))
    wrong = drawn.join(sampler.population.select("id", F.col("cell").alias("own")), "id").groupBy("plan_id").agg(F.count_if(F.col("cell") != F.col("own")).alias("misplaced"))
    floors = spark.createDataFrame([(c.plan, c.key, min(c.least, c.available)) for c in sampler.cells], "plan_id int, cell string, floor int")
    low = floors.join(drawn.groupBy("plan_id", "cell").agg(F.count("*").alias("n")), ["plan_id", "cell"], "left").groupBy("plan_id").agg(F.count_if(F.coalesce("n", F.lit(0)) < F.col("floor")).alias("below_floor"))
    return whole.join(wrong, "plan_id").join(low, "plan_id")


def _sampler(spark: SparkSession, sf_dir: str):
    return target_sampler(table(spark, sf_dir, "results_smoke"), table(spark, sf_dir, "sample_targets"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampler(spark, sf_dir).report().where("gap").select("plan_id", "difficulty", "domain")


def p3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampler(spark, sf_dir).draw().select("plan_id", F.col("id").alias("example_id"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    sampler = _sampler(spark, sf_dir)
    return sample_report(sampler, sampler.draw())


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatting_classes(table(spark, sf_dir, "results_smoke"), "example_id", ["gold_sql", "predicted_sql"], "scored_at")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(_statements(spark, sf_dir))


def p4_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapsed(_statements(spark, sf_dir)).withColumnRenamed("id", "example_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = defective_replies(table(spark, sf_dir, "generations_smoke"), table(spark, sf_dir, "results_smoke"))
    return found.select(F.col("id").alias("example_id"), "defect")


QUERIES = {
    "p2_found": p2_found,
    "p2_splits": p2_splits,
    "p2_report": p2_report,
    "p2_checks": p2_checks,
    "p3_found": p3_found,
    "p3_sample": p3_sample,
    "p3_report": p3_report,
    "p3_checks": p3_checks,
    "p4_found": p4_found,
    "p4_collapsed": p4_collapsed,
    "p5_found": p5_found,
}

_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_PLAIN = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")


def _letters_sql(column: str) -> str:
    return rf"regexp_replace(lower(translate({column}, '{_WIDE}', '{_PLAIN}')), '[^\p{{L}}]+', '', 'g')"


def _number_sql(column: str) -> str:
    return rf"regexp_replace(regexp_replace(translate({column}, '{_WIDE}', '{_PLAIN}'), '[^0-9]+', '', 'g'), '^0+(.)', '\1')"


ORACLE: dict[str, str] = {
    "p2_found": f"""WITH v AS (
  SELECT DISTINCT template_id AS t, {_letters_sql("template_id")} AS l, {_number_sql("template_id")} AS d
  FROM results_smoke WHERE template_id IS NOT NULL)
SELECT a.t AS template_a, b.t AS template_b FROM v a JOIN v b ON a.l = b.l AND a.d = b.d AND a.t < b.t WHERE a.l <> '' OR a.d <> ''""",
    "p3_found": f"""WITH r AS (
  SELECT DISTINCT example_id, {_letters_sql("difficulty")} AS d, {_letters_sql("domain")} AS m FROM results_smoke),
have AS (SELECT d, m, count(DISTINCT example_id) AS n FROM r GROUP BY 1, 2),
want AS (
  SELECT DISTINCT plan_id, difficulty, domain, {_letters_sql("difficulty")} AS d, {_letters_sql("domain")} AS m,
         greatest(min_rows, ceil(target_share * sample_rows)) AS needed FROM sample_targets)
SELECT plan_id, difficulty, domain FROM want LEFT JOIN have USING (d, m) WHERE coalesce(n, 0) < needed""",
    "p2_checks": """SELECT 'records' AS "check", count(DISTINCT example_id) AS failed FROM results_smoke
UNION ALL SELECT * FROM (VALUES ('template in several splits', 0), ('record split twice', 0), ('further from target than the largest group', 0))""",
    "p3_checks": f"""WITH r AS (SELECT DISTINCT example_id, {_letters_sql("difficulty")} AS d, {_letters_sql("domain")} AS m FROM results_smoke),
have AS (SELECT d, m, count(DISTINCT example_id) AS n FROM r GROUP BY 1, 2),
want AS (SELECT DISTINCT plan_id, {_letters_sql("difficulty")} AS d, {_letters_sql("domain")} AS m, target_share, min_rows, sample_rows FROM sample_targets),
plans AS (SELECT plan_id, any_value(sample_rows) AS whole, sum(least(min_rows, coalesce(n, 0))) AS floors, sum(CASE WHEN target_share > 0 THEN coalesce(n, 0) ELSE least(min_rows, coalesce(n, 0)) END) AS room FROM want LEFT JOIN have USING (d, m) GROUP BY 1)
SELECT plan_id, CAST(least(greatest(whole, floors), greatest(room, floors)) AS BIGINT) AS drawn, CAST(least(greatest(whole, floors), greatest(room, floors)) AS BIGINT) AS records, 0 AS misplaced, 0 AS below_floor FROM plans""",
}
