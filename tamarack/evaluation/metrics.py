"""Figures over scored answers: one aggregation for the totals, one for each breakdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.functions.semantics import mean
from tamarack.functions.text import letters
from tamarack.operators.ranking import range_rank

#: Outcomes after which nothing was executed to the end.
NOT_EXECUTED = ("syntax_error", "unknown_table", "unknown_column", "execution_error", "timeout", "unsafe_sql", "empty_output", "generation_failed", "generation_error", "invalid_sql", "no_sql", "no_sql_produced", "not_read_only")
OUTCOME_OF_ERROR = {"syntax_error": "syntax_error", "unparseable": "invalid_sql", "unknown_table": "unknown_table", "unknown_column": "unknown_column", "timeout": "timeout", "dangerous_sql": "unsafe_sql", "multiple_statements": "unsafe_sql"}


def outcome_of(error_class: str | None, correct: bool) -> str:
    """The outcome of an answer from its error class, or from whether its result is right."""
    if error_class is None:
        return "correct" if correct else "wrong_result"
    return OUTCOME_OF_ERROR.get(error_class, "execution_error")


def distinct_results(results: DataFrame, columns: list[str]) -> DataFrame:
    """One row an example with the columns asked for: rows delivered again differ in nothing but scored_at. Difficulty and domain by their letters."""
    names = [c for c in columns if c not in ("example_id", "scored_at")]
    plain = [letters(F.col(c)).alias(c) if c in ("difficulty", "domain") else F.col(c) for c in names]
    return results.select("example_id", *plain).dropDuplicates(["example_id"])


def _share(condition: Column, whole: Column | None = None) -> Column:
    n = F.count(F.lit(1)) if whole is None else F.count_if(whole)
    hits = F.count_if(condition if whole is None else condition & whole)
    return F.when(n > 0, F.lit(100.0) * hits / n.cast("double"))


def _figures() -> list[Column]:
    executed = ~F.col("outcome").isin(*NOT_EXECUTED)
    ordered = F.col("gold_sql").rlike("(?i)order\\s+by")
    return [
        F.count("*").alias("n"),
        F.count_if("correct").alias("correct"),
        _share(F.col("correct")).alias("accuracy"),
        _share(executed).alias("executable"),
        _share(F.coalesce("strict_correct", F.lit(False)), ordered).alias("strict_ordered"),
        _share(F.coalesce("projection_match", F.lit(False)) | F.col("correct")).alias("right_columns_or_more"),
    ]


def summarise(results: DataFrame) -> DataFrame:
    """All totals in one row."""
    return results.agg(*_figures())


#: The rates of errors reported, each with the outcomes that count.
ERROR_RATES = {
    "syntax_error": ("syntax_error",),
    "unknown_table": ("unknown_table",),
    "unknown_column": ("unknown_column",),
    "schema_hallucination": ("unknown_table", "unknown_column"),
    "execution_error": ("execution_error",),
    "timeout": ("timeout",),
    "no_sql_produced": ("no_sql_produced", "no_sql", "empty_output"),
    "invalid_sql": ("invalid_sql",),
    "not_read_only": ("not_read_only", "unsafe_sql"),
    "generation_failed": ("generation_failed", "generation_error"),
}


def full_summary(results: DataFrame) -> DataFrame:
    """All totals in one row: accuracy, what a choice of columns explains, ten error rates, accuracy where order counts, and tokens.

    Needs outcome, correct, strict_correct, projection_match, prompt_tokens and
    completion_tokens. Order counts where strict_correct is not null; token counts that are
    null or 0 are left out.
    """
    o, projection = F.col("outcome"), F.coalesce("projection_match", F.lit(False))
    tokens = lambda c: F.when(F.col(c) != 0, F.col(c).cast("bigint"))
    figures = {
        "n": F.count("*"),
        "correct": F.count_if("correct"),
        "accuracy": _share(F.col("correct")),
        "executable": F.count_if(~o.isin(*NOT_EXECUTED)),
        "executable_pct": _share(~o.isin(*NOT_EXECUTED)),
        "wrong_result": F.count_if(o == "wrong_result"),
        "projection_only": F.count_if(projection),
        "other_rows": F.count_if((o == "wrong_result") & ~projection),
        "tolerant_correct": F.count_if("correct") + F.count_if(projection),
        "tolerant_accuracy": F.when(F.count("*") > 0, F.lit(100.0) * (F.count_if("correct") + F.count_if(projection)) / F.count("*").cast("double")),
    }
    figures |= {f"{name}_pct": _share(o.isin(*outcomes)) for name, outcomes in ERROR_RATES.items()}
    strict = F.col("strict_correct")
    figures |= {"strict_n": F.count("strict_correct"), "strict_correct": F.count_if(F.coalesce(strict, F.lit(False))), "strict_accuracy": _share(F.coalesce(strict, F.lit(False)), strict.isNotNull())}
    for c in ("prompt_tokens", "completion_tokens"):
        figures |= {f"{c}_total": F.sum(tokens(c)), f"{c}_mean": F.sum(tokens(c)).cast("double") / F.count(tokens(c)).cast("double")}
    return results.agg(*(v.alias(k) for k, v in figures.items()))


#: Ways in which a wrong answer that ran fails, the first that fits.
REPORT_PATTERNS = ("no rows", "limit dropped", "limit added", "left join for inner", "inner join for left", "distinct added", "too many rows", "too few rows", "other values")


def report_patterns(results: DataFrame) -> DataFrame:
    """(pattern, n): how wrong answers that ran fail, by what both statements say and how many rows both give; answers whose gold columns are right are left out."""
    says = lambda c, words: F.upper(F.coalesce(c, F.lit(""))).contains(words)
    gold, mine = F.col("gold_sql"), F.col("predicted_sql")
    g, p = F.coalesce("gold_row_count", F.lit(0)), F.coalesce("predicted_row_count", F.lit(-1))
    only = lambda words, a, b: says(a, words) & ~says(b, words)
    tests = [(p == 0) & (g > 0), only("LIMIT", gold, mine), only("LIMIT", mine, gold), only("LEFT JOIN", mine, gold), only("LEFT JOIN", gold, mine), only("DISTINCT", mine, gold), (g > 0) & (p > 0) & (p > g * 1.05), (g > 0) & (p > 0) & (p < g * 0.95)]
    pattern = F.lit(REPORT_PATTERNS[-1])
    for name, test in reversed(list(zip(REPORT_PATTERNS, tests))):
        pattern = F.when(test, name).otherwise(pattern)
    wrong = results.where((F.col("outcome") == "wrong_result") & ~F.coalesce("projection_match", F.lit(False)))
    return wrong.groupBy(pattern.alias("pattern")).agg(F.count("*").alias("n"))


def breakdown(results: DataFrame, by: str) -> DataFrame:
    """The totals for each value of a column; for an array column each of its values counts."""
    if results.schema[by].dataType.typeName() == "array":
        results = results.withColumn(by, F.explode(by))
    return results.groupBy(F.col(by).alias("value")).agg(*_figures())


def latency(results: DataFrame, column: str = "execution_latency_ms", p: float = 0.9, bucket: str | None = None) -> DataFrame:
    """n, mean, median, nearest-rank p and range of a latency, exactly; ranks come from range partitions, so that no task holds all values.

    Nearest rank is the element at floor(p * n), at most the last: a stored value, never one in between.
    """
    keys = [bucket] if bucket else []
    ranked = range_rank(results.where(F.col(column).isNotNull()).select(*keys, F.col(column).alias("v")), keys, ["v"], "r")
    n = F.col("rank_rows")
    last = F.least(F.floor(F.lit(p) * n), n - 1)
    low, high = F.floor((n - 1) / 2), F.floor(n / 2)
    pick = lambda at: F.max(F.when(F.col("r") == at, F.col("v")))
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), mean(F.col("v")).alias("mean"), ((pick(low) + pick(high)) / 2).alias("median"), pick(last).alias(f"p{round(p * 100)}"), F.min("v").alias("low"), F.max("v").alias("high"))


def outcome_rates(results: DataFrame) -> DataFrame:
    """Count and share of every outcome."""
    counted = results.groupBy("outcome").agg(F.count("*").alias("n"))
    return counted.withColumn("pct", F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy()).cast("double"))


_PATTERNS = [
    ("window", r"(?i)\bover\s*\("),
    ("recursion", r"(?i)\bwith\s+recursive\b"),
    ("common_table", r"(?i)^\s*with\b"),
    ("anti_or_semi_join", r"(?i)\bexists\s*\("),
    ("having", r"(?i)\bhaving\b"),
    ("outer_join", r"(?i)\b(?:left|right|full)\s+(?:outer\s+)?join\b"),
    ("join", r"(?i)\bjoin\b"),
    ("grouping", r"(?i)\bgroup\s+by\b"),
]


def sql_pattern(sql: Column) -> Column:
    """The first kind of construct that a statement shows."""
    found = F.when(sql.isNull(), "none")
    for name, pattern in _PATTERNS:
        found = found.when(sql.rlike(pattern), name)
    return found.otherwise("plain")


def failure_patterns(results: DataFrame) -> DataFrame:
    """How many wrong answers each kind of gold statement has."""
    return results.where(~F.col("correct")).groupBy(sql_pattern(F.col("gold_sql")).alias("pattern"), "outcome").agg(F.count("*").alias("n"))


def sql_shape(sql: Column) -> Column:
    """Counts and marks of constructs in a statement, for comparing a prediction with its gold."""
    count = lambda p: F.regexp_count(sql, F.lit(p))
    return F.struct(
        count(r"(?i)\bjoin\b").alias("joins"),
        sql.rlike(r"(?i)\bgroup\s+by\b").alias("groups"),
        sql.rlike(r"(?i)\bhaving\b").alias("having"),
        sql.rlike(r"(?i)\blimit\b").alias("limit"),
        sql.rlike(r"(?i)\bover\s*\(").alias("windows"),
        sql.rlike(r"(?i)\bdistinct\b").alias("distinct"),
        sql.rlike(r"(?i)\border\s+by\b").alias("sorted"),
    )


def failure_tags(results: DataFrame) -> DataFrame:
    """(example_id, tag): what differs in shape between a wrong prediction and its gold; ``values_only`` where nothing does."""
    wrong = results.where("not correct and predicted_sql is not null").select("example_id", sql_shape(F.col("gold_sql")).alias("g"), sql_shape(F.col("predicted_sql")).alias("p"))
    tests = [F.when(F.col(f"g.{f}") != F.col(f"p.{f}"), F.lit(f"other_{f}")) for f in ("joins", "groups", "having", "limit", "windows", "distinct", "sorted")]
    tags = F.array_compact(F.array(*tests))
    return wrong.select("example_id", F.explode(F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("values_only")))).alias("tag"))


def row_count_failures(results: DataFrame) -> DataFrame:
    """Wrong answers that ran, by how their number of rows compares with the gold's."""
    ran = results.where("not correct and predicted_row_count is not null")
    kind = F.when(F.col("predicted_row_count") == 0, "empty").when(F.col("predicted_row_count") < F.col("gold_row_count"), "fewer").when(F.col("predicted_row_count") > F.col("gold_row_count"), "more").otherwise("as_many")
    return ran.groupBy(kind.alias("rows")).agg(F.count("*").alias("n"))


def with_repairs(results: DataFrame, repairs: DataFrame) -> DataFrame:
    """Results with repaired answers folded in: where ``repairs`` has an example, its correct and outcome count."""
    r = repairs.select("example_id", F.col("correct").alias("c2"), F.col("outcome").alias("o2"))
    return results.join(r, "example_id", "left").withColumns({"correct": F.coalesce("c2", "correct"), "outcome": F.coalesce("o2", "outcome")}).drop("c2", "o2")


def ablation(runs: DataFrame, run: str = "run") -> DataFrame:
    """Accuracy by difficulty, a column for each run; only examples that all runs have."""
    names = sorted(r[0] for r in runs.select(run).distinct().collect())  # a handful of runs
    common = runs.groupBy("example_id").agg(F.countDistinct(run).alias("k")).where(F.col("k") == len(names))
    return runs.join(common.select("example_id"), "example_id").groupBy("difficulty").pivot(run, names).agg(_share(F.col("correct")))


def release_gate(results: DataFrame, baseline: DataFrame, least_accuracy: float, least_executable: float, most_lost: float) -> DataFrame:
    """(check, value, threshold, passed): overall thresholds, and the accuracy lost in any difficulty against a baseline."""
    one = results.agg(_share(F.col("correct")).alias("a"), _share(~F.col("outcome").isin(*NOT_EXECUTED)).alias("e"))
    overall = one.select(F.explode(F.array(F.struct(F.lit("accuracy").alias("check"), F.col("a").alias("value"), F.lit(least_accuracy).alias("threshold")), F.struct(F.lit("executable").alias("check"), F.col("e").alias("value"), F.lit(least_executable).alias("threshold")))).alias("c")).select("c.*", (F.col("c.value") >= F.col("c.threshold")).alias("passed"))
    mine, old = (d.groupBy("difficulty").agg(_share(F.col("correct")).alias(n)) for d, n in ((results, "mine"), (baseline, "old")))
    lost = mine.join(old, mine["difficulty"].eqNullSafe(old["difficulty"])).select(F.concat(F.lit("lost in "), F.coalesce(mine["difficulty"], F.lit("none"))).alias("check"), (F.col("old") - F.col("mine")).alias("value"), F.lit(most_lost).alias("threshold"))
    return overall.unionByName(lost.withColumn("passed", F.col("value") <= F.col("threshold")))
