"""Scoring of generated statements against gold ones by running both."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.engine.execute import ExecutionResult, execute, projection_matches, result_fingerprint
from tamarack.engine.repair import Generator, extract_sql
from tamarack.evaluation.metrics import outcome_of
from tamarack.evaluation.shape import shape_tag, statement_shape


@dataclass(frozen=True)
class Example:
    example_id: str
    question: str
    gold_sql: str
    difficulty: str = ""
    domain: str = ""


@dataclass(frozen=True)
class Scored:
    """One scored answer; the fields that the metrics read."""

    example_id: str
    difficulty: str
    domain: str
    gold_sql: str
    predicted_sql: str | None
    outcome: str
    correct: bool
    strict_correct: bool | None
    projection_match: bool | None
    gold_row_count: int | None
    predicted_row_count: int | None
    execution_latency_ms: float
    failure: str | None


def _ordered(sql: str) -> bool:
    return "order by" in " ".join(sql.lower().split())


def failure_kind(gold: ExecutionResult, predicted: ExecutionResult) -> str:
    """How a wrong result differs: error, empty, columns, order_of_columns, missing_rows, extra_rows, repeated_rows or values."""
    if not predicted.ok:
        return predicted.error_class or "error"
    if not predicted.rows and gold.rows:
        return "empty"
    if len(predicted.columns) != len(gold.columns):
        return "columns"
    mine, theirs = Counter(map(str, predicted.rows)), Counter(map(str, gold.rows))
    if set(mine) == set(theirs):
        return "repeated_rows"
    if sorted(predicted.columns) == sorted(gold.columns) and predicted.columns != gold.columns:
        return "order_of_columns"
    if not mine - theirs:
        return "missing_rows"
    if not theirs - mine:
        return "extra_rows"
    return "values"


def gold_results(spark: SparkSession, examples: Iterable[Example], **limits: float) -> dict[str, ExecutionResult]:
    """Every distinct gold statement, run once."""
    return {sql: execute(spark, sql, ordered=_ordered(sql), **limits) for sql in dict.fromkeys(e.gold_sql for e in examples)}


def drift(results: dict[str, ExecutionResult], stored: dict[str, str]) -> list[str]:
    """Gold statements whose result is no longer the stored one."""
    return sorted(sql for sql, fingerprint in stored.items() if sql in results and results[sql].fingerprint != fingerprint)


def score_example(spark: SparkSession, example: Example, reply: str | None, gold: ExecutionResult, known_tables: Iterable[str], **limits: float) -> Scored:
    """The outcome of one reply: right as a bag of rows, and in order where the gold statement sorts."""
    if not gold.ok:
        raise ValueError(f"the gold statement of {example.example_id} fails: {gold.error_message}")
    base = (example.example_id, example.difficulty, example.domain, example.gold_sql)
    sql = extract_sql(reply)
    if not sql:
        return Scored(*base, None, "no_sql", False, None, None, gold.row_count, None, 0.0, "no_sql")
    got = execute(spark, sql, known_tables, ordered=_ordered(example.gold_sql), **limits)
    right = got.ok and got.fingerprint == gold.fingerprint
    strict = right and got.ordered_fingerprint == gold.ordered_fingerprint if _ordered(example.gold_sql) else None
    more = None if right else projection_matches(spark, sql, gold.columns, gold.fingerprint or "", **limits) if got.ok else False
    outcome = outcome_of(None if got.ok else got.error_class, right)
    return Scored(*base, sql, outcome, right, strict, more, gold.row_count, got.row_count, got.latency_ms, None if right else failure_kind(gold, got))


_SCORED_DDL = "example_id string, difficulty string, domain string, gold_sql string, predicted_sql string, outcome string, correct boolean, strict_correct boolean, projection_match boolean, gold_row_count bigint, predicted_row_count bigint, execution_latency_ms double, failure string"


def _score_all(spark: SparkSession, examples: list[Example], reply_to: Callable[[Example], str | None], known_tables: Iterable[str], most_fatal: int, **limits: float) -> DataFrame:
    gold, known, fatal, rows = gold_results(spark, examples, **limits), list(known_tables), 0, []
    for e in examples:
        try:
            reply = reply_to(e)
        except Exception:
            fatal += 1
            if fatal >= most_fatal:
                raise RuntimeError(f"{fatal} generator errors") from None
            rows.append(Scored(e.example_id, e.difficulty, e.domain, e.gold_sql, None, "generation_failed", False, None, None, gold[e.gold_sql].row_count, None, 0.0, "generation_failed"))
            continue
        rows.append(score_example(spark, e, reply, gold[e.gold_sql], known, **limits))
    return spark.createDataFrame([tuple(asdict(r).values()) for r in rows], _SCORED_DDL)


def run_benchmark(spark: SparkSession, examples: list[Example], generator: Generator, known_tables: Iterable[str], schema: str = "", most_fatal: int = 25, **limits: float) -> DataFrame:
    """Scored answers of a generator as a table for ``metrics``; ends early after too many generator errors."""
    return _score_all(spark, examples, lambda e: generator.generate(e.question, schema), known_tables, most_fatal, **limits)


def rescore(spark: SparkSession, scored: DataFrame, examples: list[Example], known_tables: Iterable[str], **limits: float) -> DataFrame:
    """The same predictions, each of its own example, run again for other data or other rules; only rows of ``examples`` are fetched."""
    asked = spark.createDataFrame([(e.example_id,) for e in examples], "example_id string").distinct()
    kept = {r.example_id: r.predicted_sql for r in scored.select("example_id", "predicted_sql").join(F.broadcast(asked), "example_id", "left_semi").collect()}
    return _score_all(spark, examples, lambda e: kept.get(e.example_id), known_tables, len(examples) + 1, **limits)


def failure_bucket(gold: ExecutionResult, predicted: ExecutionResult, stored_columns: Iterable[str] = ()) -> tuple[str, str]:
    """(bucket, tag) of a wrong result by the columns that it shares with the gold result.

    ``projection_only`` where those agree and only the choice of columns differs, but
    ``wrong_values`` where a computed column is missing (one that no table stores) and no
    column holds its values; ``column_order`` and ``row_order`` where nothing else differs;
    else ``wrong_values`` where rows and their ids or names agree, or ``wrong_rows``. The tag
    says which columns, or how the statements differ in shape.
    """
    if not predicted.ok:
        return "execution_error", predicted.error_class or "error"
    common = [c for c in gold.columns if c in predicted.columns]
    pick = lambda r, cs: result_fingerprint([[row[r.columns.index(c)] for c in cs] for row in r.rows])
    alike = lambda cs: bool(cs) and not gold.truncated and not predicted.truncated and len(gold.rows) == len(predicted.rows) and pick(gold, cs) == pick(predicted, cs)
    if alike(common):
        missing = [c for c in gold.columns if c not in predicted.columns]
        extra = [c for c in predicted.columns if c not in gold.columns]
        computed = [c for c in missing if c not in set(stored_columns)]
        if missing and extra and len(gold.columns) == len(predicted.columns) and gold.fingerprint == predicted.fingerprint:
            return "projection_only", f"renamed {', '.join(missing)} to {', '.join(extra)}"
        if missing and extra and computed:
            return "wrong_values", f"computed column missing: {', '.join(computed)}"
        if missing or extra:
            return "projection_only", "; ".join(f"{what} {', '.join(names)}" for what, names in (("missing", missing), ("extra", extra)) if names)
        return ("column_order", "column_order") if gold.columns != predicted.columns else ("row_order", "row_order")
    tag = shape_tag(statement_shape(gold.sql), statement_shape(predicted.sql), gold.row_count or 0, predicted.row_count or 0)
    return ("wrong_values" if alike([c for c in common if c.endswith("_id") or c in ("name", "email")]) else "wrong_rows"), tag
