"""From a raw reply to rows: extraction, diagnosis, at most one repair, bounded answer."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from tamarack.engine.check import StaticCheck, analyse, split_statements
from tamarack.engine.execute import ExecutionResult, execute


def extract_sql(raw: str | None) -> str:
    """The first statement of a reply: thinking, fences and prose before it taken off."""
    if not raw:
        return ""
    text = re.sub(r"(?is)<think>.*?(?:</think>|\Z)", "", raw)
    fenced = re.search(r"(?s)```[a-zA-Z]*\s*\n?(.*?)(?:```|\Z)", text)
    if fenced and fenced.group(1).strip():
        text = fenced.group(1)
    start = re.search(r"(?im)(?:^|[:.]\s)\s*(select|with)\b", text)
    if start:
        text = text[start.start(1) :]
    statements = split_statements(text)
    return statements[0] if statements else ""


@dataclass
class Diagnosis:
    """What is wrong with a statement: the static check, and the run where it got so far."""

    check: StaticCheck
    result: ExecutionResult | None

    @property
    def problem(self) -> str | None:
        if self.check.failure_reason:
            return self.check.failure_reason
        return None if self.result and self.result.ok else (self.result.error_class if self.result else None)

    @property
    def message(self) -> str:
        if self.check.failure_reason == "unknown_table":
            return "unknown tables: " + ", ".join(sorted(self.check.unknown_tables))
        return self.check.error or (self.result.error_message if self.result else None) or (self.check.failure_reason or "")


def diagnose(spark: SparkSession, sql: str, known_tables: Iterable[str], **limits: float) -> Diagnosis:
    check = analyse(spark, sql, known_tables)
    return Diagnosis(check, execute(spark, sql, **limits) if check.ok else None)


@dataclass
class RepairOutcome:
    sql: str
    diagnosis: Diagnosis
    attempts: list[tuple[str, str | None]] = field(default_factory=list)

    @property
    def repaired(self) -> bool:
        return len(self.attempts) > 1 and self.diagnosis.problem is None


def repair_loop(spark: SparkSession, sql: str, question: str, known_tables: Iterable[str], regenerate: Callable[[str, str, str], str], max_repairs: int = 1, **limits: float) -> RepairOutcome:
    """Ask ``regenerate(question, sql, problem)`` for another statement while there is a problem and a try left; the same statement again ends it."""
    known = list(known_tables)
    found = diagnose(spark, sql, known, **limits)
    out = RepairOutcome(sql, found, [(sql, found.problem)])
    for _ in range(max_repairs):
        if out.diagnosis.problem is None:
            break
        again = extract_sql(regenerate(question, out.sql, out.diagnosis.message))
        if not again or again == out.sql:
            break
        found = diagnose(spark, again, known, **limits)
        out = RepairOutcome(again, found, [*out.attempts, (again, found.problem)])
    return out


class Generator(Protocol):
    """Turns a question and a rendered schema into a reply."""

    def generate(self, question: str, schema: str) -> str: ...


@dataclass
class FixedGenerator:
    """Replies from a table of questions; for tests and replays."""

    replies: dict[str, str]
    default: str = ""

    def generate(self, question: str, schema: str) -> str:
        return self.replies.get(question, self.default)


@dataclass
class Answer:
    ok: bool
    question: str
    sql: str
    columns: list[str]
    rows: list[list[str | None]]
    truncated: bool
    repaired: bool
    problem: str | None
    latency_ms: float


class Service:
    """Answers questions over registered views, read-only, with bounded rows."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], generator: Generator, schema: str = "", row_cap: int = 1000, timeout_s: float = 30.0):
        self.spark, self.tables, self.generator, self.schema = spark, tables, generator, schema
        self.row_cap, self.timeout_s = row_cap, timeout_s
        for name, df in tables.items():
            df.createOrReplaceTempView(name)

    def health(self) -> dict[str, object]:
        return {"ok": self.spark.range(1).count() == 1, "tables": sorted(self.tables)}

    def answer(self, question: str, max_rows: int = 100, repair: bool = True) -> Answer:
        if not question or not question.strip() or len(question) > 2000:
            raise ValueError("a question has 1 to 2000 characters")
        if not 1 <= max_rows <= self.row_cap:
            raise ValueError(f"max_rows is between 1 and {self.row_cap}")
        sql = extract_sql(self.generator.generate(question, self.schema))
        again = lambda q, s, p: self.generator.generate(f"{q}\n\nThis statement failed: {s}\n{p}", self.schema)
        out = repair_loop(self.spark, sql, question, self.tables, again, int(repair), max_rows=max_rows, timeout_s=self.timeout_s)
        result = out.diagnosis.result
        good = out.diagnosis.problem is None
        rows = [[None if v is None else str(v) for v in r] for r in result.rows] if good else []
        return Answer(good, question, out.sql, result.columns if good else [], rows, bool(good and result.truncated), out.repaired, out.diagnosis.problem, result.latency_ms if result else 0.0)
