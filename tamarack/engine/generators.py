"""Generators of replies that need no model: stored replies, gold statements, and a chain that goes on to the next where one fails."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.engine.repair import Generator


class NoReply(LookupError):
    """A generator has nothing to say to a question."""


@dataclass
class ReplayGenerator:
    """Stored replies, given again; a question that is asked repeatedly gets its replies in their order, the last one over and over."""

    replies: dict[str, list[str]]
    asked: dict[str, int] = field(default_factory=dict)

    @classmethod
    def of(cls, stored: DataFrame, questions: Iterable[str], question: str = "question", reply: str = "raw_output", order: str = "example_id") -> ReplayGenerator:
        """From a table of replies, of which only those to ``questions`` are fetched."""
        wanted = F.broadcast(stored.sparkSession.createDataFrame([(q,) for q in dict.fromkeys(questions)], "q string"))
        rows = stored.join(wanted, F.col(question) == F.col("q"), "left_semi").groupBy(question).agg(F.transform(F.array_sort(F.collect_set(F.struct(order, reply))), lambda x: x[reply]).alias("r")).collect()
        return cls({r[0]: [x for x in r["r"] if x is not None] for r in rows})

    def generate(self, question: str, schema: str) -> str:
        found = self.replies.get(question)
        if not found:
            raise NoReply(question)
        at = self.asked.get(question, 0)
        self.asked[question] = at + 1
        return found[min(at, len(found) - 1)]


@dataclass
class OracleGenerator:
    """Gold statements: what a perfect model would say, to measure everything else."""

    statements: dict[str, str]

    def generate(self, question: str, schema: str) -> str:
        if question not in self.statements:
            raise NoReply(question)
        return self.statements[question]


@dataclass
class FailoverGenerator:
    """Asks one generator after the other until one replies; ``failures`` counts the errors of each."""

    chain: Sequence[Generator]
    failures: list[int] = field(default_factory=list)

    def generate(self, question: str, schema: str) -> str:
        self.failures = self.failures or [0] * len(self.chain)
        last: Exception | None = None
        for i, one in enumerate(self.chain):
            try:
                return one.generate(question, schema)
            except Exception as error:
                self.failures[i] += 1
                last = error
        raise last or NoReply(question)
