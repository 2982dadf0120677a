"""Static check of SQL before it runs: one read-only statement over known tables and functions.

Spark has no read-only session, so an allowlist over the parsed plan is the whole defence:
statement kind, relations (no paths, no catalogs) and functions, in every subquery. Of the
functions those built into Spark are allowed, less the ones that reach the JVM, files or
the host; functions that were registered are not.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

#: Functions that run code, read files or tell about the host.
BLOCKED_FUNCTIONS = frozenset("reflect java_method try_reflect input_file_name input_file_block_start input_file_block_length current_user session_user user version spark_partition_id current_catalog current_database current_schema read_files from_avro to_avro raise_error assert_true sleep uuid".split())
_WRITES = re.compile(r"(?i)\A[\s(]*(?:insert|update|delete|merge|drop|create|alter|truncate|grant|revoke|replace|call|execute|exec|copy|load|msck|refresh|vacuum|analyze|cache|uncache|clear|set|reset|use|add|kill|begin|commit|rollback|declare|do|lock|reindex|comment|explain|describe|desc|show|list|export|import|unload|optimize)\b")
_SAFE_NODES = frozenset("Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Join SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedRelation UnresolvedWith UnresolvedHaving Union Intersect Except Distinct Deduplicate Window WithWindowDefinition UnresolvedInlineTable OneRowRelation$ OneRowRelation Generate LateralJoin Pivot Unpivot UnresolvedTableValuedFunction UnresolvedHint Sample LocalRelation Range LimitAll Limit".split())


@dataclass
class StaticCheck:
    """What is known about a statement without running it."""

    sql: str
    parseable: bool = False
    statements: int = 0
    read_only: bool = False
    kind: str | None = None
    tables: set[str] = field(default_factory=set)
    functions: set[str] = field(default_factory=set)
    unknown_tables: set[str] = field(default_factory=set)
    blocked: set[str] = field(default_factory=set)
    error: str | None = None

    @property
    def failure_reason(self) -> str | None:
        """The first thing wrong, in a fixed order; None for a statement that may run."""
        if not self.parseable:
            return "unparseable"
        if self.statements != 1:
            return "multiple_statements"
        if not self.read_only or self.blocked:
            return "dangerous_sql"
        if self.unknown_tables:
            return "unknown_table"
        return None

    @property
    def ok(self) -> bool:
        return self.failure_reason is None


_PIECES = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|;|[^;'\"`/-]+|.", re.S)


def split_statements(sql: str) -> list[str]:
    """The statements between semicolons that stand outside quotes and comments, comments and blanks left out."""
    parts, now = [], []
    for m in _PIECES.finditer(sql):
        t = m.group()
        if t == ";":
            parts.append("".join(now))
            now = []
        elif not t.startswith(("--", "/*")):
            now.append(t)
        else:
            now.append(" ")
    return [p.strip() for p in [*parts, "".join(now)] if p.strip()]


def _scala(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _name(node) -> str:
    return node.getClass().getSimpleName()


class _Walk:
    def __init__(self) -> None:
        self.nodes: list[str] = []
        self.relations: list[list[str]] = []
        self.functions: set[str] = set()
        self.names: set[str] = set()

    def plan(self, node) -> None:
        kind = _name(node)
        self.nodes.append(kind)
        if kind == "UnresolvedRelation":
            self.relations.append([str(x) for x in _scala(node.multipartIdentifier())])
        if kind == "UnresolvedTableValuedFunction":
            self.functions.add(".".join(str(x).lower() for x in _scala(node.name())))
        if kind == "UnresolvedWith":
            for pair in _scala(node.cteRelations()):
                self.names.add(str(pair._1()).lower())
                self.plan(pair._2())
        for e in _scala(node.expressions()):
            self.expression(e)
        for child in _scala(node.children()):
            self.plan(child)

    def expression(self, e) -> None:
        kind = _name(e)
        if kind == "UnresolvedFunction":
            self.functions.add(".".join(str(x).lower() for x in _scala(e.nameParts())))
        if kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "UnresolvedTableArgument", "FunctionTableSubqueryArgumentExpression"):
            self.plan(e.plan())
        for child in _scala(e.children()):
            self.expression(child)


_BUILTIN: dict[str, frozenset[str]] = {}


def builtin_functions(spark: SparkSession) -> frozenset[str]:
    """The names of all functions, scalar and table-valued, that Spark itself brings."""
    if not _BUILTIN:
        analysis = spark._jvm.org.apache.spark.sql.catalyst.analysis
        names: set[str] = set()
        for registry in (analysis.FunctionRegistry.builtin(), analysis.TableFunctionRegistry.builtin()):
            names.update(str(i.funcName()).lower() for i in _scala(registry.listFunction()))
        _BUILTIN["names"] = frozenset(names)
    return _BUILTIN["names"]


def _registered(spark: SparkSession, name: str) -> bool:
    """Whether a function that is not built in exists all the same; one that exists nowhere fails when it runs."""
    return bool(spark.catalog.functionExists(name))


def analyse(spark: SparkSession, sql: str, known_tables: Iterable[str]) -> StaticCheck:
    """Check ``sql`` against the tables that may be read; never raises for bad SQL."""
    found = StaticCheck(sql)
    statements = split_statements(sql)
    found.statements = len(statements)
    if not statements:
        found.error = "empty statement"
        return found
    plans = []
    for statement in statements:
        if m := _WRITES.match(statement):
            found.kind = found.kind or m.group().strip(" (\n\t").lower()
            continue
        try:
            plans.append(spark._jsparkSession.sessionState().sqlParser().parsePlan(statement))
        except Exception as error:
            found.error = str(error).split("\n")[0]
            return found
    found.parseable = True
    if found.kind or len(plans) != 1:
        return found
    plan = plans[0]
    walk = _Walk()
    walk.plan(plan)
    found.kind = _name(plan)
    found.read_only = all(n in _SAFE_NODES for n in walk.nodes)
    found.functions = walk.functions
    found.blocked = {f for f in walk.functions if f in BLOCKED_FUNCTIONS or "." in f or (f not in builtin_functions(spark) and _registered(spark, f))}
    known = {t.lower() for t in known_tables}
    for parts in walk.relations:
        name = ".".join(parts).lower()
        if name in walk.names and len(parts) == 1:
            continue
        found.tables.add(name)
        if len(parts) != 1 or name not in known:
            found.unknown_tables.add(name)
    return found


def value_is_asked(value: object, sql: str, question: str) -> bool:
    """A slot's value that is in the SQL must be in the question too."""
    text = str(value).lower()
    return text not in sql.lower() or text in question.lower()
