"""The shape of SQL statements, read from their tokens: what they join, group, rank and limit.

One pass over the tokens of a statement, so that it runs over Arrow batches of any number
of statements; Spark's own parser lives on the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKENS = re.compile(r"""--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|"(?:[^"]|"")*"|`[^`]*`|(?:[^\W\d]|[^\x00-\x7f\s])(?:\w|[^\x00-\x7f\s])*|\d(?:[\w.]|[^\x00-\x7f\s])*|[^\s]""", re.S)
_ENDS_FROM = frozenset("where group having order limit offset fetch union intersect except window qualify returning".split())
_KEYWORDS = _ENDS_FROM | frozenset("select from join left right full inner outer cross natural on using as lateral only with recursive and or not in exists between is null case when then else end by distinct all".split())
#: Functions that have a FROM of their own between their brackets.
_FROM_INSIDE = frozenset("extract substring trim overlay position".split())


_NUMBER = re.compile(r"\d+(?:\.\d*)?(?:e\d*)?\Z")
_NO_SQL = frozenset(";'\"`")


@dataclass(frozen=True)
class Shape:
    """What a statement is made of; ``parsed`` is false for text that does not read as one query."""

    parsed: bool
    tables: tuple[str, ...] = ()
    joins: int = 0
    group_by: bool = False
    having: bool = False
    limit: bool = False
    order_by: bool = False
    window: bool = False
    distinct: bool = False
    subqueries: int = 0
    null_function: bool = False


def _words(sql: str) -> list[str]:
    out = []
    for t in _TOKENS.findall(sql):
        if t.startswith(("--", "/*")):
            continue
        out.append("''" if t[0] == "'" and len(t) > 1 else '"' + t[1:-1].lower() if t[0] in '"`' and len(t) > 2 else t.lower())  # a quoted name is no keyword
    while out and out[-1] == ";":
        out.pop()
    return out


def _names(w: str) -> bool:
    return bool(w) and w not in _KEYWORDS and (w[0].isalpha() or w[0] in '_"' or not w[0].isascii())


def _defined(words: list[str]) -> set[str]:
    """Names that a WITH defines."""
    names = set()
    for i, w in enumerate(words):
        if w != "as":
            continue
        j = i + 1
        while j < len(words) and words[j] in ("not", "materialized"):
            j += 1
        if words[j : j + 1] != ["("] or words[j + 1 : j + 2] not in (["select"], ["with"], ["values"], ["("]):
            continue
        k = i - 1
        if k >= 0 and words[k] == ")":  # a list of columns
            while k >= 0 and words[k] != "(":
                k -= 1
            k -= 1
        if k >= 0:
            names.add(words[k].lstrip('"'))
    return names


def statement_shape(sql: str | None) -> Shape:
    """The shape of ``sql``; of text that is empty, ends within a bracket or clause, or is no query, only that it is not parsed."""
    words = _words(sql or "")
    # a lone quote opens a string that never ends, and a number does not run into letters
    if not words or words[0] not in ("select", "with", "(", "values") or any(w in _NO_SQL or w[0].isdigit() and not _NUMBER.match(w) for w in words):
        return Shape(False)
    level, reading, wanted, inside = 0, {}, set(), []
    tables: set[str] = set()
    counts = {"joins": 0, "subqueries": 0}
    marks = dict.fromkeys(("group_by", "having", "limit", "order_by", "window", "distinct", "null_function"), False)
    for i, w in enumerate(words):
        before, after = words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else ""
        if level in wanted and w not in ("lateral", "only", "("):
            wanted.discard(level)
            if w in _KEYWORDS or w[0].isdigit() or w[0] in "'.,)":
                return Shape(False)
            at = i
            while words[at + 1 : at + 2] == ["."] and at + 2 < len(words):
                at += 2
            if words[at + 1 : at + 2] != ["("]:
                tables.add(words[at].lstrip('"'))
        if before in ("=", "<", ">") and _names(w) and _names(after):
            return Shape(False)  # two names side by side, as from a value without its quotes
        if w == "(":
            wanted.discard(level)
            inside.append(before)
            level += 1
            counts["subqueries"] += after in ("select", "with")
        elif w == ")":
            if not inside or level in wanted:
                return Shape(False)
            reading.pop(level, None)
            inside.pop()
            level -= 1
        elif w == "from" and before != "distinct" and not (inside and inside[-1] in _FROM_INSIDE):
            reading[level] = True
            wanted.add(level)
        elif w == "join" or (w == "," and reading.get(level)):
            counts["joins"] += 1
            wanted.add(level)
        elif w in _ENDS_FROM:
            reading.pop(level, None)
            marks["group_by"] |= w == "group" and after == "by"
            marks["order_by"] |= w == "order" and after == "by"
            marks["having"] |= w == "having"
            marks["limit"] |= w in ("limit", "fetch")
        elif w == "over":
            marks["window"] |= after != "," and before == ")"
        elif w == "distinct":
            marks["distinct"] |= before not in ("is", "not")
        elif w in ("coalesce", "nullif"):
            marks["null_function"] |= after == "("
    if inside or level in wanted or words[-1] in _KEYWORDS - {"end", "null", "all"} or words[-1] in ("=", "<", ">", ",", "."):
        return Shape(False)
    return Shape(True, tuple(sorted(tables - _defined(words))), **counts, **marks)


def shape_tag(gold: Shape, predicted: Shape, gold_rows: int, predicted_rows: int) -> str:
    """The first difference in shape, in a fixed order of weight; ``filter_logic`` where there is none."""
    if not (gold.parsed and predicted.parsed):
        return "unparsed"
    ranked = gold.limit and (predicted_rows != gold_rows or not predicted.limit)
    tests = {
        "wrong_tables": gold.tables != predicted.tables,
        "join_structure": gold.joins != predicted.joins,
        "aggregation_structure": (gold.group_by, gold.having) != (predicted.group_by, predicted.having),
        "window_function": gold.window != predicted.window,
        "limit_or_ranking": ranked,
        "null_handling": gold.null_function != predicted.null_function,
        "distinct": gold.distinct != predicted.distinct,
    }
    return next((name for name, differs in tests.items() if differs), "filter_logic")


def tagged(results: DataFrame) -> DataFrame:
    """(example_id, tag): the first difference in shape between each wrong prediction that ran and its gold statement."""

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(i).to_pylist() for i in range(1, 5)), strict=True)
            tags = [shape_tag(statement_shape(g), statement_shape(p), n or 0, k or 0) for g, p, n, k in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tags, pa.string())], ["example_id", "tag"])

    wrong = results.where((F.col("outcome") == "wrong_result") & F.col("predicted_sql").isNotNull())
    return wrong.select("example_id", "gold_sql", "predicted_sql", "gold_row_count", "predicted_row_count").mapInArrow(tag, "example_id string, tag string")


def statement_tables(statements: DataFrame, sql: str = "sql") -> DataFrame:
    """The rows with ``tables``, the sorted stored tables that each statement reads; null where it does not read as a query."""
    from pyspark.sql import types as T

    schema = T.StructType([*statements.schema.fields, T.StructField("tables", T.ArrayType(T.StringType()))])
    at = statements.columns.index(sql)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shapes = [statement_shape(s) for s in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([list(s.tables) if s.parsed else None for s in shapes], pa.list_(pa.string()))], [*b.schema.names, "tables"])

    return statements.mapInArrow(read, schema)
