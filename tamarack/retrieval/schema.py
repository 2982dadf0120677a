"""Tables of a schema found for a question: names, comments, foreign keys and stored values."""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of a hit in a table's name, a column's name, a comment, and a stored value (shared by the places that hold it).
NAME, COLUMN, COMMENT, VALUE = 3.0, 1.0, 0.4, 2.5
MOST_VALUES, FLOOR = 400, 0.15
_IRREGULAR = ("ss", "us", "is")
#: Words of questions that are no stored values, though descriptions and names of desks may hold them.
STOPWORDS = frozenset("a an the is are was were be been of in on at to for from by with and or as that this these those it its we our us you your show list give display find get which what who whom whose where when how many much all any each every do does did have has had please me my there their them than then into out".split())


def singular(word: str) -> str:
    """A plain plural ending off: categories, boxes, orders; but status and address stay."""
    if len(word) > 4 and word.endswith("ies"):
        return word[:-3] + "y"
    if len(word) > 4 and word.endswith(("xes", "ches", "shes", "sses")):
        return word[:-2]
    if len(word) > 3 and word.endswith("s") and not word.endswith(_IRREGULAR):
        return word[:-1]
    return word


def terms(text: str) -> list[str]:
    """Words of an identifier or a sentence, in lower case and singular."""
    return [singular(w) for w in re.findall(r"[a-z0-9]+", text.lower())]


def words_column(text: Column) -> Column:
    """The words of a text, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+)"), 1)


def terms_column(text: Column) -> Column:
    """``terms`` as an expression over a column."""
    return _singulars(words_column(text))


def _singulars(words: Column) -> Column:
    ends = lambda w, *tails: reduce(lambda a, b: a | b, [w.endswith(t) for t in tails])
    less = lambda w, n: F.substring(w, F.lit(1), F.length(w) - n)
    return F.transform(
        words,
        lambda w: F.when(~w.endswith("s"), w)
        .when((F.length(w) > 4) & w.endswith("ies"), F.concat(less(w, 3), F.lit("y")))
        .when((F.length(w) > 4) & ends(w, "xes", "ches", "shes", "sses"), less(w, 2))
        .when((F.length(w) > 3) & ~ends(w, *_IRREGULAR), less(w, 1))
        .otherwise(w),
    )


@dataclass(frozen=True)
class TableInfo:
    """A table with its columns (name: type), comments and foreign keys (column: table)."""

    name: str
    columns: dict[str, str]
    key: str | None = None
    foreign: dict[str, str] = field(default_factory=dict)
    comment: str = ""
    comments: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def of(name: str, df: DataFrame, key: str | None = None, foreign: dict[str, str] | None = None, comment: str = "") -> TableInfo:
        """From a DataFrame's schema; column comments from the fields' metadata."""
        return TableInfo(name, {f.name: short_type(f.dataType.simpleString()) for f in df.schema}, key, foreign or {}, comment, {f.name: f.metadata["comment"] for f in df.schema if "comment" in f.metadata})


def short_type(name: str) -> str:
    """bigint, int and smallint are integers; decimals keep their precision; the rest by its family."""
    if name in ("bigint", "int", "smallint", "tinyint"):
        return "integer"
    if name in ("double", "float"):
        return "real"
    if name.startswith("timestamp"):
        return "timestamp"
    return {"string": "text"}.get(name, name)


def render_schema(tables: list[TableInfo]) -> str:
    """One line a table, its foreign keys below; keys among the given tables only."""
    shown = {t.name for t in tables}
    lines = []
    for t in tables:
        cols = ", ".join(f"{c} {k}" + (" key" if c == t.key else "") for c, k in t.columns.items())
        lines.append(f"{t.name}({cols})" + (f"  -- {t.comment}" if t.comment else ""))
        lines += [f"  {t.name}.{c} -> {other}" for c, other in t.foreign.items() if other in shown]
    return "\n".join(lines)


def schema_summary(tables: list[TableInfo]) -> dict[str, int]:
    return {"tables": len(tables), "columns": sum(len(t.columns) for t in tables), "keys": sum(t.key is not None for t in tables), "foreign_keys": sum(len(t.foreign) for t in tables)}


def value_index(tables: dict[str, DataFrame], most: int = MOST_VALUES) -> DataFrame:
    """(term, place): stored values of text columns with at most ``most`` different ones, whole and by words of over two letters.

    One pass over a table counts the distinct values of all its text columns; only columns
    that pass are read again.
    """
    out: DataFrame | None = None
    for name, df in tables.items():
        text = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
        if not text:
            continue
        counts = df.agg(*(F.countDistinct(c).alias(c) for c in text)).collect()[0]
        for c in text:
            if 0 < counts[c] <= most:
                values = df.where(F.col(c).isNotNull()).select(F.lower(F.trim(F.col(c))).alias("v")).distinct()
                words = F.filter(F.regexp_extract_all("v", F.lit(r"([a-z0-9]+)"), 1), lambda w: F.length(w) > 2)
                found = values.select(F.explode(F.array_union(F.array("v"), words)).alias("term")).distinct().select("term", F.lit(f"{name}.{c}").alias("place"))
                out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("no table has a text column")
    return out


def _known(text: str) -> list[str]:
    """The different terms of a name or comment but stop words, which questions drop too."""
    return sorted({singular(w) for w in re.findall(r"[a-z0-9]+", text.lower()) if w not in STOPWORDS})


def schema_terms(tables: list[TableInfo]) -> list[tuple[str, str, str, list[str]]]:
    """(table, kind, place, terms) of every name, column and comment of the schema that has terms."""
    out = []
    for t in tables:
        comments = [w for text in (t.comment, *t.comments.values()) for w in _known(text)]
        parts = [("name", t.name, _known(t.name)), *(("column", c, _known(c)) for c in t.columns), ("comment", "", sorted(set(comments)))]
        out += [(t.name, kind, place, found) for kind, place, found in parts if found]
    return out


def score_tables(questions: DataFrame, tables: list[TableInfo], values: DataFrame | None = None, key: str = "id", text: str = "question") -> DataFrame:
    """(key, table, score) for all questions at once; tables without a hit have no row.

    A term of the question that is in a table's name or comments counts each time; a column
    counts the terms it shares times the share of its terms that they are, so that a name
    said in full outweighs parts of several. Stop words count nowhere. Stored values
    ``values`` (term, place) count where a word or its singular is the value, or, of values
    of several words, where the question says them one after the other; a value in several
    places shares its weight among them.

    The index of the schema is as small as the schema; the value index has at most
    ``MOST_VALUES`` values a column.
    """
    asked = questions.select(F.col(key).alias("key"), words_column(F.col(text)).alias("words"))
    said = asked.withColumn("kept", F.filter("words", lambda w: ~w.isin(*STOPWORDS))).withColumn("terms", F.array_distinct(_singulars(F.col("kept"))))
    exact = lambda c: F.round(c.cast("double"), 6)
    index = [(term, table, kind, place, len(found)) for table, kind, place, found in schema_terms(tables) for term in found]
    scheme = F.broadcast(questions.sparkSession.createDataFrame(index, "term string, table string, kind string, place string, size int"))
    k = F.col("k").cast("double")
    weight = F.when(F.col("kind") == "column", k * k * F.lit(COLUMN) / F.col("size")).when(F.col("kind") == "name", k * NAME).otherwise(k * COMMENT)
    # all of a question's terms are in one partition, so that hits are counted before anything is shuffled
    met = said.select("key", F.explode("terms").alias("term")).join(scheme, "term").groupBy("key", "table", "kind", "place", "size").agg(F.count("*").alias("k"))
    hits = met.select("key", "table", weight.cast("decimal(18,6)").alias("weight"))
    if values is not None:
        several = F.col("term").contains(" ")
        known = values.where(F.length("term") > 1).select(F.when(several, F.array_join(words_column(F.col("term")), " ")).otherwise(F.col("term")).alias("said"), "term", "place").distinct()
        shared = known.join(known.groupBy("term").agg(F.countDistinct("place").alias("k")), "term").select("said", "term", F.substring_index("place", ".", 1).alias("table"), (F.lit(VALUE) / F.col("k")).cast("decimal(18,6)").alias("weight"))
        longest = values.where(several).agg(F.max(F.size(words_column(F.col("term"))))).first()[0] or 1
        n = F.size("words")
        spans = F.flatten(F.transform(F.sequence(F.lit(2), F.lit(max(longest, 2))), lambda w: F.transform(F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i + w <= n), lambda i: F.array_join(F.slice("words", i + 1, w), " "))))
        spoken = said.select("key", F.explode(F.array_distinct(F.concat("kept", "terms", spans) if longest > 1 else F.concat("kept", "terms"))).alias("said"))
        hits = hits.unionByName(spoken.join(F.broadcast(shared), "said").select("key", "table", "weight"))
    return hits.groupBy("key", "table").agg(exact(F.sum("weight")).alias("score"))


def neighbours(tables: list[TableInfo]) -> dict[str, set[str]]:
    """The graph of foreign keys, both ways."""
    graph: dict[str, set[str]] = {t.name: set() for t in tables}
    for t in tables:
        for other in t.foreign.values():
            if other != t.name and other in graph:
                graph[t.name].add(other)
                graph[other].add(t.name)
    return graph


def shortest_path(graph: dict[str, set[str]], start: str, end: str) -> list[str]:
    """The tables on a shortest way along foreign keys, ends included; empty where there is none."""
    came: dict[str, str | None] = {start: None}
    queue = deque([start])
    while queue:
        at = queue.popleft()
        if at == end:
            path = [at]
            while (up := came[path[-1]]) is not None:
                path.append(up)
            return path[::-1]
        for near in sorted(graph.get(at, ())):
            if near not in came:
                came[near] = at
                queue.append(near)
    return []


#: At most so many tables are taken for their own score.
MOST_TABLES = 6


def select_tables(scores: dict[str, float], tables: list[TableInfo], most: int = MOST_TABLES, expand: int = 0) -> list[str]:
    """Tables within reach of the best score, at most ``most``, and those on the ways between any two of them; all tables where nothing scores.

    With ``expand`` the neighbours of as many of the best tables come too. Equal scores go in the order of the schema.
    """
    best = max(scores.values(), default=0.0)
    if best <= 0:
        return [t.name for t in tables]
    graph, at = neighbours(tables), {t.name: i for i, t in enumerate(tables)}
    ranked = sorted((t for t in scores if t in at), key=lambda t: (-scores[t], at[t]))[:most]
    chosen = [t for t in ranked if scores[t] >= FLOOR * best and scores[t] > 0]
    keep = set(chosen)
    for i, one in enumerate(chosen):
        for other in chosen[i + 1 :]:
            keep.update(shortest_path(graph, one, other))
    for one in chosen[:expand]:
        keep |= graph[one]
    return [t.name for t in tables if t.name in keep]


def selected_tables(keys: DataFrame, scored: DataFrame, tables: list[TableInfo], key: str = "key", most: int = MOST_TABLES) -> DataFrame:
    """(key, selected) for every row of ``keys``: what ``select_tables`` gives for the scores (key, table, score) of each.

    The ways along foreign keys are worked out once for all pairs of tables, which are few.
    """
    graph, names = neighbours(tables), [t.name for t in tables]
    ways = {f"{a}>{b}": shortest_path(graph, a, b) or [a, b] for a in names for b in names}
    way = F.create_map(*(c for k, path in ways.items() for c in (F.lit(k), F.array(*map(F.lit, path)))))
    every = F.array(*map(F.lit, names))
    ranked = scored.where(F.col("table").isin(*names)).groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("low"), F.array_position(every, F.col("table")).alias("at"), "table"))).alias("r"))
    best = F.col("r")[0]
    chosen = F.transform(F.filter(F.slice("r", 1, most), lambda x: (x["low"] <= F.lit(FLOOR) * best["low"]) & (x["low"] < 0)), lambda x: x["table"])
    reached = ranked.where(best["low"] < 0).select(key, chosen.alias("chosen")).select(key, F.flatten(F.flatten(F.transform("chosen", lambda a, i: F.transform(F.slice("chosen", i + 1, most), lambda b: F.element_at(way, F.concat(a, F.lit(">"), b)))))).alias("reached"))
    return keys.select(key).join(reached, key, "left").select(key, F.when(F.col("reached").isNull(), every).otherwise(F.filter(every, lambda t: F.array_contains("reached", t))).alias("selected"))


_NAME = r'(?:["`]?\w+["`]?\s*\.\s*)*["`]?([a-z_]\w*+)["`]?'
_ITEM = r'(?:["`]?\w+["`]?\s*\.\s*)*["`]?[a-z_]\w*+["`]?'


def tables_of(sql: Column) -> Column:
    """The stored tables that a statement reads, in lower case: names after FROM, JOIN and their commas that no WITH defines.

    Any kind of blank parts words. Comments, literals and the FROM inside a function's brackets (EXTRACT, SUBSTRING, TRIM) or of DISTINCT FROM name no table.
    """
    text = F.lower(sql)
    for pattern, by in ((r"'(?:[^']|'')*'", "''"), (r"--[^\n]*|(?s)/\*.*?\*/", " "), (r"[\s\p{Z}\x{200b}\x{feff}\x{85}]+", " "), (r"\b(?:extract|substring|trim|overlay)\s*\([^()]*?\bfrom\b", "("), (r"\bdistinct\s+from\b", " ")):
        text = F.regexp_replace(text, pattern, by)
    lists = F.regexp_extract_all(text, F.lit(rf"\b(?:from|join)\s+(?:only\s+|lateral\s+)?((?:{_ITEM}(?:\s+(?:as\s+)?\w+)?\s*,\s*)*+{_ITEM})(?!\s*[\w.]*\()"), 1)
    items = F.flatten(F.transform(lists, lambda x: F.split(x, r"\s*,\s*")))
    read = F.transform(items, lambda x: F.regexp_extract(F.trim(x), "^" + _NAME, 1))
    defined = F.regexp_extract_all(text, F.lit(r'(?:\bwith\s+(?:recursive\s+)?|,\s*)["`]?([a-z_]\w*)["`]?\s*(?:\([^()]*\)\s*)?as\s+(?:(?:not\s+)?materialized\s+)?\('), 1)
    return F.array_except(read, F.array_union(defined, F.array(F.lit(""))))


def retrieval_quality(found: DataFrame) -> DataFrame:
    """How good selections are, in one row, for (selected array, needed array, correct boolean, used array).

    Recall over all needed tables, share of complete selections, precision, tables shown on
    average, accuracy of the answers where the selection was complete and where it was not,
    and the share of answers whose statement reads a table that was not shown. A question
    that needs no table counts as complete.
    """
    both = F.size(F.array_intersect("selected", "needed"))
    complete = both == F.size("needed")
    share = lambda c, of: F.when(F.count_if(of) > 0, F.lit(100.0) * F.count_if(c & of) / F.count_if(of))
    right = F.coalesce("correct", F.lit(False))
    return found.agg(
        F.count("*").alias("n"),
        (F.lit(100.0) * F.sum(both) / F.sum(F.size("needed"))).alias("recall"),
        share(complete, F.lit(True)).alias("complete"),
        (F.lit(100.0) * F.sum(both) / F.sum(F.size("selected"))).alias("precision"),
        (F.sum(F.size("selected")) / F.count("*")).alias("tables_shown"),
        share(right, complete).alias("accuracy_complete"),
        share(right, ~complete).alias("accuracy_incomplete"),
        share(F.size(F.array_except("used", "selected")) > 0, F.lit(True)).alias("used_unseen"),
    )
