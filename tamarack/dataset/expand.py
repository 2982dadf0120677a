"""Templates and value pools into questions with statements."""

from __future__ import annotations

import random
import sys
from collections.abc import Sequence
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.operators.ranking import exact_quantiles, range_rank
from tamarack.storage import materialize

#: A pool with more values than this is numbered in a table of its own; only its drawn values come to the driver.
MOST_VALUES = 10_000
DECILES = tuple(i / 10 for i in range(1, 10))


def categorical_pool(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column, sorted."""
    return df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value")).distinct().orderBy("value")


def calendar_pool(df: DataFrame, column: str, before_last: bool = False) -> DataFrame:
    """The years that occur; with ``before_last`` only those before the latest."""
    years = df.where(F.col(column).isNotNull()).select(F.year(column).cast("bigint").alias("value")).distinct()
    if before_last:
        years = years.crossJoin(F.broadcast(years.agg(F.max("value").alias("last")))).where("value < last").drop("last")
    return years.orderBy("value")


def quantile_pool(df: DataFrame, value: Column, digits: int = 2, at: Sequence[float] = DECILES) -> DataFrame:
    """Rounded quantiles of a quantity that lie strictly between its ends, so that a comparison with them splits the rows."""
    kept = materialize(df.select(value.cast("double").alias("v")))  # quantiles read it several times
    ends = F.broadcast(kept.agg(F.min("v").alias("lo"), F.max("v").alias("hi")))
    one = exact_quantiles(kept, F.col("v"), list(at)).crossJoin(ends)
    return one.select(F.explode("q").alias("x"), "lo", "hi").select(F.round("x", digits).alias("value"), "lo", "hi").where("value > lo and value < hi").select("value").distinct().orderBy("value")


def discrete_pool(df: DataFrame, value: Column) -> DataFrame:
    """The distinct values of a small whole quantity from its smallest to below its largest."""
    values = materialize(df.select(value.cast("bigint").alias("value")).where("value is not null").distinct())
    return values.crossJoin(F.broadcast(values.agg(F.max("value").alias("hi")))).where("value < hi").select("value").orderBy("value")


def slot_combinations(pools: dict[str, DataFrame], most: int = 120, seed: int = 0) -> DataFrame:
    """(slots map<string,string>): all combinations of the pools' values, or ``most`` of them drawn with a fixed seed.

    A pool of any size is drawn from; an empty one is an error. Combinations are drawn by
    their number, so their product is never made.
    """
    held: dict[str, list[str]] = {}
    numbered: dict[str, DataFrame] = {}
    sizes: dict[str, int] = {}
    for name, pool in pools.items():
        values = pool.select(F.col("value").cast("string").alias("value"))
        found = [r[0] for r in values.limit(MOST_VALUES + 1).collect()]
        if not found:
            raise ValueError(f"the pool of {name} has no values")
        if len(found) <= MOST_VALUES:
            held[name], sizes[name] = sorted(found), len(found)
        else:
            kept = materialize(values)
            numbered[name], sizes[name] = range_rank(kept, [], ["value"], "place"), kept.count()
    places = []
    for number in _drawn(prod(sizes.values()), most, seed):
        place = {}
        for name, size in sizes.items():
            number, place[name] = divmod(number, size)
        places.append(place)
    spark = next(iter(pools.values())).sparkSession
    values_at: dict[str, Sequence[str] | dict[int, str]] = dict(held)
    for name, table in numbered.items():
        wanted = spark.createDataFrame([(at,) for at in sorted({p[name] for p in places})], "place bigint")
        values_at[name] = dict(table.join(F.broadcast(wanted), "place").select("place", "value").collect())  # at most one a combination
    rows = [({name: values_at[name][at] for name, at in place.items()},) for place in places]
    return spark.createDataFrame(rows, "slots map<string,string>")


def _drawn(every: int, most: int, seed: int) -> Sequence[int]:
    """The numbers below ``every``, or ``most`` different ones of them in order."""
    draw = random.Random(seed)
    if every <= most:
        return range(every)
    if every <= sys.maxsize:
        return sorted(draw.sample(range(every), most))
    numbers: set[int] = set()  # sample takes no longer range
    while len(numbers) < most:
        numbers.add(draw.randrange(every))
    return sorted(numbers)


def escaped(slots: Column) -> Column:
    """Slots whose values can stand inside the quotes of a literal."""
    return F.transform_values(slots, lambda _, v: F.replace(v, F.lit("'"), F.lit("''")))


def render(text: Column, slots: Column) -> Column:
    """``text`` with every {slot} replaced by its value."""
    return F.aggregate(F.map_entries(slots), text, lambda acc, e: F.replace(acc, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))


def slots_of(text: Column) -> Column:
    """The slots that a text names, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\{(\w+)\}"), 1))


def expand(templates: DataFrame, combinations: DataFrame) -> DataFrame:
    """Questions (id, template_id, question, sql, phrasing, slots) from templates (template_id, questions array, sql) and their (template_id, slots); a value's quotes are doubled in the statement."""
    joined = templates.join(combinations, "template_id")
    asked = joined.select("template_id", "sql", "slots", F.posexplode("questions").alias("phrasing", "q"))
    out = asked.select("template_id", render(F.col("q"), F.col("slots")).alias("question"), render(F.col("sql"), escaped(F.col("slots"))).alias("sql"), "phrasing", "slots")
    return out.select(F.substring(F.sha2(F.concat_ws("|", "template_id", "phrasing", "sql"), 256), 1, 16).alias("id"), "*")


def slots_missing(examples: DataFrame) -> DataFrame:
    """(id, missing): values of slots that an example's statement holds and its question does not say, letter case aside."""
    low = lambda c: F.lower(F.col(c))
    lost = F.filter(F.map_values("slots"), lambda v: F.contains(low("sql"), F.lower(F.replace(v, F.lit("'"), F.lit("''")))) & ~F.contains(low("question"), F.lower(v)))
    return examples.select("id", F.array_distinct(lost).alias("missing")).where(F.size("missing") > 0)


def statistics(examples: DataFrame) -> DataFrame:
    """(examples, templates, questions, statements, fewest, most): what an expansion holds, and the range of examples a template."""
    each = examples.groupBy("template_id").agg(F.count("*").alias("n"))
    whole = examples.agg(F.count("*").alias("examples"), F.countDistinct("question").alias("questions"), F.countDistinct("sql").alias("statements"))
    return whole.crossJoin(F.broadcast(each.agg(F.count("*").alias("templates"), F.min("n").alias("fewest"), F.max("n").alias("most"))))  # one row each


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(template_id, change): templates (template_id, questions, sql) of a new version that were added, removed or say something else."""
    body = F.md5(F.to_json(F.struct("questions", "sql")))
    both = old.select("template_id", body.alias("before")).join(new.select("template_id", body.alias("after")), "template_id", "full")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed")
    return both.select("template_id", change.alias("change")).where("change is not null")


def overlay(old: DataFrame, new: DataFrame) -> DataFrame:
    """The templates of ``old``, those that ``new`` has too in their new form, and the ones that only ``new`` has."""
    return old.join(new.select("template_id"), "template_id", "left_anti").select(*new.columns).unionByName(new)


def repeated_ids(templates: DataFrame) -> DataFrame:
    return templates.groupBy("template_id").agg(F.count("*").alias("n")).where("n > 1")


def uncovered_slots(templates: DataFrame) -> DataFrame:
    """Phrasings that do not name every slot of their statement."""
    q = templates.select("template_id", "sql", F.explode("questions").alias("question"))
    return q.select("template_id", "question", F.array_except(slots_of(F.col("sql")), slots_of(F.col("question"))).alias("missing")).where(F.size("missing") > 0)


def question_collisions(templates: DataFrame) -> DataFrame:
    """Phrasings that different statements share."""
    q = templates.select("sql", F.explode("questions").alias("question"))
    return q.groupBy("question").agg(F.countDistinct("sql").alias("statements")).where("statements > 1")
