"""Invented rows for any schema, made where they are needed: every value is a hash of its table, column and row number.

Nothing is collected or kept in memory, and the same seed gives the same rows in any number
of partitions. Foreign keys are skewed, a share of what may be null is null, and times
spread over some years.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.retrieval.schema import TableInfo

_WORDS = "amber birch cedar delta ember fjord grove harbor iris juniper kelp lumen maple north ocean pine quartz river stone tundra umber violet willow yarrow zephyr".split()
_FIRST_DAY, _DAYS = "2019-01-01", 2500


def _dice(seed: int, *parts: str) -> Column:
    """A uniform number from 0 up to 1 of a row."""
    return F.pmod(F.xxhash64(F.col("row"), F.lit(seed), *(F.lit(p) for p in parts)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _word(seed: int, *parts: str) -> Column:
    return F.element_at(F.array(*map(F.lit, _WORDS)), (_dice(seed, *parts) * len(_WORDS)).cast("int") + 1)


def _value(info: TableInfo, column: str, kind: str, counts: dict[str, int], seed: int) -> Column:
    here = (info.name, column)
    if column == info.key:
        return F.col("row") + 1
    if column in info.foreign:
        # the square of a uniform number crowds low keys; a table that points at itself points to earlier rows, and its first row nowhere
        to = info.foreign[column]
        most = F.col("row") if to == info.name else F.lit(max(counts[to], 1))
        key = F.floor(F.pow(_dice(seed, *here), 2) * most) + 1
        return F.when(F.col("row") > 0, key) if to == info.name else key
    if kind == "boolean":
        return _dice(seed, *here) < 0.9
    if kind in ("date", "timestamp"):
        moment = F.timestamp_add("SECOND", (_dice(seed, *here) * (_DAYS * 86_400)).cast("int"), F.lit(_FIRST_DAY).cast("timestamp_ntz"))
        return moment.cast("date") if kind == "date" else moment
    if kind.startswith("decimal") or kind == "real":
        return F.round(F.exp(_dice(seed, *here) * 6), 2).cast(kind if kind != "real" else "double")
    if kind == "integer":
        return F.floor(F.exp(_dice(seed, *here) * 5)).cast("bigint")
    return F.concat_ws(" ", _word(seed, *here, "a"), _word(seed, *here, "b"))


def synthetic_table(spark: SparkSession, info: TableInfo, counts: dict[str, int], seed: int = 0, null_share: float = 0.05) -> DataFrame:
    """``counts[info.name]`` rows of a table; keys count from 1, so that foreign keys of other tables meet them."""
    rows = spark.range(counts[info.name]).withColumnRenamed("id", "row")
    columns = []
    for column, kind in info.columns.items():
        value = _value(info, column, kind, counts, seed)
        if column != info.key and column not in info.foreign:
            value = F.when(_dice(seed, info.name, column, "null") >= null_share, value)
        columns.append(value.alias(column))
    return rows.select(*columns)


def synthetic_schema(spark: SparkSession, tables: list[TableInfo], counts: dict[str, int], seed: int = 0) -> dict[str, DataFrame]:
    """A lazy frame for each table."""
    return {t.name: synthetic_table(spark, t, counts, seed) for t in tables}
