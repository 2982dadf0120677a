"""Expressions whose meaning must not depend on the engine: exact sums, half-open years, day counts, null order."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One month after the last order of the sales tables; never the wall clock.
AS_OF = dt.datetime(2001, 9, 1)
_EXACT = "decimal(18,4)"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def total(value: Column) -> Column:
    """An exact sum of money or quantities, the same for any order of the rows; null without rows."""
    return F.sum(value.cast(_EXACT)).cast("double")


def mean(value: Column) -> Column:
    """The exact sum divided by the number of values."""
    return total(value) / F.count(value)


def total_where(condition: Column, value: Column) -> Column:
    return total(F.when(condition, value))


def count_where(condition: Column) -> Column:
    return F.count_if(condition)


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole; null where the whole is 0."""
    return F.lit(100.0) * part / F.nullif(whole.cast("double"), F.lit(0.0))


def in_year(moment: Column, year: int) -> Column:
    """A half-open range instead of a function of the column, so that the scan can skip row groups."""
    return (moment >= F.lit(dt.datetime(year, 1, 1)).cast("timestamp_ntz")) & (moment < F.lit(dt.datetime(year + 1, 1, 1)).cast("timestamp_ntz"))


def year_of(moment: Column) -> Column:
    return F.year(moment).cast("bigint")


def month_of(moment: Column) -> Column:
    """The first instant of the month, without a time zone."""
    return F.date_trunc("month", moment).cast("timestamp_ntz")


def micros_between(start: str, end: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, {start}, {end})")


def mean_days(start: str, end: str) -> Column:
    """Mean days between two instants from an integer sum, which a bigint does not hold beyond some millions of rows; rows with a null end do not count."""
    us = micros_between(start, end)
    return F.sum(us.cast("decimal(19,0)")).cast("double") / F.lit(86_400_000_000.0) / F.count(us)


def ascending(column: str) -> Column:
    """Nulls last, as most databases sort upwards."""
    return F.col(column).asc_nulls_last()


def descending(column: str) -> Column:
    """Nulls first, as most databases sort downwards."""
    return F.col(column).desc_nulls_first()
