"""Joins to a table of unique keys where some keys may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most this many keys can each hold more than their share, so that a table of them is always small enough to broadcast.
MOST_HOT = 2000
#: Up to so many rows a stored side is left to the planner.
FEW_ROWS = 50_000


def side(stored: DataFrame, few: int = FEW_ROWS) -> DataFrame:
    """A stored table as one side of a join, never broadcast once it has more than ``few`` rows.

    The planner judges a table by its files, and compressed files say little about memory.
    """
    return stored if stored.count() <= few else stored.hint("merge")


def hot_aware_join(rows: DataFrame, unique: DataFrame, keys: list[str], size: str, total_rows: int, least: int = 50_000) -> DataFrame:
    """Inner join of ``rows`` to ``unique`` (one row a key, whose column ``size`` says how many of ``rows`` it matches).

    Keys with more than max(least, total_rows / 2000) rows, of which there are under 2000,
    are broadcast and never shuffled; all others meet in an ordinary join. ``unique`` is looked
    through for such keys first, and where there are any ``rows`` is read twice; both
    should be stored tables or cheap to make.
    """
    limit = max(least, total_rows // MOST_HOT)
    if total_rows <= limit or not unique.where(F.col(size) > limit).take(1):
        return rows.join(unique.hint("merge") if total_rows > 2 * FEW_ROWS else unique, keys)
    hot = F.broadcast(unique.where(F.col(size) > limit))
    cold = unique.where(F.col(size) <= limit)
    cold = cold.hint("merge") if total_rows > 2 * FEW_ROWS else cold
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys))


def salted_join(rows: DataFrame, unique: DataFrame, keys: list[str], size: str, total_rows: int, least: int = 50_000) -> DataFrame:
    """As ``hot_aware_join``, for a ``unique`` whose rows may be wide: a hot key's row is shuffled in as many copies as its rows are too many for one task, and only hot keys with their number of copies, under 2000, are broadcast."""
    limit = max(least, total_rows // MOST_HOT)
    if total_rows <= limit or not unique.where(F.col(size) > limit).take(1):
        return rows.join(unique.hint("merge") if total_rows > 2 * FEW_ROWS else unique, keys)
    copies = F.ceil(F.col(size) / limit).cast("int")
    hot = F.broadcast(unique.where(F.col(size) > limit).select(*keys, copies.alias("__copies")))
    salt = F.when(F.col("__copies").isNull(), 0).otherwise(F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns)), F.col("__copies"))).cast("int")
    spread = rows.join(hot, keys, "left").withColumn("__salt", salt).drop("__copies")
    copied = unique.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.greatest(copies, F.lit(1)) - 1)))
    return spread.join(copied.hint("merge"), [*keys, "__salt"]).drop("__salt")
