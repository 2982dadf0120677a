"""Ranks within classes of any size without sorting a class in one task."""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.storage import materialize


def bucket_rank(rows: DataFrame, classes: list[str], ids: list[str], rank: str = "rank", total_rows: int | None = None, bucket_rows: int = 50_000) -> DataFrame:
    """Add ``rank``, 0-based and dense within each class, in a fixed pseudo-random order of ``ids``.

    Rows fall into hash buckets of about ``bucket_rows`` rows of a class; a row's rank is its
    place in its bucket after the rows of the class in earlier buckets. Equal rows get
    neighbouring ranks. Null classes are classes of their own.
    """
    n = rows.count() if total_rows is None else total_rows
    buckets = max(1, -(-n // bucket_rows))
    spread = rows.withColumn("__h", F.xxhash64(*ids)).withColumn("__b", F.pmod(F.shiftright("__h", 7), F.lit(buckets)))
    keys = [*classes, "__b"]
    before = Window.partitionBy(*classes).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = spread.groupBy(*keys).agg(F.count("*").alias("__n"))
    offsets = sizes.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    within = F.row_number().over(Window.partitionBy(*keys).orderBy("__h", *ids)) - 1
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    numbered = spread.withColumn("__w", within)
    return numbered.join(offsets, same).select(*rows.columns, (F.col("__w") + F.col("__offset")).cast("long").alias(rank))


def range_rank(rows: DataFrame, classes: list[str], order: list[str | Column], rank: str = "rank", bucket_rows: int = 50_000) -> DataFrame:
    """Add ``rank``, 0-based and dense within each class in the order of ``order`` (ties in any fixed order), and ``rank_rows``, the rows of the class.

    Rows are range-partitioned by class and order and written once; a row's rank is its place
    in its partition after the class's rows in earlier partitions. No task holds a class.
    """
    n = rows.count()
    parts = max(1, -(-n // bucket_rows))
    spread = [*classes, *order]
    ranged = materialize(rows.repartitionByRange(parts, *spread).withColumn("__part", F.spark_partition_id()))
    keys = [*classes, "__part"]
    sizes = ranged.groupBy(*keys).agg(F.count("*").alias("__n"))
    whole = Window.partitionBy(*classes)
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"), F.sum("__n").over(whole).alias("rank_rows"))
    within = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    return ranged.withColumn("__w", within).join(offsets, same).select(*rows.columns, (F.col("__w") + F.col("__offset")).cast("long").alias(rank), "rank_rows")


def latest_of_each(rows: DataFrame, by: str, moment: str, ties: list[str], n: int, place: str = "place") -> DataFrame:
    """The ``n`` latest rows of each class with their ``place`` from 1; equal moments in the order of ``ties``.

    Days are counted first: only rows from each class's last days that hold ``n`` rows meet
    in the window, so that no class is sorted as a whole. Rows without a moment are left out.
    """
    timed = rows.where(F.col(moment).isNotNull())
    day = F.date_trunc("day", F.col(moment)).alias("__day")
    days = timed.groupBy(by, day).agg(F.count("*").alias("__n"))
    later = F.sum("__n").over(Window.partitionBy(by).orderBy(F.desc("__day")).rowsBetween(Window.unboundedPreceding, -1))
    since = days.withColumn("__later", F.coalesce(later, F.lit(0))).where(F.col("__later") < n).groupBy(F.col(by).alias("__by")).agg(F.min("__day").alias("__since"))
    last = timed.join(since, F.col(by).eqNullSafe(F.col("__by")) & (F.col(moment) >= F.col("__since"))).select(*rows.columns)
    ranked = last.withColumn(place, F.row_number().over(Window.partitionBy(by).orderBy(F.desc(moment), *ties)))
    return ranked.where(F.col(place) <= n).withColumn(place, F.col(place).cast("bigint"))


#: Up to so many rows one sorted task is the quickest way to rank them all.
ONE_TASK_ROWS = 1_000_000


def place_rows(rows: DataFrame, kind: str, value: str, ids: list[str], classes: list[str] | None = None, tiles: int = 1, place: str = "place", one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """Add ``place`` (bigint, from 1) by ``value`` downwards, as the window functions rank, dense_rank, row_number or ntile give it.

    ``ids`` break ties where the function needs it. Beyond ``one_task_rows`` rows no task holds
    a class: rows are ranked over range partitions, and equal values get their first rank by an
    aggregation over values. Null values come first, as they do downwards.
    """
    by = classes or []
    kept = materialize(rows)
    down = F.col(value).desc_nulls_first()
    if kept.count() <= one_task_rows:
        window = (Window.partitionBy(*by) if by else Window).orderBy(down, *([] if kind in ("rank", "dense_rank") else ids))
        function = F.ntile(tiles) if kind == "ntile" else getattr(F, kind)()
        return kept.withColumn(place, function.over(window).cast("bigint"))
    if kind == "dense_rank":
        values = range_rank(kept.select(*by, value).distinct(), by, [down], "__r").select(*by, value, "__r")
        return _with_value(kept, values, [*by, value]).withColumn(place, F.col("__r") + 1).drop("__r")
    ranked = range_rank(kept, by, [down, *ids], "__r")
    if kind == "rank":
        first = materialize(ranked).groupBy(*by, value).agg(F.min("__r").alias("__r"))
        return _with_value(kept, first, [*by, value]).withColumn(place, F.col("__r") + 1).drop("__r")
    if kind == "row_number":
        return ranked.withColumn(place, F.col("__r") + 1).drop("__r", "rank_rows")
    n, r = F.col("rank_rows"), F.col("__r")
    small, larger = F.floor(n / tiles), n % tiles  # the first tiles hold one row more
    edge = larger * (small + 1)
    tile = F.when(r < edge, F.floor(r / (small + 1))).otherwise(larger + F.floor((r - edge) / F.greatest(small, F.lit(1)))) + 1
    return ranked.withColumn(place, tile.cast("bigint")).drop("__r", "rank_rows")


def exact_quantiles(rows: DataFrame, value: Column, at: list[float], classes: list[str] | None = None, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """(classes, q array<double>): interpolated quantiles of the values that are not null; no row for a class without values, one of null without classes.

    Up to ``one_task_rows`` values are aggregated as they are. Beyond, without classes, a
    sketch bounds each quantile and the few values between its bounds are counted; with
    classes, ranks over range partitions give the two neighbours of each quantile. No task
    holds all values. ``rows`` are read several times.
    """
    by = classes or []
    v = rows.select(*by, value.cast("double").alias("__v")).where("__v is not null")
    total_rows = v.count()
    if total_rows <= one_task_rows:
        return v.groupBy(*by).agg(F.percentile("__v", F.array(*map(F.lit, at))).alias("q"))
    if not by and (found := _bounded_quantiles(v, at, total_rows)) is not None:
        return rows.sparkSession.createDataFrame([(found,)], "q array<double>")
    n = F.col("rank_rows")
    ranked = range_rank(v, by, ["__v"], "__r")
    place = [F.lit(p) * (n - 1) for p in at]
    pick = lambda r: F.max(F.when(F.col("__r") == r, F.col("__v")))
    ends = ranked.groupBy(*by).agg(F.max("rank_rows").alias("rank_rows"), *(f(pick, p, i) for i, p in enumerate(place) for f in (lambda k, p, i: k(F.floor(p)).alias(f"__lo{i}"), lambda k, p, i: k(F.ceil(p)).alias(f"__hi{i}"))))
    return ends.select(*by, F.array(*(F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * (p - F.floor(p)) for i, p in enumerate(place))).alias("q"))


def _bounded_quantiles(v: DataFrame, at: list[float], n: int, accuracy: int = 10_000) -> list[float] | None:
    """The interpolated quantiles of ``n`` values __v, or None where a bound of the sketch does not hold, which the counts tell.

    The values between two bounds, about 4 / accuracy of all and at most some 400,000 besides
    equal ones, are counted by value, so that ties take no room.
    """
    accuracy = max(accuracy, n // 100_000)
    place = [p * (n - 1) for p in at]
    low, high = [math.floor(p) for p in place], [math.ceil(p) for p in place]
    shares = [max(0.0, r / n - 2 / accuracy) for r in low] + [min(1.0, (r + 1) / n + 2 / accuracy) for r in high]
    bounds = v.agg(F.percentile_approx("__v", F.array(*map(F.lit, shares)), accuracy).alias("b")).collect()[0].b
    spans = list(zip(bounds[: len(at)], bounds[len(at) :], strict=True))
    below = v.agg(*(F.count_if(F.col("__v") < lo).alias(f"b{i}") for i, (lo, _) in enumerate(spans))).collect()[0]
    inside = F.array_compact(F.array(*(F.when(F.col("__v").between(lo, hi), i) for i, (lo, hi) in enumerate(spans))))
    counted = v.where(functools.reduce(operator.or_, (F.col("__v").between(lo, hi) for lo, hi in spans))).groupBy("__v").agg(F.count("*").alias("__n"))
    start = F.element_at(F.array(*map(F.lit, below)), F.col("__i") + 1)
    upto = start + F.sum("__n").over(Window.partitionBy("__i").orderBy("__v"))
    ranked = counted.select("__v", "__n", F.explode(inside).alias("__i")).withColumn("__upto", upto)
    holds = lambda r, i: F.max(F.when((F.col("__i") == i) & (F.col("__upto") > r) & (F.col("__upto") - F.col("__n") <= r), F.col("__v")))
    ends = ranked.agg(*(holds(r, i).alias(f"{end}{i}") for end, places in (("lo", low), ("hi", high)) for i, r in enumerate(places))).collect()[0]
    if None in ends:
        return None
    return [ends[f"lo{i}"] + (ends[f"hi{i}"] - ends[f"lo{i}"]) * (p - low[i]) for i, p in enumerate(place)]


def _with_value(rows: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    named = values.select(*(F.col(k).alias(f"__v{i}") for i, k in enumerate(keys)), "__r")
    same = [F.col(k).eqNullSafe(F.col(f"__v{i}")) for i, k in enumerate(keys)]
    return rows.join(named, same).select(*rows.columns, "__r")
