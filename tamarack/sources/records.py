"""Line-delimited records: sources, sinks, checkpoints that can be resumed, and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tamarack.operators.ranking import range_rank


def read_lines(spark: SparkSession, path: str, schema: StructType | str, limit: int | None = None, order: str | None = None) -> DataFrame:
    """JSON lines with a declared schema; ``limit`` takes the first by ``order``."""
    df = spark.read.schema(schema).json(path)
    return df.orderBy(order).limit(limit) if limit is not None and order else df if limit is None else df.limit(limit)


def read_with_header(spark: SparkSession, path: str, schema: StructType | str, mark: str = "_header") -> tuple[DataFrame, DataFrame]:
    """(records, header records): header lines carry the field ``mark``."""
    lines = spark.read.text(path)
    is_header = F.get_json_object("value", f"$.{mark}").isNotNull()
    parsed = lines.where(~is_header).select(F.from_json("value", schema if isinstance(schema, str) else schema).alias("r")).select("r.*")
    return parsed, lines.where(is_header).select("value")


def write_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def not_done(todo: DataFrame, done: DataFrame, key: str = "example_id") -> DataFrame:
    """What a checkpoint does not have yet; repeated keys in the checkpoint do no harm."""
    return todo.join(done.select(key), key, "left_anti")


def append_checkpoint(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def stride_sample(df: DataFrame, n: int, order: list[str], bucket_rows: int = 50_000) -> DataFrame:
    """``n`` rows at equal strides through the order: those at floor(i * rows / n).

    Ranks come from range partitions and their counts, never from one task that holds all rows.
    """
    if n <= 0:
        return df.limit(0)
    ranked = range_rank(df, [], order, "__r", bucket_rows)
    rows, r = F.col("rank_rows"), F.col("__r")
    # r is floor(i * rows / n) for some i exactly when i = ceil(r * n / rows) gives it back
    i = F.ceil(r * F.lit(n) / rows.cast("double"))
    chosen = (rows <= n) | ((F.floor(i * rows / F.lit(float(n))) == r) & (i < n))
    return ranked.where(chosen).select(*df.columns)


def export(df: DataFrame, allowed: list[str], forbidden: set[str]) -> DataFrame:
    """Only the allowed columns; an error if one of them must not leave."""
    leak = set(allowed) & forbidden
    if leak:
        raise ValueError(f"must not be exported: {sorted(leak)}")
    return df.select(*allowed)


def showcase(runs: dict[str, DataFrame], key: str = "example_id") -> DataFrame:
    """One row a key with every run's statement side by side; the first run decides the keys."""
    out: DataFrame | None = None
    for name, df in runs.items():
        side = df.select(key, F.col("sql").alias(f"{name}_sql"))
        out = side if out is None else out.join(side, key, "left")
    if out is None:
        raise ValueError("no runs")
    return out
