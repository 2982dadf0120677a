"""Work for all cores from scans of few files."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(scan: DataFrame) -> DataFrame:
    """The rows of a plain scan over at least as many partitions as there are cores.

    A table of one row group is read by one task, and what Python does to its rows would
    run there alone. Larger tables and plans that shuffle already stay as they are.
    """
    plan = scan._jdf.queryExecution().executedPlan()
    if "Exchange" in plan.toString():
        return scan
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if 0 < scan._jdf.queryExecution().toRdd().getNumPartitions() < cores else scan
