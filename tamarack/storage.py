"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir`` rather than by RDD
checkpoints: columnar files are smaller and a lost executor loses nothing.
"""

from __future__ import annotations

import atexit
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where it is unset (tests, local mode)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="tamarack-")
    return _OWN[app]


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared store; a session that is gone already leaves it to ``sweep``."""
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    where, system = _hadoop(spark, path)
    system.delete(where, True)


def tables_dir(spark: SparkSession) -> str:
    """Where this application keeps its intermediate tables."""
    return f"{shared_dir(spark)}/tamarack/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written.

    The table goes with the scope that is open (``scope``), else with the application. The
    scan is lazy, so a scope must not end before its result is read.
    """
    spark = df.sparkSession
    path = f"{tables_dir(spark)}/{uuid.uuid4().hex}"
    if spark.sparkContext.applicationId not in _ENDS:
        _ENDS.add(spark.sparkContext.applicationId)
        atexit.register(delete, spark, tables_dir(spark))
    if _SCOPES:
        _SCOPES[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_ENDS: set[str] = set()
_SCOPES: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """All intermediate tables that are written inside are removed at the end, whatever happened; for long sessions, around a query and the reading of its result."""
    mine: list[str] = []
    _SCOPES.append(mine)
    try:
        yield
    finally:
        _SCOPES.remove(mine)
        for path in mine:
            delete(spark, path)


def sweep(spark: SparkSession, older_than_s: float = 7 * 86_400) -> list[str]:
    """Remove what applications that ended without cleaning up have left: folders of other applications that nothing was written to for ``older_than_s`` seconds; gives the ones removed."""
    where, system = _hadoop(spark, f"{shared_dir(spark)}/tamarack")
    if not system.exists(where):
        return []
    own, gone = spark.sparkContext.applicationId, []
    for entry in system.listStatus(where):
        name = entry.getPath().getName()
        newest = max([entry.getModificationTime(), *(e.getModificationTime() for e in system.listStatus(entry.getPath()))])
        if name != own and time.time() * 1000 - newest > older_than_s * 1000:
            system.delete(entry.getPath(), True)
            gone.append(name)
    return sorted(gone)
