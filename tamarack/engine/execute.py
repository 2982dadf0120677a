"""Runs checked SQL: bounded fetch, time limit, error classes and result fingerprints."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.engine.check import analyse
from tamarack.storage import materialize

MAX_ROWS = 100_000
TIMEOUT_S = 30.0
#: SQLSTATE codes and the class of error each stands for.
ERROR_CLASSES = {
    "42601": "syntax_error",
    "42P01": "unknown_table",
    "42703": "unknown_column",
    "42702": "ambiguous_column",
    "42704": "ambiguous_column",
    "42883": "unknown_function",
    "42803": "grouping_error",
    "42804": "type_error",
    "42K09": "type_error",
    "22012": "division_by_zero",
    "57014": "timeout",
}


@dataclass
class ExecutionResult:
    """What came of a statement; ``rows`` holds at most the rows asked for."""

    ok: bool
    sql: str
    columns: list[str] = field(default_factory=list)
    rows: list[tuple] = field(default_factory=list)
    row_count: int | None = None
    truncated: bool = False
    latency_ms: float = 0.0
    fingerprint: str | None = None
    ordered_fingerprint: str | None = None
    error_class: str | None = None
    error_code: str | None = None
    error_message: str | None = None


def _cells(row: Sequence) -> str:
    return "\x1f".join("NULL" if v is None else str(v) for v in row)


def result_fingerprint(rows: Iterable[Sequence]) -> str:
    """One digest for a bag of rows: their order does not matter, repeated rows do."""
    return hashlib.md5("\x1e".join(sorted(map(_cells, rows))).encode("utf-8", "surrogatepass")).hexdigest()


def ordered_fingerprint(rows: Iterable[Sequence]) -> str:
    return hashlib.md5("\x1e".join(map(_cells, rows)).encode("utf-8", "surrogatepass")).hexdigest()


def table_fingerprint(df: DataFrame) -> DataFrame:
    """(rows, checksum): the fingerprint of a bag too large to collect, from sums of row hashes."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NULL")) for c in df.columns]
    digest = F.md5(F.concat_ws("\x1f", *cells))
    part = lambda at: F.conv(F.substring(digest, at, 12), 16, 10).cast("decimal(20,0)")
    sums = [F.coalesce(F.sum(part(at)), F.lit(0)).cast("decimal(38,0)").cast("string") for at in (1, 13)]
    return df.agg(F.count("*").alias("rows"), F.concat_ws(":", *sums).alias("checksum"))


def _in_order(df: DataFrame) -> DataFrame:
    """The rows with their place, from their place in their partition and the sizes of the partitions before."""
    kept = materialize(df.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__at")))
    sizes = sorted(kept.groupBy("__part").count().collect())  # one row a partition
    before, ends = 0, {}
    for part, n in sizes:
        ends[part], before = before, before + n
    offset = F.create_map(*(F.lit(x) for pair in ends.items() for x in pair))[F.col("__part")]
    return kept.withColumn("__place", offset + F.col("__at")).drop("__part", "__at")


def read_result(df: DataFrame, max_rows: int, ordered: bool = False) -> tuple[list[tuple], bool, str, str | None]:
    """(rows, truncated, fingerprint, ordered fingerprint) of a result: at most ``max_rows`` rows, fingerprints over all of them.

    The fingerprints of a result with more rows are sums over the whole of it; the ordered one
    is only taken where it is asked for.
    """
    rows = [tuple(r) for r in df.limit(max_rows + 1).collect()]
    if len(rows) <= max_rows:
        return rows, False, result_fingerprint(rows), ordered_fingerprint(rows)
    whole = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    digest = lambda d: ":".join(map(str, table_fingerprint(d).first()))
    return rows[:max_rows], True, digest(whole), digest(_in_order(whole)) if ordered else None


def classify(error: BaseException) -> tuple[str, str | None]:
    """(class, SQLSTATE) of an error."""
    code = None
    if isinstance(error, PySparkException):
        try:
            code = error.getSqlState()
        except Exception:
            code = None
    return ERROR_CLASSES.get(code or "", "other_error"), code


def run_limited(spark: SparkSession, work, timeout_s: float):
    """``work()`` in a thread of its own job group; cancelled again and again once time is up, since a cancel before the first job has no effect."""
    group, out = f"tamarack-{uuid.uuid4().hex}", {}

    def body() -> None:
        spark.sparkContext.setJobGroup(group, "limited statement", True)
        try:
            out["value"] = work()
        except BaseException as error:
            out["error"] = error

    thread = InheritableThread(target=body, session=spark) if "session" in InheritableThread.__init__.__code__.co_varnames else InheritableThread(target=body)
    thread.daemon = True
    thread.start()
    thread.join(timeout_s)
    if thread.is_alive():
        while thread.is_alive():
            spark.sparkContext.cancelJobGroup(group)
            thread.join(0.2)
        raise TimeoutError(f"stopped after {timeout_s:g} s")
    if "error" in out:
        raise out["error"]
    return out["value"]


def execute(spark: SparkSession, sql: str, known_tables: Iterable[str] | None = None, max_rows: int = MAX_ROWS, timeout_s: float = TIMEOUT_S, ordered: bool = True) -> ExecutionResult:
    """Run one statement; never raises for what the statement does. With ``known_tables`` it is checked first.

    At most ``max_rows`` rows are fetched; fingerprints always tell the whole result, the
    ordered one of a longer result only with ``ordered``.
    """
    if known_tables is not None:
        reason = analyse(spark, sql, known_tables).failure_reason
        if reason:
            return ExecutionResult(False, sql, error_class=reason, error_message=f"rejected: {reason}")
    began = time.perf_counter()

    def work() -> tuple:
        df = spark.sql(sql.strip().rstrip(";"))
        return df.columns, *read_result(df, max_rows, ordered)

    try:
        columns, rows, truncated, fingerprint, in_order = run_limited(spark, work, timeout_s)
    except TimeoutError as error:
        return ExecutionResult(False, sql, latency_ms=(time.perf_counter() - began) * 1000, error_class="timeout", error_code="57014", error_message=str(error))
    except Exception as error:
        kind, code = classify(error)
        return ExecutionResult(False, sql, latency_ms=(time.perf_counter() - began) * 1000, error_class=kind, error_code=code, error_message=str(error).split("\n")[0])
    return ExecutionResult(True, sql, columns, rows, len(rows), truncated, (time.perf_counter() - began) * 1000, fingerprint, in_order)


def projection_matches(spark: SparkSession, sql: str, columns: list[str], gold_fingerprint: str, max_rows: int = MAX_ROWS, timeout_s: float = TIMEOUT_S) -> bool:
    """Whether the gold columns of a result with too many columns are the gold result; not where it fails or takes too long."""

    def work() -> str | None:
        df = spark.sql(sql.strip().rstrip(";"))
        if not set(columns) <= set(df.columns) or df.columns == columns:
            return None
        return read_result(df.select(*(F.col(f"`{c}`") for c in columns)), max_rows)[2]

    try:
        return run_limited(spark, work, timeout_s) == gold_fingerprint
    except Exception:
        return False


def database_fingerprint(tables: dict[str, DataFrame]) -> str:
    """Sixteen digits over the row counts of all tables, counted in one job."""
    if not tables:
        return hashlib.sha256(b"").hexdigest()[:16]
    counts = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("t"), "n")
        counts = one if counts is None else counts.unionByName(one)
    return hashlib.sha256(";".join(f"{r.t}={r.n}" for r in sorted(counts.collect(), key=lambda r: r.t)).encode()).hexdigest()[:16]
