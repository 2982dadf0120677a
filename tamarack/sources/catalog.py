"""What is known about the stored tables, and whether their rows keep to it.

Spark enforces no keys, references or ranges, so they are declared here and counted: one pass
over a table for all its columns' rules, one aggregation a key, one anti join a reference.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.sources.tables import table


@dataclass(frozen=True)
class Rules:
    """Key columns, required columns, references (column: (table, column)) and conditions in SQL that every row meets."""

    key: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    references: dict[str, tuple[str, str]] = field(default_factory=dict)
    conditions: dict[str, str] = field(default_factory=dict)


CATALOG: dict[str, Rules] = {
    "region": Rules(("r_regionkey",), ("r_name",)),
    "nation": Rules(("n_nationkey",), ("n_name",), {"n_regionkey": ("region", "r_regionkey")}),
    "customer": Rules(("c_custkey",), ("c_name", "c_mktsegment"), {"c_nationkey": ("nation", "n_nationkey")}),
    "supplier": Rules(("s_suppkey",), ("s_name",), {"s_nationkey": ("nation", "n_nationkey")}),
    "part": Rules(("p_partkey",), ("p_name", "p_brand"), {}, {"price is positive": "p_retailprice > 0"}),
    "orders": Rules(("o_orderkey",), ("o_orderdate",), {"o_custkey": ("customer", "c_custkey")}, {"status is known": "o_orderstatus IN ('F', 'O', 'P')", "total is positive": "o_totalprice > 0"}),
    "lineitem": Rules((), ("l_shipdate",), {"l_orderkey": ("orders", "o_orderkey"), "l_partkey": ("part", "p_partkey"), "l_suppkey": ("supplier", "s_suppkey")}, {"discount is a share": "l_discount BETWEEN 0 AND 1", "quantity is positive": "l_quantity > 0"}),
    "events": Rules(("event_id",), ("ts", "event_type")),
    "documents": Rules(("doc_id",), ("source",)),
    "suppliers": Rules(("supplier_id",), ("supplier_name", "country"), {}, {"rating is in range": "rating IS NULL OR rating BETWEEN 0 AND 5"}),
    "products": Rules(("product_id",), ("product_name", "sku"), {"category_id": ("categories", "category_id"), "supplier_id": ("suppliers", "supplier_id")}, {"price is positive": "unit_price > 0"}),
    "categories": Rules(("category_id",), ("category_name",), {"parent_category_id": ("categories", "category_id")}),
}


def register(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """All catalogued tables as temporary views."""
    found = {n: table(spark, sf_dir, n) for n in (names or CATALOG)}
    for name, df in found.items():
        df.createOrReplaceTempView(name)
    return found


def save(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Replace a table as a whole; sorted within files where an order is given, so that scans can skip row groups.

    The new table is written beside the old one and takes its place when it is complete:
    a load that fails leaves what was there, and the table may be made from itself.
    """
    spark = df.sparkSession
    fresh, old = (f"{path.rstrip('/')}.{what}-{uuid.uuid4().hex}" for what in ("new", "old"))
    (df.sortWithinPartitions(*order) if order else df).write.parquet(fresh)
    to_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = to_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = system.exists(to_path(path))
    if there and not system.rename(to_path(path), to_path(old)):
        raise OSError(f"cannot move {path} aside")
    if not system.rename(to_path(fresh), to_path(path)):
        if there:
            system.rename(to_path(old), to_path(path))
        raise OSError(f"cannot put the new table at {path}")
    if there:
        system.delete(to_path(old), True)


def analyze(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A catalogued table over the files at ``path`` with statistics of all its columns, for the cost-based optimizer; its rows are not copied."""
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    spark.catalog.createTable(name, path, "parquet")
    spark.sql(f"ANALYZE TABLE `{name}` COMPUTE STATISTICS FOR ALL COLUMNS")
    return spark.table(name)


def quality(tables: dict[str, DataFrame], catalog: dict[str, Rules] | None = None) -> DataFrame:
    """(table_name, check, failed): how many rows break each rule; repeated keys count once a key, null references are sound."""
    out: DataFrame | None = None
    add = lambda df: df if out is None else out.unionByName(df)
    for name, rules in (catalog or CATALOG).items():
        df = tables[name]
        tests = {f"{c} is null": F.col(c).isNull() for c in (*rules.key, *rules.required)} | {f"not: {n}": ~F.coalesce(F.expr(c), F.lit(False)) for n, c in rules.conditions.items()}
        if tests:
            one = df.agg(*(F.count_if(t).alias(f"t{i}") for i, t in enumerate(tests.values())))
            rows = F.array(*(F.struct(F.lit(name).alias("table_name"), F.lit(n).alias("check"), F.col(f"t{i}").alias("failed")) for i, n in enumerate(tests)))
            out = add(one.select(F.explode(rows).alias("r")).select("r.*"))
        if rules.key:
            twice = df.groupBy(*rules.key).agg(F.count("*").alias("n")).where("n > 1")
            out = add(twice.agg(F.lit(name).alias("table_name"), F.lit("key is repeated").alias("check"), F.count("*").alias("failed")))
        for column, (other, key) in rules.references.items():
            # distinct first: a frequent value is one row in the join
            values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
            lost = values.join(tables[other].select(F.col(key).alias("v")), "v", "left_anti")
            out = add(lost.agg(F.lit(name).alias("table_name"), F.lit(f"{column} is not in {other}").alias("check"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("failed")))
    if out is None:
        raise ValueError("no rules")
    return out


def quality_sql(catalog: dict[str, Rules] | None = None) -> str:
    """The same counts in SQL, for comparison."""
    parts = []
    for name, rules in (catalog or CATALOG).items():
        tests = {f"{c} is null": f"{c} IS NULL" for c in (*rules.key, *rules.required)} | {f"not: {n}": f"NOT coalesce({c}, FALSE)" for n, c in rules.conditions.items()}
        parts += [f"SELECT '{name}' AS table_name, '{n}' AS \"check\", count(*) FILTER ({t}) AS failed FROM {name}" for n, t in tests.items()]
        if rules.key:
            keys = ", ".join(rules.key)
            parts.append(f"SELECT '{name}', 'key is repeated', count(*) FROM (SELECT {keys} FROM {name} GROUP BY {keys} HAVING count(*) > 1)")
        parts += [f"SELECT '{name}', '{c} is not in {other}', count(*) FROM {name} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {key} FROM {other})" for c, (other, key) in rules.references.items()]
    return "\nUNION ALL ".join(parts)
