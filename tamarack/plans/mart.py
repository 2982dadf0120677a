"""The sales mart: views over the stored tables on which all templates are written.

Each view exists twice, as a lazy DataFrame and as SQL text; the SQL texts are put before a
template's SQL for the comparison with another engine. Columns that the stored tables lack
(sign-up days, managers, reorder levels) are fixed functions of the keys.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.sources.tables import table


class Mart:
    """Lazy views; each is built once for a session and folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def stored(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def area(self) -> DataFrame:
        """25 nations with their region: small by definition of the key."""
        return self.stored("nation").join(F.broadcast(self.stored("region")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("area_id"), F.col("n_name").alias("country"), F.col("r_name").alias("region"))

    @cached_property
    def cust(self) -> DataFrame:
        c = self.stored("customer").selectExpr(
            "c_custkey AS cust_id", "c_name AS cust", "c_nationkey AS area_id", "c_mktsegment AS segment",
            "CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS credit", "c_custkey % 7 <> 0 AS active",
            "date_add(DATE'1994-01-01', CAST(c_custkey % 365 AS INT)) AS signup",
        )
        return c.join(F.broadcast(self.area), "area_id").select("cust_id", "cust", "country", "region", "segment", "credit", "active", "signup")

    @cached_property
    def ord(self) -> DataFrame:
        return self.stored("orders").selectExpr(
            "o_orderkey AS ord_id", "o_custkey AS cust_id", "o_orderstatus AS status", "o_totalprice AS total", "o_orderdate AS placed", "o_orderpriority AS priority",
            "CASE WHEN o_orderpriority <> '5-LOW' THEN o_custkey % 50 END AS rep_id", "date_add(CAST(o_orderdate AS DATE), 60) AS due", "CAST(o_orderkey % 40 + 5 AS DOUBLE) AS freight",
        )

    @cached_property
    def item(self) -> DataFrame:
        return self.stored("lineitem").selectExpr(
            "l_orderkey AS ord_id", "l_partkey AS part_id", "l_suppkey AS sup_id", "l_linenumber AS line", "CAST(l_quantity AS BIGINT) AS qty",
            "l_extendedprice AS price", "l_discount AS disc", "l_extendedprice * (1 - l_discount) AS rev",
        )

    @cached_property
    def prod(self) -> DataFrame:
        return self.stored("part").selectExpr("p_partkey AS part_id", "p_name AS part", "p_brand AS brand", "p_type AS kind", "p_size AS size", "p_retailprice AS list_price")

    @cached_property
    def emp(self) -> DataFrame:
        return self.stored("supplier").selectExpr(
            "s_suppkey AS emp_id", "s_name AS emp", "s_nationkey AS dept_id", "s_acctbal AS salary", "CASE WHEN s_suppkey > 0 THEN (s_suppkey - 1) div 4 END AS boss_id",
            "date_add(DATE'1990-01-01', CAST(s_suppkey * 37 % 3000 AS INT)) AS hired", "concat('grade ', CAST(s_suppkey % 4 AS STRING)) AS title", "s_suppkey % 9 <> 0 AS active",
        )

    @cached_property
    def dept(self) -> DataFrame:
        return self.area.select(F.col("area_id").alias("dept_id"), F.col("country").alias("dept"), F.col("region").alias("site"))

    @cached_property
    def wh(self) -> DataFrame:
        w = self.stored("supplier").selectExpr("s_suppkey AS wh_id", "s_name AS wh", "s_nationkey AS area_id", "CAST(s_suppkey * 100 + 20000 AS BIGINT) AS capacity", "s_suppkey % 5 <> 0 AS active")
        return w.join(F.broadcast(self.area), "area_id").select("wh_id", "wh", "country", "region", "capacity", "active")

    @cached_property
    def pay(self) -> DataFrame:
        return self.stored("lineitem").selectExpr("l_orderkey AS ord_id", "l_linenumber AS line", "l_extendedprice * (1 - l_discount) AS amount", "l_shipdate AS paid", "l_returnflag AS method", "l_linestatus AS status")

    @cached_property
    def ship(self) -> DataFrame:
        return self.stored("lineitem").selectExpr(
            "l_orderkey AS ord_id", "l_partkey AS part_id", "l_linenumber AS line", "l_suppkey AS wh_id", "l_shipdate AS sent", "CASE WHEN l_linestatus = 'F' THEN l_shipdate + make_dt_interval(l_linenumber) END AS arrived",
            "nullif(l_returnflag, 'N') AS carrier", "l_linestatus AS status",
        )

    @cached_property
    def inv(self) -> DataFrame:
        """Units of each part in each warehouse; every line names a part that there is, so that parts are joined only where asked for."""
        return self.stored("lineitem").groupBy(F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("wh_id")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("on_hand"))

    @cached_property
    def inv_part(self) -> DataFrame:
        """Stock with its part and the level at which that is ordered again: one join for all that a part tells."""
        return self.inv.join(self.prod.withColumn("reorder", (F.col("size") * 2).cast("bigint")), "part_id")

    @cached_property
    def goods(self) -> DataFrame:
        """Products of the shop; rows delivered twice count once."""
        return self.stored("products").selectExpr(
            "product_id AS good_id", "product_name AS good", "category_id AS cat_id", "supplier_id AS vend_id", "CAST(unit_price AS DOUBLE) AS price", "CAST(unit_cost AS DOUBLE) AS cost", "CAST(weight_kg AS DOUBLE) AS weight", "is_discontinued AS gone",
        ).distinct()

    @cached_property
    def vend(self) -> DataFrame:
        return self.stored("suppliers").selectExpr("supplier_id AS vend_id", "supplier_name AS vend", "country", "CAST(rating AS DOUBLE) AS rating", "is_active AS active")

    @cached_property
    def cat(self) -> DataFrame:
        """Categories, for each id the latest row."""
        newest = F.max_by(F.struct(F.col("category_name").alias("cat"), F.col("parent_category_id").alias("up_id")), "created_at").alias("r")
        return self.stored("categories").groupBy(F.col("category_id").alias("cat_id")).agg(newest).select("cat_id", "r.cat", "r.up_id")


SQL_VIEWS = """area AS (SELECT n_nationkey AS area_id, n_name AS country, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey),
cust AS (SELECT c_custkey AS cust_id, c_name AS cust, country, region, c_mktsegment AS segment, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS credit,
  c_custkey % 7 <> 0 AS active, DATE '1994-01-01' + CAST(c_custkey % 365 AS INTEGER) AS signup FROM customer JOIN area ON c_nationkey = area_id),
ord AS (SELECT o_orderkey AS ord_id, o_custkey AS cust_id, o_orderstatus AS status, o_totalprice AS total, o_orderdate AS placed, o_orderpriority AS priority,
  CASE WHEN o_orderpriority <> '5-LOW' THEN o_custkey % 50 END AS rep_id, CAST(o_orderdate AS DATE) + 60 AS due, CAST(o_orderkey % 40 + 5 AS DOUBLE) AS freight FROM orders),
item AS (SELECT l_orderkey AS ord_id, l_partkey AS part_id, l_suppkey AS sup_id, l_linenumber AS line, CAST(l_quantity AS BIGINT) AS qty, l_extendedprice AS price,
  l_discount AS disc, l_extendedprice * (1 - l_discount) AS rev FROM lineitem),
prod AS (SELECT p_partkey AS part_id, p_name AS part, p_brand AS brand, p_type AS kind, p_size AS size, p_retailprice AS list_price FROM part),
emp AS (SELECT s_suppkey AS emp_id, s_name AS emp, s_nationkey AS dept_id, s_acctbal AS salary, CASE WHEN s_suppkey > 0 THEN (s_suppkey - 1) // 4 END AS boss_id,
  DATE '1990-01-01' + CAST(s_suppkey * 37 % 3000 AS INTEGER) AS hired, 'grade ' || CAST(s_suppkey % 4 AS VARCHAR) AS title, s_suppkey % 9 <> 0 AS active FROM supplier),
dept AS (SELECT area_id AS dept_id, country AS dept, region AS site FROM area),
wh AS (SELECT s_suppkey AS wh_id, s_name AS wh, country, region, CAST(s_suppkey * 100 + 20000 AS BIGINT) AS capacity, s_suppkey % 5 <> 0 AS active FROM supplier JOIN area ON s_nationkey = area_id),
pay AS (SELECT l_orderkey AS ord_id, l_linenumber AS line, l_extendedprice * (1 - l_discount) AS amount, l_shipdate AS paid, l_returnflag AS method, l_linestatus AS status FROM lineitem),
ship AS (SELECT l_orderkey AS ord_id, l_partkey AS part_id, l_linenumber AS line, l_suppkey AS wh_id, l_shipdate AS sent,
  CASE WHEN l_linestatus = 'F' THEN l_shipdate + to_days(l_linenumber) END AS arrived, nullif(l_returnflag, 'N') AS carrier, l_linestatus AS status FROM lineitem),
inv AS (SELECT h.part_id, wh_id, on_hand, CAST(p_size * 2 AS BIGINT) AS reorder FROM
  (SELECT l_partkey AS part_id, l_suppkey AS wh_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS on_hand FROM lineitem GROUP BY 1, 2) h JOIN part ON p_partkey = h.part_id),
goods AS (SELECT DISTINCT product_id AS good_id, product_name AS good, category_id AS cat_id, supplier_id AS vend_id, CAST(unit_price AS DOUBLE) AS price, CAST(unit_cost AS DOUBLE) AS cost,
  CAST(weight_kg AS DOUBLE) AS weight, is_discontinued AS gone FROM products),
vend AS (SELECT supplier_id AS vend_id, supplier_name AS vend, country, CAST(rating AS DOUBLE) AS rating, is_active AS active FROM suppliers),
cat AS (SELECT DISTINCT c.category_id AS cat_id, c.category_name AS cat, c.parent_category_id AS up_id FROM categories c
  JOIN (SELECT category_id, max(created_at) AS at FROM categories GROUP BY 1) n ON n.category_id = c.category_id AND n.at = c.created_at)"""


def _literal(value: object) -> str:
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


@dataclass(frozen=True)
class Template:
    """A question with slots: its plan, its SQL for comparison, and the values the slots have by default."""

    name: str
    build: Callable[..., DataFrame]
    sql: str
    slots: dict[str, object] = field(default_factory=dict)

    def run(self, mart: Mart, **slots: object) -> DataFrame:
        return self.build(mart, **(self.slots | slots))

    def query(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.run(Mart(spark, sf_dir))

    def oracle(self, **slots: object) -> str:
        text = self.sql.format(**{k: _literal(v) for k, v in (self.slots | slots).items()})
        return f"WITH {SQL_VIEWS}\nSELECT * FROM ({text}) answer"


def exact_sum(expression: str) -> str:
    """SQL of ``semantics.total``."""
    return f"CAST(sum(CAST({expression} AS DECIMAL(18,4))) AS DOUBLE)"


def exact_mean(expression: str) -> str:
    """SQL of ``semantics.mean``."""
    return f"{exact_sum(expression)} / count({expression})"


def days_mean(start: str, end: str) -> str:
    """SQL of ``semantics.mean_days``."""
    us = f"date_diff('microsecond', {start}, {end})"
    return f"CAST(sum({us}) AS DOUBLE) / 86400000000.0 / count({us})"
