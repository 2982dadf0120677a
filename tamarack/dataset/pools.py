"""Value pools for the slots of templates, taken from what the sales mart holds.

Pools of limits shape a query and are fixed; years, names and thresholds come from the
data, so that no question asks for what is not there and every threshold parts the rows.
Each numeric pool belongs to one quantity: a threshold for a customer's spend never
serves for an order's total.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.dataset.expand import calendar_pool, categorical_pool, discrete_pool, quantile_pool
from tamarack.functions.semantics import AS_OF, as_of, mean, total
from tamarack.plans.mart import Mart, exact_mean, exact_sum
from tamarack.storage import materialize

#: Limits and parts of the year; they cannot make a result empty.
STRUCTURAL: dict[str, list[int]] = {"limit": [3, 5, 8, 10, 12, 15, 20, 25, 30, 50, 100], "small_limit": [2, 3, 4, 5], "month": list(range(1, 13)), "quarter": [1, 2, 3, 4]}

#: Years, and whether only those before the latest serve.
CALENDAR: dict[str, tuple[Callable[[Mart], DataFrame], str, bool]] = {
    "order_year": (lambda m: m.ord, "placed", False),
    "signup_year": (lambda m: m.cust, "signup", True),
    "hire_year": (lambda m: m.emp, "hired", True),
}

_Frame = Callable[[Mart], DataFrame]
#: Names that occur: view and column.
CATEGORICAL: dict[str, tuple[_Frame, str, str]] = {
    "country": (lambda m: m.cust, "country", "cust"),
    "region": (lambda m: m.cust, "region", "cust"),
    "segment": (lambda m: m.cust, "segment", "cust"),
    "order_status": (lambda m: m.ord, "status", "ord"),
    "priority": (lambda m: m.ord, "priority", "ord"),
    "brand": (lambda m: m.prod, "brand", "prod"),
    "kind": (lambda m: m.prod, "kind", "prod"),
    "supplier_country": (lambda m: m.vend, "country", "vend"),
    "warehouse": (lambda m: m.wh, "wh", "wh"),
    "warehouse_country": (lambda m: m.wh, "country", "wh"),
    "department": (lambda m: m.dept, "dept", "dept"),
    "job_title": (lambda m: m.emp, "title", "emp"),
    "carrier": (lambda m: m.ship, "carrier", "ship"),
    "shipment_status": (lambda m: m.ship, "status", "ship"),
    "payment_method": (lambda m: m.pay, "method", "pay"),
    "payment_status": (lambda m: m.pay, "status", "pay"),
}


@dataclass(frozen=True)
class Quantity:
    """What a threshold is compared with: its rows and value as a plan and as SQL giving a column x."""

    rows: _Frame
    value: Column | str
    sql: str
    digits: int = 0
    discrete: bool = False


def _per(view: str, by: str, what: Callable[[], Column]) -> _Frame:
    return lambda m: getattr(m, view).groupBy(by).agg(what().alias("x"))


def _once(name: str, build: _Frame) -> _Frame:
    """A frame that several quantities read: written once a mart."""

    def kept(m: Mart) -> DataFrame:
        tables = m.__dict__.setdefault("_pool_tables", {})
        if name not in tables:
            tables[name] = materialize(build(m))
        return tables[name]

    return kept


_CUSTOMERS_ORDERS = _once("customers_orders", lambda m: m.ord.groupBy("cust_id").agg(total(F.col("total")).alias("spend"), F.count("*").alias("orders"), F.max("placed").alias("last")))
_STOCK = _once("stock", lambda m: m.inv.select("part_id", "on_hand"))
_PARTS_STOCK = _once("parts_stock", lambda m: _STOCK(m).groupBy("part_id").agg(F.sum("on_hand").alias("units"), F.count("*").alias("warehouses")))


def _since(view: _Frame, days: float) -> _Frame:
    """Time up to the day the data stand for, the same that the templates count from."""
    return lambda m: view(m).select((F.timestamp_diff("MICROSECOND", F.col("last"), as_of()) / F.lit(86_400_000_000.0 * days)).alias("x"))


_SPAN = "date_diff('microsecond', {}, TIMESTAMP '" + AS_OF.isoformat(" ") + "') / {}::DOUBLE AS x"

NUMERIC: dict[str, Quantity] = {
    "product_price": Quantity(lambda m: m.goods, "price", "SELECT price AS x FROM goods"),
    "category_mean_price": Quantity(_per("goods", "cat_id", lambda: mean(F.col("price"))), "x", f"SELECT {exact_mean('price')} AS x FROM goods GROUP BY cat_id"),
    "product_weight": Quantity(lambda m: m.goods, "weight", "SELECT weight AS x FROM goods", 1),
    "supplier_rating": Quantity(lambda m: m.vend, "rating", "SELECT rating AS x FROM vend", 1),
    "order_total": Quantity(lambda m: m.ord, "total", "SELECT total AS x FROM ord"),
    "order_freight": Quantity(lambda m: m.ord, "freight", "SELECT freight AS x FROM ord"),
    "customer_spend": Quantity(_CUSTOMERS_ORDERS, "spend", f"SELECT {exact_sum('total')} AS x FROM ord GROUP BY cust_id"),
    "customer_orders": Quantity(_CUSTOMERS_ORDERS, "orders", "SELECT count(*) AS x FROM ord GROUP BY cust_id", discrete=True),
    "customer_brands": Quantity(
        lambda m: m.item.join(m.prod.select("part_id", "brand"), "part_id").select("ord_id", "brand").distinct().join(m.ord.select("ord_id", "cust_id"), "ord_id").groupBy("cust_id").agg(F.countDistinct("brand").alias("x")),
        "x",
        "SELECT count(DISTINCT brand) AS x FROM ord JOIN item USING (ord_id) JOIN prod USING (part_id) GROUP BY cust_id",
        discrete=True,
    ),
    "country_customers": Quantity(_per("cust", "country", lambda: F.count("*")), "x", "SELECT count(*) AS x FROM cust GROUP BY country", discrete=True),
    "order_lines": Quantity(_per("item", "ord_id", lambda: F.count("*")), "x", "SELECT count(*) AS x FROM item GROUP BY ord_id", discrete=True),
    "part_units": Quantity(_per("item", "part_id", lambda: F.sum("qty")), "x", "SELECT sum(qty) AS x FROM item GROUP BY part_id"),
    "customer_credit": Quantity(lambda m: m.cust, "credit", "SELECT credit AS x FROM cust"),
    "salary": Quantity(lambda m: m.emp, "salary", "SELECT salary AS x FROM emp"),
    "department_mean_salary": Quantity(_per("emp", "dept_id", lambda: mean(F.col("salary"))), "x", f"SELECT {exact_mean('salary')} AS x FROM emp GROUP BY dept_id"),
    "payment_amount": Quantity(lambda m: m.pay, "amount", "SELECT amount AS x FROM pay"),
    "payment_uses": Quantity(_per("pay", "method", lambda: F.count("*")), "x", "SELECT count(*) AS x FROM pay GROUP BY method", discrete=True),
    "stock": Quantity(_STOCK, "on_hand", "SELECT on_hand AS x FROM inv"),
    "part_stock": Quantity(_PARTS_STOCK, "units", "SELECT sum(on_hand) AS x FROM inv GROUP BY part_id"),
    "part_warehouses": Quantity(_PARTS_STOCK, "warehouses", "SELECT count(*) AS x FROM inv GROUP BY part_id", discrete=True),
    "pending_days": Quantity(_since(lambda m: m.ord.where("status = 'P'").select(F.col("placed").alias("last")), 1.0), "x", f"SELECT {_SPAN.format('placed', 86_400_000_000.0)} FROM ord WHERE status = 'P'"),
    "months_since_order": Quantity(_since(_CUSTOMERS_ORDERS, 30.0), "x", f"SELECT {_SPAN.format('max(placed)', 2_592_000_000_000.0)} FROM ord GROUP BY cust_id"),
    "months_since_order_inactive": Quantity(
        _since(lambda m: _CUSTOMERS_ORDERS(m).join(m.cust.where("not active").select("cust_id"), "cust_id", "left_semi"), 30.0),
        "x",
        f"SELECT {_SPAN.format('max(placed)', 2_592_000_000_000.0)} FROM ord WHERE cust_id IN (SELECT cust_id FROM cust WHERE NOT active) GROUP BY cust_id",
    ),
}


def pool(mart: Mart, name: str) -> DataFrame:
    """(value string) of one pool."""
    if name in STRUCTURAL:
        values = mart.spark.createDataFrame([(v,) for v in STRUCTURAL[name]], "value bigint")
    elif name in CALENDAR:
        frame, column, before_last = CALENDAR[name]
        values = calendar_pool(frame(mart), column, before_last)
    elif name in CATEGORICAL:
        frame, column, _ = CATEGORICAL[name]
        values = categorical_pool(frame(mart), column)
    elif name in NUMERIC:
        q = NUMERIC[name]
        column = F.col(q.value) if isinstance(q.value, str) else q.value
        values = discrete_pool(q.rows(mart), column) if q.discrete else quantile_pool(q.rows(mart), column, q.digits)
        values = values.select(F.col("value").cast("bigint") if q.discrete or not q.digits else F.col("value").cast("decimal(18,1)").alias("value"))
    else:
        raise KeyError(f"no pool for the slot {name}")
    return values.select(F.col("value").cast("string").alias("value"))


def _all(mart: Mart, names: list[str], alone: bool = False) -> DataFrame:
    """The pools in one table; ``alone`` makes each in a query of its own, one after the other, since the driver holds all stages of a query at once."""
    out = None
    for n in names:
        one = pool(mart, n).select(F.lit(n).alias("pool"), "value")
        one = materialize(one) if alone else one
        out = one if out is None else out.unionByName(one)
    return out


def named_pools(mart: Mart) -> DataFrame:
    """(pool, value) of all fixed, calendar and categorical pools."""
    return _all(mart, [*STRUCTURAL, *CALENDAR, *CATEGORICAL])


def numeric_pools(mart: Mart) -> DataFrame:
    """(pool, value) of all thresholds."""
    return _all(mart, list(NUMERIC), alone=True)


def named_pools_sql() -> str:
    fixed = " UNION ALL ".join(f"SELECT '{n}' AS pool, CAST(unnest({v}) AS VARCHAR) AS value" for n, v in STRUCTURAL.items())
    views = {"order_year": "ord", "signup_year": "cust", "hire_year": "emp"}
    years = " UNION ALL ".join(f"SELECT DISTINCT '{n}', CAST(extract(year FROM {c}) AS VARCHAR) FROM {views[n]}" + (f" WHERE extract(year FROM {c}) < (SELECT max(extract(year FROM {c})) FROM {views[n]})" if before else "") for n, (_, c, before) in CALENDAR.items())
    names = " UNION ALL ".join(f"SELECT DISTINCT '{n}', CAST({c} AS VARCHAR) FROM {view} WHERE {c} IS NOT NULL" for n, (_, c, view) in CATEGORICAL.items())
    return f"{fixed} UNION ALL {years} UNION ALL {names}"


def numeric_pools_sql() -> str:
    parts = []
    for n, q in NUMERIC.items():
        if q.discrete:
            parts.append(f"SELECT DISTINCT '{n}' AS pool, CAST(x AS BIGINT)::VARCHAR AS value FROM ({q.sql}) WHERE x < (SELECT max(x) FROM ({q.sql}))")
        else:
            kind = "DECIMAL(18,1)" if q.digits else "BIGINT"
            at = "[0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]"
            parts.append(f"SELECT DISTINCT '{n}' AS pool, CAST(round(v, {q.digits}) AS {kind})::VARCHAR AS value FROM (SELECT unnest(quantile_cont(CAST(x AS DOUBLE), {at})) AS v, min(x) AS lo, max(x) AS hi FROM ({q.sql})) WHERE round(v, {q.digits}) > lo AND round(v, {q.digits}) < hi")
    return " UNION ALL ".join(parts)
