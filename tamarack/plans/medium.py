"""Templates that group and aggregate one table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamarack.functions.semantics import in_year, mean, month_of, total, year_of
from tamarack.plans.mart import Template, exact_mean, exact_sum

C = F.col
#: name of an aggregate: (its column of a value column, its SQL of one)
_AGG: dict[str, tuple] = {
    "n": (lambda v: F.count("*"), lambda v: "count(*)"),
    "sum": (lambda v: total(C(v)), exact_sum),
    "avg": (lambda v: mean(C(v)), exact_mean),
    "min": (lambda v: F.min(v), lambda v: f"min({v})"),
    "max": (lambda v: F.max(v), lambda v: f"max({v})"),
    "units": (lambda v: F.sum(v), lambda v: f"CAST(sum({v}) AS BIGINT)"),
}


def _columns(aggs: dict[str, str]) -> tuple[Callable[[], list[Column]], str]:
    """{alias: "agg value"} as columns, made when a session is there, and as SQL."""
    parts = [(alias, *text.partition(" ")[::2]) for alias, text in aggs.items()]
    sql = ", ".join(f"{_AGG[kind][1](value)} AS {alias}" for alias, kind, value in parts)
    return lambda: [_AGG[kind][0](value).alias(alias) for alias, kind, value in parts], sql


def _all(name: str, view: str, **aggs: str) -> Template:
    cols, sql = _columns(aggs)
    return Template(name, lambda m: getattr(m, view).agg(*cols()), f"SELECT {sql} FROM {view}")


def _by(name: str, view: str, key: str, **aggs: str) -> Template:
    cols, sql = _columns(aggs)
    return Template(name, lambda m: getattr(m, view).groupBy(key).agg(*cols()), f"SELECT {key}, {sql} FROM {view} GROUP BY {key}")


def _by_year(name: str, view: str, moment: str, **aggs: str) -> Template:
    cols, sql = _columns(aggs)
    return Template(name, lambda m: getattr(m, view).where(C(moment).isNotNull()).groupBy(year_of(C(moment)).alias("year")).agg(*cols()), f"SELECT extract(year FROM {moment}) AS year, {sql} FROM {view} WHERE {moment} IS NOT NULL GROUP BY 1")


def _in_year(name: str, view: str, moment: str, year: int, **aggs: str) -> Template:
    cols, sql = _columns(aggs)
    return Template(name, lambda m, year: getattr(m, view).where(in_year(C(moment), year)).agg(*cols()), f"SELECT {sql} FROM {view} WHERE extract(year FROM {moment}) = {{year}}", {"year": year})


def _having(name: str, view: str, key: str, alias: str, agg: str, least: float) -> Template:
    cols, sql = _columns({alias: agg})
    return Template(name, lambda m, least: getattr(m, view).groupBy(key).agg(*cols()).where(C(alias) > least), f"SELECT {key}, {sql} FROM {view} GROUP BY {key} HAVING {sql.rpartition(' AS ')[0]} > {{least}}", {"least": least})


TEMPLATES = [
    Template("m01_count_of_country", lambda m, value: m.cust.where(C("country") == value).agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM cust WHERE country = {value}", {"value": "NATION_3"}),
    _by("m02_customers_by_country", "cust", "country", n="n"),
    _by("m03_customers_by_segment", "cust", "segment", n="n"),
    _by("m04_orders_by_status", "ord", "status", n="n"),
    _by("m05_value_by_status", "ord", "status", value="sum total"),
    _all("m06_mean_order_value", "ord", mean_value="avg total"),
    _all("m07_orders_in_all", "ord", n="n", value="sum total", mean_value="avg total"),
    _by_year("m08_value_by_year", "ord", "placed", value="sum total"),
    Template("m09_orders_by_month", lambda m, year: m.ord.where(in_year(C("placed"), year)).groupBy(month_of(C("placed")).alias("month")).agg(F.count("*").alias("n")), "SELECT CAST(date_trunc('month', placed) AS TIMESTAMP) AS month, count(*) AS n FROM ord WHERE extract(year FROM placed) = {year} GROUP BY 1", {"year": 1997}),
    _having("m10_countries_above_customers", "cust", "country", "n", "n", 62),
    _having("m11_customers_above_spend", "ord", "cust_id", "spent", "sum total", 4000000),
    _having("m12_customers_above_orders", "ord", "cust_id", "n", "n", 15),
    _by("m13_goods_by_category", "goods", "cat_id", n="n"),
    _by("m14_mean_price_by_category", "goods", "cat_id", mean_price="avg price"),
    _all("m15_price_range", "goods", lowest="min price", highest="max price", mean_price="avg price"),
    _by("m16_pay_by_department", "emp", "dept_id", pay="sum salary"),
    _by("m17_mean_pay_by_grade", "emp", "title", mean_pay="avg salary"),
    _by("m18_staff_by_department", "emp", "dept_id", n="n"),
    _by("m19_paid_by_method", "pay", "method", paid_amount="sum amount"),
    _by("m20_payments_by_status", "pay", "status", n="n"),
    _by("m21_shipments_by_carrier", "ship", "carrier", n="n"),
    _by("m22_stock_by_warehouse", "inv", "wh_id", units="units on_hand"),
    _having("m23_parts_above_units", "item", "part_id", "units", "units qty", 1000),
    _by("m24_mean_rating_by_country", "vend", "country", mean_rating="avg rating"),
    _in_year("m25_orders_in_year", "ord", "placed", 1999, n="n"),
    _by("m26_mean_credit_by_segment", "cust", "segment", mean_credit="avg credit"),
    _in_year("m27_payments_in_year", "pay", "paid", 1996, n="n"),
    _by_year("m28_paid_by_year", "pay", "paid", paid_amount="sum amount"),
    _by("m29_mean_payment_by_method", "pay", "method", mean_amount="avg amount"),
    _having("m30_methods_above_uses", "pay", "method", "n", "n", 1000),
    _by_year("m31_shipments_by_year", "ship", "sent", n="n"),
    _having("m32_parts_above_stock", "inv", "part_id", "units", "units on_hand", 1000),
    _by("m33_mean_capacity_by_country", "wh", "country", mean_capacity="avg capacity"),
    _by("m34_staff_by_activity", "emp", "active", n="n"),
    _having("m35_departments_above_mean_pay", "emp", "dept_id", "mean_pay", "avg salary", 5000),
    _by_year("m36_hired_by_year", "emp", "hired", n="n"),
    _by("m37_vendors_by_country", "vend", "country", n="n"),
    _by_year("m38_freight_by_year", "ord", "placed", freight_total="sum freight"),
    _having("m39_orders_above_lines", "item", "ord_id", "lines", "n", 8),
    _by("m40_mean_value_by_status", "ord", "status", mean_value="avg total"),
    _in_year("m41_mean_value_in_year", "ord", "placed", 2000, mean_value="avg total"),
    _by("m42_mean_discount_by_part", "item", "part_id", mean_discount="avg disc"),
]
