"""Templates that filter, sort and limit one table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tamarack.functions.semantics import ascending, descending, in_year
from tamarack.plans.mart import Template

C = F.col


def _eq(name: str, view: str, column: str, value: object) -> Template:
    return Template(name, lambda m, value: getattr(m, view).where(C(column) == value), f"SELECT * FROM {view} WHERE {column} = {{value}}", {"value": value})


def _above(name: str, view: str, column: str, value: object) -> Template:
    return Template(name, lambda m, value: getattr(m, view).where(C(column) > value), f"SELECT * FROM {view} WHERE {column} > {{value}}", {"value": value})


def _below(name: str, view: str, column: str, value: object) -> Template:
    return Template(name, lambda m, value: getattr(m, view).where(C(column) < value), f"SELECT * FROM {view} WHERE {column} < {{value}}", {"value": value})


def _flag(name: str, view: str, column: str, wanted: bool) -> Template:
    return Template(name, lambda m: getattr(m, view).where(C(column) if wanted else ~C(column)), f"SELECT * FROM {view} WHERE {'' if wanted else 'NOT '}{column}")


def _top(name: str, view: str, column: str, key: str, n: int, down: bool = True) -> Template:
    """The first n by a column; equal values by key, so that the answer is one."""
    order = descending if down else ascending
    return Template(name, lambda m, n: getattr(m, view).orderBy(order(column), C(key)).limit(n), f"SELECT * FROM {view} ORDER BY {column} {'DESC NULLS FIRST' if down else 'ASC NULLS LAST'}, {key} LIMIT {{n}}", {"n": n})


def _year(name: str, view: str, column: str, year: int) -> Template:
    return Template(name, lambda m, year: getattr(m, view).where(in_year(C(column), year)), f"SELECT * FROM {view} WHERE extract(year FROM {column}) = {{year}}", {"year": year})


def _after_year(name: str, view: str, column: str, year: int) -> Template:
    first = lambda year: F.lit(dt.date(year + 1, 1, 1))
    return Template(name, lambda m, year: getattr(m, view).where(C(column) >= first(year)).orderBy(ascending(column)), f"SELECT * FROM {view} WHERE extract(year FROM {column}) > {{year}}", {"year": year})


TEMPLATES = [
    _eq("e01_customers_of_country", "cust", "country", "NATION_3"),
    _eq("e02_customers_of_region", "cust", "region", "ASIA"),
    _eq("e03_customers_of_segment", "cust", "segment", "BUILDING"),
    _flag("e04_inactive_customers", "cust", "active", False),
    _top("e05_latest_signups", "cust", "signup", "cust_id", 15),
    _above("e06_goods_above_price", "goods", "price", 200.0),
    _below("e07_goods_below_price", "goods", "price", 50.0),
    _flag("e08_discontinued_goods", "goods", "gone", True),
    _top("e09_dearest_goods", "goods", "price", "good_id", 10),
    _top("e10_cheapest_goods", "goods", "price", "good_id", 10, down=False),
    _above("e11_goods_above_weight", "goods", "weight", 20.0),
    _eq("e12_orders_of_status", "ord", "status", "P"),
    _year("e13_orders_of_year", "ord", "placed", 1998),
    _above("e14_orders_above_total", "ord", "total", 450000.0),
    _top("e15_largest_orders", "ord", "total", "ord_id", 20),
    _eq("e16_staff_of_grade", "emp", "title", "grade 2"),
    _top("e17_best_paid_staff", "emp", "salary", "emp_id", 10),
    _above("e18_staff_above_salary", "emp", "salary", 5000.0),
    Template("e19_vendors_of_first_country", lambda m: m.vend.join(F.broadcast(m.vend.agg(F.min("country").alias("country"))), "country"), "SELECT * FROM vend WHERE country = (SELECT min(country) FROM vend)"),
    _flag("e20_active_warehouses", "wh", "active", True),
    _eq("e21_payments_by_method", "pay", "method", "A"),
    _eq("e22_shipments_of_carrier", "ship", "carrier", "R"),
    _eq("e23_shipments_of_status", "ship", "status", "O"),
    _after_year("e24_signups_after_year", "cust", "signup", 1993),
    _above("e25_payments_above_amount", "pay", "amount", 90000.0),
    _year("e26_payments_of_year", "pay", "paid", 1997),
    _eq("e27_payments_of_status", "pay", "status", "F"),
    _year("e28_shipments_of_year", "ship", "sent", 1999),
    _after_year("e29_hired_after_year", "emp", "hired", 1995),
    _flag("e30_staff_who_left", "emp", "active", False),
    _eq("e31_warehouses_of_country", "wh", "country", "NATION_7"),
    Template("e32_vendors_above_rating", lambda m, rating: m.vend.where(C("rating") > rating).orderBy(descending("rating")), "SELECT * FROM vend WHERE rating > {rating}", {"rating": 4.0}),
    Template("e33_stock_below_quantity", lambda m, value: m.inv.where(C("on_hand") < value).join(m.prod.select("part_id", (C("size") * 2).cast("bigint").alias("reorder")), "part_id"), "SELECT * FROM inv WHERE on_hand < {value}", {"value": 10}),
    Template("e34_orders_above_freight", lambda m, freight: m.ord.where(C("freight") > freight).orderBy(descending("freight"), "ord_id"), "SELECT * FROM ord WHERE freight > {freight}", {"freight": 40.0}),
]
