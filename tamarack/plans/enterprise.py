"""Templates around missing values, conditional figures and several domains at once."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tamarack.functions.semantics import as_of, mean, mean_days, percent, total, year_of
from tamarack.operators.ranking import latest_of_each
from tamarack.plans.mart import Template, days_mean, exact_mean, exact_sum

C = F.col
T = Template
_VALUE = exact_sum("total")
_AS_OF = "TIMESTAMP '2001-09-01'"
_LATE = "CAST(arrived AS DATE) > due"


def _late(m):
    return m.ship.join(m.ord.select("ord_id", "cust_id", "due"), "ord_id").withColumn("late", F.to_date("arrived") > C("due"))


def _top(frame, by: list[str], order: list, n: int):
    return frame.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(C("place") <= n).withColumn("place", C("place").cast("bigint"))


TEMPLATES = [
    T("x01_value_without_pending", lambda m: m.ord.where(~C("status").isin("P")).agg(total(C("total")).alias("value")), f"SELECT {_VALUE} AS value FROM ord WHERE status NOT IN ('P')"),
    T("x02_orders_without_representative", lambda m: m.ord.where(C("rep_id").isNull()), "SELECT * FROM ord WHERE rep_id IS NULL"),
    T("x03_value_by_channel", lambda m: m.ord.groupBy(F.when(C("rep_id").isNull(), "direct").otherwise("assisted").alias("channel")).agg(F.count("*").alias("n"), total(C("total")).alias("value")), f"SELECT CASE WHEN rep_id IS NULL THEN 'direct' ELSE 'assisted' END AS channel, count(*) AS n, {_VALUE} AS value FROM ord GROUP BY 1"),
    T("x04_goods_without_vendor", lambda m: m.goods.where(C("vend_id").isNull()), "SELECT * FROM goods WHERE vend_id IS NULL"),
    T("x05_vendors_without_rating", lambda m: m.vend.where(C("rating").isNull()), "SELECT * FROM vend WHERE rating IS NULL"),
    T("x06_low_credit_of_segment", lambda m, segment, limit: m.cust.where((C("segment") == segment) & C("credit").isNotNull() & (C("credit") < limit)).orderBy("credit"), "SELECT * FROM cust WHERE segment = {segment} AND credit IS NOT NULL AND credit < {limit}", {"segment": "MACHINERY", "limit": 1500.0}),
    T("x07_sent_but_not_arrived", lambda m: m.ship.where(C("sent").isNotNull() & C("arrived").isNull()).orderBy("sent"), "SELECT * FROM ship WHERE sent IS NOT NULL AND arrived IS NULL"),
    T("x08_stock_below_reorder", lambda m: m.inv_part.where("on_hand < reorder").join(m.wh.select("wh_id", "wh"), "wh_id").select("part_id", "part", "wh", "on_hand", "reorder"), "SELECT part_id, part, wh, on_hand, reorder FROM inv JOIN prod USING (part_id) JOIN wh USING (wh_id) WHERE on_hand < reorder"),
    T("x09_stock_of_one_kind", lambda m, kind: m.prod.where(C("kind") == kind).join(m.inv, "part_id").groupBy("part_id", "part").agg(F.sum("on_hand").alias("units")).where("units > 0"), "SELECT part_id, part, CAST(sum(on_hand) AS BIGINT) AS units FROM prod JOIN inv USING (part_id) WHERE kind = {kind} GROUP BY 1, 2 HAVING sum(on_hand) > 0", {"kind": "PROMO"}),
    T("x10_orders_awaiting_payment", lambda m: m.ord.where("status <> 'P'").join(m.pay.where("status = 'F'"), "ord_id", "left_anti").select("ord_id", "cust_id", "total"), "SELECT ord_id, cust_id, total FROM ord WHERE status <> 'P' AND NOT EXISTS (FROM pay WHERE pay.ord_id = ord.ord_id AND pay.status = 'F')"),
    T("x11_value_by_department", lambda m: m.ord.groupBy("rep_id").agg(F.sum(C("total").cast("decimal(18,4)")).alias("v")).join(m.emp.select(C("emp_id").alias("rep_id"), "dept_id"), "rep_id").join(F.broadcast(m.dept), "dept_id").groupBy("dept").agg(F.sum("v").cast("double").alias("value")), f"SELECT dept, {_VALUE} AS value FROM ord JOIN emp ON emp_id = rep_id JOIN dept USING (dept_id) GROUP BY dept"),
    T("x12_customers_supplied_across", lambda m, country, origin: m.item.join(m.wh.where(C("country") == origin).select(C("wh_id").alias("sup_id")), "sup_id").join(m.ord, "ord_id").join(m.cust.where(C("country") == country), "cust_id").select("cust_id", "cust").distinct(), "SELECT DISTINCT cust_id, cust FROM cust c JOIN ord USING (cust_id) JOIN item USING (ord_id) JOIN prod USING (part_id) JOIN wh w ON wh_id = sup_id WHERE c.country = {country} AND w.country = {origin}", {"country": "NATION_4", "origin": "NATION_9"}),
    T("x13_margins", lambda m: m.goods.select("good_id", F.round(percent(C("price") - C("cost"), C("price")), 2).alias("margin")).where("margin is not null"), "SELECT good_id, round(100.0::DOUBLE * (price - cost) / nullif(price, 0), 2) AS margin FROM goods WHERE (price - cost) / nullif(price, 0) IS NOT NULL"),
    T("x14_no_order_for_months", lambda m, months: m.ord.groupBy("cust_id").agg(F.max("placed").alias("last")).where(C("last") < as_of() - F.make_ym_interval(F.lit(0), F.lit(months))), f"SELECT cust_id, max(placed) AS last FROM ord GROUP BY cust_id HAVING max(placed) < {_AS_OF} - to_months({{months}})", {"months": 6}),
    T("x15_room_used_in_warehouses", lambda m: m.wh.join(m.inv.groupBy("wh_id").agg(F.sum("on_hand").alias("u")), "wh_id", "left").select("wh_id", "wh", F.coalesce("u", F.lit(0)).alias("units"), percent(F.coalesce("u", F.lit(0)), C("capacity")).alias("pct")), "SELECT wh_id, wh, CAST(coalesce(sum(on_hand), 0) AS BIGINT) AS units, 100.0::DOUBLE * CAST(coalesce(sum(on_hand), 0) AS BIGINT) / nullif(CAST(capacity AS DOUBLE), 0) AS pct FROM wh LEFT JOIN inv USING (wh_id) GROUP BY wh_id, wh, capacity"),
    T("x16_best_customers", lambda m: m.ord.groupBy("cust_id").agg(F.countDistinct("ord_id").alias("n"), total(C("total")).alias("value")).orderBy(F.desc("value"), "cust_id").limit(20), f"SELECT cust_id, count(DISTINCT ord_id) AS n, {_VALUE} AS value FROM ord GROUP BY cust_id ORDER BY value DESC, cust_id LIMIT 20"),
    T("x17_this_year_and_last", lambda m: m.ord.where(C("placed") >= F.date_trunc("year", as_of()).cast("timestamp_ntz") - F.expr("INTERVAL 1 YEAR")).groupBy(year_of(C("placed")).alias("year")).agg(F.count("*").alias("n"), total(C("total")).alias("value")), f"SELECT extract(year FROM placed) AS year, count(*) AS n, {_VALUE} AS value FROM ord WHERE placed >= date_trunc('year', {_AS_OF}) - INTERVAL 1 YEAR GROUP BY 1"),
    T("x18_representatives_of_pending", lambda m: m.ord.where("status = 'P'").groupBy(C("rep_id").alias("emp_id")).agg(F.count("*").alias("n")).join(m.emp.select("emp_id", "emp"), "emp_id"), "SELECT emp_id, emp, count(*) AS n FROM ord JOIN emp ON emp_id = rep_id WHERE status = 'P' GROUP BY 1, 2"),
    T("x19_share_collected", lambda m: m.ord.join(m.pay.where("status = 'F'").groupBy("ord_id").agg(F.sum(C("amount").cast("decimal(18,4)")).alias("paid")), "ord_id", "left").agg(percent(F.sum(F.coalesce("paid", F.lit(0))).cast("double"), total(C("total"))).alias("pct")), f"SELECT 100.0::DOUBLE * CAST(sum(coalesce(paid, 0)) AS DOUBLE) / nullif({_VALUE}, 0) AS pct FROM ord LEFT JOIN (SELECT ord_id, sum(CAST(amount AS DECIMAL(18,4))) AS paid FROM pay WHERE status = 'F' GROUP BY ord_id) USING (ord_id)"),
    T("x20_late_by_carrier", lambda m: _late(m).groupBy("carrier").agg(F.count_if("late").alias("late"), F.count("*").alias("n")), f"SELECT carrier, count(*) FILTER ({_LATE}) AS late, count(*) AS n FROM ship JOIN ord USING (ord_id) GROUP BY carrier"),
    T("x21_paid_but_not_lately_sent", lambda m, since: m.ord.join(m.pay.where("status = 'F'"), "ord_id", "left_semi").join(m.ship.where(C("sent") >= F.lit(since).cast("timestamp_ntz")), "ord_id", "left_anti").select("ord_id"), "SELECT ord_id FROM ord WHERE EXISTS (FROM pay WHERE pay.ord_id = ord.ord_id AND pay.status = 'F') AND NOT EXISTS (FROM ship WHERE ship.ord_id = ord.ord_id AND sent >= CAST({since} AS TIMESTAMP))", {"since": "1999-01-01"}),
    T("x22_staff_without_orders", lambda m: m.emp.join(m.ord.select(C("rep_id").alias("emp_id")), "emp_id", "left_anti").select("emp_id", "emp"), "SELECT emp_id, emp FROM emp LEFT JOIN ord ON rep_id = emp_id WHERE rep_id IS NULL"),
    T("x23_warehouses_without_large_stock", lambda m, units: m.wh.join(m.inv.where(C("on_hand") > units), "wh_id", "left_anti").select("wh_id", "wh"), "SELECT w.wh_id, w.wh FROM wh w LEFT JOIN (SELECT wh_id FROM inv WHERE on_hand > {units}) i ON i.wh_id = w.wh_id WHERE i.wh_id IS NULL", {"units": 150}),
    T("x24_pending_above_credit", lambda m: m.ord.where("status = 'P'").groupBy("cust_id").agg(total(C("total")).alias("open")).join(m.cust.select("cust_id", "cust", "credit"), "cust_id").where("open > credit"), f"SELECT cust_id, cust, credit, {_VALUE} AS open FROM cust JOIN ord USING (cust_id) WHERE status = 'P' GROUP BY 1, 2, 3 HAVING {_VALUE} > credit"),
    T("x25_goods_of_poorly_rated_vendors", lambda m, rating: m.goods.where(~C("gone")).join(F.broadcast(m.vend.where(C("rating").isNotNull() & (C("rating") < rating)).select("vend_id", "rating")), "vend_id").select("good_id", "good", "rating").orderBy("rating"), "SELECT good_id, good, rating FROM goods JOIN vend USING (vend_id) WHERE NOT gone AND rating IS NOT NULL AND rating < {rating}", {"rating": 3.5}),
    T("x26_sold_at_or_below_cost", lambda m, factor: m.goods.where(C("cost").isNotNull() & (C("price") <= C("cost") * factor)), "SELECT * FROM goods WHERE cost IS NOT NULL AND price <= cost * {factor}", {"factor": 1.5}),
    T("x27_returned_by_method", lambda m: m.pay.where("method = 'R'").groupBy("status").agg(F.count("*").alias("n"), total(C("amount")).alias("amount")), f"SELECT status, count(*) AS n, {exact_sum('amount')} AS amount FROM pay WHERE method = 'R' GROUP BY status"),
    T("x28_late_by_country", lambda m: _late(m).where("late").groupBy("cust_id").agg(F.count("*").alias("k")).join(m.cust.select("cust_id", "country"), "cust_id").groupBy("country").agg(F.sum("k").alias("n")), f"SELECT country, count(*) AS n FROM ship JOIN ord USING (ord_id) JOIN cust USING (cust_id) WHERE {_LATE} GROUP BY country"),
    T("x29_pending_for_days", lambda m, days: m.ord.where((C("status") == "P") & (C("placed") < as_of() - F.make_dt_interval(F.lit(days)))).select("ord_id", "placed"), f"SELECT ord_id, placed FROM ord WHERE status = 'P' AND placed < {_AS_OF} - to_days({{days}})", {"days": 900}),
    T("x30_inactive_but_ordering", lambda m, months: m.ord.where(C("placed") > as_of() - F.make_ym_interval(F.lit(0), F.lit(months))).groupBy("cust_id").agg(F.max("placed").alias("last")).join(m.cust.where(~C("active")).select("cust_id", "cust"), "cust_id"), f"SELECT cust_id, cust, max(placed) AS last FROM cust JOIN ord USING (cust_id) WHERE NOT active AND placed > {_AS_OF} - to_months({{months}}) GROUP BY 1, 2", {"months": 9}),
    T("x31_low_stock_by_brand", lambda m: m.inv_part.where("on_hand < reorder").groupBy("brand").agg(F.count("*").alias("n")), "SELECT brand, count(*) AS n FROM inv JOIN prod USING (part_id) WHERE on_hand < reorder GROUP BY brand"),
    T("x32_mean_value_per_customer", lambda m: m.ord.where(~C("status").isin("P")).groupBy("cust_id").agg(total(C("total")).alias("value")).agg(mean(C("value")).alias("mean_value")), f"SELECT {exact_mean('value')} AS mean_value FROM (SELECT {_VALUE} AS value FROM ord WHERE status NOT IN ('P') GROUP BY cust_id)"),
    T("n01_best_paid_of_each_department", lambda m, n: _top(m.emp.select("emp_id", "dept_id", "salary"), ["dept_id"], [F.desc("salary"), "emp_id"], n), "SELECT * FROM (SELECT emp_id, dept_id, salary, row_number() OVER (PARTITION BY dept_id ORDER BY salary DESC, emp_id) AS place FROM emp) WHERE place <= {n}", {"n": 2}),
    T("n02_latest_shipments_of_each_carrier", lambda m, n: latest_of_each(m.ship.select("carrier", "ord_id", "part_id", "line", "sent"), "carrier", "sent", ["ord_id", "line", "part_id"], n), "SELECT * FROM (SELECT carrier, ord_id, part_id, line, sent, row_number() OVER (PARTITION BY carrier ORDER BY sent DESC, ord_id, line, part_id) AS place FROM ship) WHERE place <= {n}", {"n": 5}),
    T("n03_largest_orders_of_each_segment", lambda m, n: _top(m.ord.join(m.cust.select("cust_id", "segment"), "cust_id").select("ord_id", "segment", "total"), ["segment"], [F.desc("total"), "ord_id"], n), "SELECT * FROM (SELECT ord_id, segment, total, row_number() OVER (PARTITION BY segment ORDER BY total DESC, ord_id) AS place FROM ord JOIN cust USING (cust_id)) WHERE place <= {n}", {"n": 4}),
    T("n04_mean_days_to_dispatch", lambda m: m.ship.join(m.ord.select("ord_id", "placed"), "ord_id").groupBy("wh_id").agg(mean_days("placed", "sent").alias("days")).join(m.wh.select("wh_id", "wh"), "wh_id"), f"SELECT wh_id, wh, {days_mean('placed', 'sent')} AS days FROM ship JOIN ord USING (ord_id) JOIN wh USING (wh_id) GROUP BY 1, 2"),
    T("n05_days_from_signup_to_first_order", lambda m: m.ord.groupBy("cust_id").agg(F.min("placed").alias("first")).join(m.cust.select("cust_id", "segment", C("signup").cast("timestamp_ntz").alias("signup_at")), "cust_id").groupBy("segment").agg(mean_days("signup_at", "first").alias("days")), f"SELECT segment, {days_mean('CAST(signup AS TIMESTAMP)', 'first')} AS days FROM cust JOIN (SELECT cust_id, min(placed) AS first FROM ord GROUP BY 1) USING (cust_id) GROUP BY segment"),
]
