"""Templates with windows, nested aggregates, percentiles, date arithmetic and recursion."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tamarack.functions.semantics import in_year, mean, mean_days, month_of, percent, total, total_where, year_of
from tamarack.operators.hierarchy import resolve_hierarchy
from tamarack.operators.ranking import exact_quantiles, place_rows
from tamarack.plans.mart import Template, days_mean, exact_mean, exact_sum

C = F.col
T = Template
_REV, _VALUE, _PAID = exact_sum("rev"), exact_sum("total"), exact_sum("amount")
_MONTH = "CAST(date_trunc('month', {}) AS TIMESTAMP)"


def _running(column: str, order: str):
    return F.sum(C(column).cast("decimal(18,4)")).over(Window.orderBy(order)).cast("double")


def _top_of_each(frame, by: str, value: str, key: str, n: int):
    window = Window.partitionBy(by).orderBy(F.desc(value), key)
    return frame.withColumn("place", F.row_number().over(window)).where(C("place") <= n).withColumn("place", C("place").cast("bigint"))


def _depths(m):
    found = resolve_hierarchy(m.emp, "emp_id", "boss_id", paths=False)
    return found.select(C("id").alias("emp_id"), C("depth"))


def _below(m, name: str):
    """Categories below one whose name contains ``name``, with the way to the nearest: read off each path, which tells the names above."""
    found = resolve_hierarchy(m.cat, "cat_id", "up_id", "cat").where("place = 'in_tree'")
    above = F.filter(F.transform("path", lambda step, i: F.when((i > 0) & step["name"].contains(name), i)), lambda i: i.isNotNull())
    return found.select(C("id").alias("cat_id"), F.array_min(above).cast("bigint").alias("distance")).where("distance is not null")


TEMPLATES = [
    T("v01_rank_customers_by_value", lambda m: m.ord.groupBy("cust_id").agg(total(C("total")).alias("value")).transform(lambda d: place_rows(d, "rank", "value", ["cust_id"])), f"SELECT cust_id, {_VALUE} AS value, rank() OVER (ORDER BY {_VALUE} DESC) AS place FROM ord GROUP BY cust_id"),
    T("v02_top_parts_of_each_brand", lambda m, n: _top_of_each(m.item.groupBy("part_id").agg(total(C("rev")).alias("revenue")).join(m.prod.select("part_id", "brand"), "part_id"), "brand", "revenue", "part_id", n), f"SELECT * FROM (SELECT part_id, brand, {_REV} AS revenue, row_number() OVER (PARTITION BY brand ORDER BY {_REV} DESC, part_id) AS place FROM item JOIN prod USING (part_id) GROUP BY 1, 2) WHERE place <= {{n}}", {"n": 3}),
    T("v03_running_value_by_month", lambda m, year: m.ord.where(in_year(C("placed"), year)).groupBy(month_of(C("placed")).alias("month")).agg(total(C("total")).alias("value")).withColumn("so_far", _running("value", "month")), f"SELECT month, value, CAST(sum(CAST(value AS DECIMAL(18,4))) OVER (ORDER BY month) AS DOUBLE) AS so_far FROM (SELECT {_MONTH.format('placed')} AS month, {_VALUE} AS value FROM ord WHERE extract(year FROM placed) = {{year}} GROUP BY 1)", {"year": 1998}),
    T("v04_change_by_month", lambda m, year: m.ord.where(in_year(C("placed"), year)).groupBy(month_of(C("placed")).alias("month")).agg(total(C("total")).alias("value")).withColumn("change", C("value") - F.lag("value").over(Window.orderBy("month"))), f"SELECT month, value, value - lag(value) OVER (ORDER BY month) AS change FROM (SELECT {_MONTH.format('placed')} AS month, {_VALUE} AS value FROM ord WHERE extract(year FROM placed) = {{year}} GROUP BY 1)", {"year": 1999}),
    T("v05_done_and_pending_by_country", lambda m: m.ord.join(m.cust.select("cust_id", "country"), "cust_id").groupBy("country").agg(F.count_if(C("status") == "F").alias("done"), F.count_if(C("status") == "P").alias("pending")), "SELECT country, count(*) FILTER (status = 'F') AS done, count(*) FILTER (status = 'P') AS pending FROM ord JOIN cust USING (cust_id) GROUP BY country"),
    T("v06_done_share_by_country", lambda m: m.ord.join(m.cust.select("cust_id", "country"), "cust_id").groupBy("country").agg(percent(F.count_if(C("status") == "F"), F.count("*")).alias("pct")), "SELECT country, 100.0::DOUBLE * count(*) FILTER (status = 'F') / nullif(CAST(count(*) AS DOUBLE), 0) AS pct FROM ord JOIN cust USING (cust_id) GROUP BY country"),
    T("v07_mean_days_to_arrival", lambda m: m.ship.where("arrived is not null").join(m.ord.select("ord_id", "placed"), "ord_id").agg(mean_days("placed", "arrived").alias("days")), f"SELECT {days_mean('placed', 'arrived')} AS days FROM ship JOIN ord USING (ord_id)"),
    T("v08_mean_days_by_carrier", lambda m: m.ship.groupBy("carrier").agg(mean_days("sent", "arrived").alias("days")), f"SELECT carrier, {days_mean('sent', 'arrived')} AS days FROM ship GROUP BY carrier"),
    T("v09_share_of_each_brand", lambda m: m.item.groupBy("part_id").agg(F.sum(C("rev").cast("decimal(18,4)")).alias("rev")).join(m.prod, "part_id").groupBy("brand").agg(F.sum("rev").cast("double").alias("revenue")).withColumn("share", C("revenue") * 100.0 / F.sum(C("revenue").cast("decimal(22,4)")).over(Window.partitionBy()).cast("double")), f"SELECT brand, revenue, revenue * 100.0::DOUBLE / CAST(sum(CAST(revenue AS DECIMAL(22,4))) OVER () AS DOUBLE) AS share FROM (SELECT brand, {_REV} AS revenue FROM item JOIN prod USING (part_id) GROUP BY brand)"),
    T("v10_categories_below", _below, "WITH RECURSIVE sub AS (SELECT cat_id, 0::BIGINT AS distance, [cat_id] AS seen FROM cat WHERE contains(cat, {name}) UNION ALL SELECT k.cat_id, s.distance + 1, list_append(s.seen, k.cat_id) FROM sub s JOIN cat k ON k.up_id = s.cat_id WHERE NOT list_contains(s.seen, k.cat_id) AND s.distance < 60), up AS (SELECT cat_id AS start, up_id, [cat_id] AS seen, FALSE AS looped FROM cat UNION ALL SELECT u.start, k.up_id, list_append(u.seen, k.cat_id), list_contains(u.seen, k.cat_id) FROM up u JOIN cat k ON k.cat_id = u.up_id WHERE NOT u.looped) SELECT cat_id, min(distance) AS distance FROM sub WHERE distance > 0 AND cat_id NOT IN (SELECT start FROM up WHERE looped) GROUP BY cat_id", {"name": "Bamboo"}),
    T("v11_depth_of_staff", _depths, "WITH RECURSIVE chart AS (SELECT emp_id, 0::BIGINT AS depth FROM emp WHERE boss_id IS NULL UNION ALL SELECT e.emp_id, c.depth + 1 FROM chart c JOIN emp e ON e.boss_id = c.emp_id) SELECT * FROM chart"),
    T("v12_mean_lines_per_order", lambda m: m.item.groupBy("ord_id").agg(F.count("*").alias("lines")).agg((F.sum("lines").cast("double") / F.count("*")).alias("mean_lines")), "SELECT CAST(sum(lines) AS DOUBLE) / count(*) AS mean_lines FROM (SELECT count(*) AS lines FROM item GROUP BY ord_id)"),
    T("v13_median_order_value", lambda m: exact_quantiles(m.ord, C("total"), [0.5]).select(F.round(C("q")[0], 4).alias("median")), "SELECT round(quantile_cont(total, 0.5), 4) AS median FROM ord"),
    T("v14_customer_quartiles", lambda m: m.ord.groupBy("cust_id").agg(total(C("total")).alias("value")).transform(lambda d: place_rows(d, "ntile", "value", ["cust_id"], tiles=4, place="quartile")), f"SELECT cust_id, value, ntile(4) OVER (ORDER BY value DESC, cust_id) AS quartile FROM (SELECT cust_id, {_VALUE} AS value FROM ord GROUP BY cust_id)"),
    T("v15_sent_after_due", lambda m: m.ship.join(m.ord.select("ord_id", "due"), "ord_id").where(F.to_date("sent") > C("due")).select("ord_id", "line", "sent", "due"), "SELECT ord_id, line, sent, due FROM ship JOIN ord USING (ord_id) WHERE CAST(sent AS DATE) > due"),
    T("v16_first_order_of_customers", lambda m: m.ord.groupBy("cust_id").agg(F.min("placed").alias("first"), F.count("*").alias("n")), "SELECT cust_id, min(placed) AS first, count(*) AS n FROM ord GROUP BY cust_id"),
    T("v17_value_by_first_year", lambda m: m.ord.groupBy("cust_id").agg(F.min("placed").alias("first"), F.sum(C("total").cast("decimal(18,4)")).alias("v")).groupBy(year_of(C("first")).alias("year")).agg(F.countDistinct("cust_id").alias("customers"), F.sum("v").cast("double").alias("value")), f"SELECT extract(year FROM first) AS year, count(DISTINCT cust_id) AS customers, {_VALUE} AS value FROM ord JOIN (SELECT cust_id, min(placed) AS first FROM ord GROUP BY 1) USING (cust_id) GROUP BY 1"),
    T("v18_value_by_segment_and_year", lambda m: m.ord.join(m.cust.select("cust_id", "segment"), "cust_id").groupBy(year_of(C("placed")).alias("year")).agg(total_where(C("segment") == "BUILDING", C("total")).alias("building"), total_where(C("segment") == "MACHINERY", C("total")).alias("machinery")), f"SELECT extract(year FROM placed) AS year, {exact_sum('CASE WHEN segment = $$BUILDING$$ THEN total END')} AS building, {exact_sum('CASE WHEN segment = $$MACHINERY$$ THEN total END')} AS machinery FROM ord JOIN cust USING (cust_id) GROUP BY 1"),
    T("v19_rank_goods_in_category", lambda m: place_rows(m.goods.select("good_id", "cat_id", "price"), "rank", "price", ["good_id"], ["cat_id"]), "SELECT good_id, cat_id, price, rank() OVER (PARTITION BY cat_id ORDER BY price DESC) AS place FROM goods"),
    T("v20_top_customers_of_each_country", lambda m, n: _top_of_each(m.ord.groupBy("cust_id").agg(total(C("total")).alias("value")).join(m.cust.select("cust_id", "country"), "cust_id"), "country", "value", "cust_id", n), f"SELECT * FROM (SELECT cust_id, country, {_VALUE} AS value, row_number() OVER (PARTITION BY country ORDER BY {_VALUE} DESC, cust_id) AS place FROM ord JOIN cust USING (cust_id) GROUP BY 1, 2) WHERE place <= {{n}}", {"n": 3}),
    T("v21_running_payments_by_month", lambda m, year: m.pay.where(in_year(C("paid"), year)).groupBy(month_of(C("paid")).alias("month")).agg(total(C("amount")).alias("amount")).withColumn("so_far", _running("amount", "month")), f"SELECT month, amount, CAST(sum(CAST(amount AS DECIMAL(18,4))) OVER (ORDER BY month) AS DOUBLE) AS so_far FROM (SELECT {_MONTH.format('paid')} AS month, {_PAID} AS amount FROM pay WHERE extract(year FROM paid) = {{year}} GROUP BY 1)", {"year": 1997}),
    T("v22_change_by_year", lambda m: m.ord.groupBy(year_of(C("placed")).alias("year")).agg(total(C("total")).alias("value")).withColumn("change", C("value") - F.lag("value").over(Window.orderBy("year"))), f"SELECT year, value, value - lag(value) OVER (ORDER BY year) AS change FROM (SELECT extract(year FROM placed) AS year, {_VALUE} AS value FROM ord GROUP BY 1)"),
    T("v23_mean_days_to_payment", lambda m: m.pay.join(m.ord.select("ord_id", "placed"), "ord_id").agg(mean_days("placed", "paid").alias("days")), f"SELECT {days_mean('placed', 'paid')} AS days FROM pay JOIN ord USING (ord_id)"),
    T("v24_dense_rank_of_pay", lambda m: place_rows(m.emp.select("emp_id", "dept_id", "salary"), "dense_rank", "salary", ["emp_id"], ["dept_id"]), "SELECT emp_id, dept_id, salary, dense_rank() OVER (PARTITION BY dept_id ORDER BY salary DESC) AS place FROM emp"),
    T("v25_median_pay_by_department", lambda m: exact_quantiles(m.emp, C("salary"), [0.5], ["dept_id"]).select("dept_id", F.round(C("q")[0], 4).alias("median")), "SELECT dept_id, round(quantile_cont(salary, 0.5), 4) AS median FROM emp GROUP BY dept_id"),
    T("v26_running_customers_by_month", lambda m: m.cust.groupBy(month_of(C("signup").cast("timestamp_ntz")).alias("month")).agg(F.count("*").alias("n")).withColumn("so_far", F.sum("n").over(Window.orderBy("month"))), f"SELECT month, n, CAST(sum(n) OVER (ORDER BY month) AS BIGINT) AS so_far FROM (SELECT {_MONTH.format('signup')} AS month, count(*) AS n FROM cust GROUP BY 1)"),
    T("v27_paid_by_method_and_year", lambda m: m.pay.groupBy(year_of(C("paid")).alias("year")).agg(*(total_where(C("method") == k, C("amount")).alias(f"paid_{k.lower()}") for k in "ANR")), f"SELECT extract(year FROM paid) AS year, {', '.join(exact_sum(f'CASE WHEN method = $${k}$$ THEN amount END') + ' AS paid_' + k.lower() for k in 'ANR')} FROM pay GROUP BY 1"),
    T("v28_shipped_and_open_by_warehouse", lambda m: m.ship.groupBy("wh_id").agg(F.count_if(C("status") == "F").alias("shipped"), F.count_if(C("status") == "O").alias("open")), "SELECT wh_id, count(*) FILTER (status = 'F') AS shipped, count(*) FILTER (status = 'O') AS open FROM ship GROUP BY wh_id"),
    T("v29_countries_above_mean_orders", lambda m: (lambda per: per.crossJoin(F.broadcast(per.agg(mean(C("rate")).alias("typical")))).where("rate > typical").select("country", "rate"))(m.ord.join(m.cust.select("cust_id", "country"), "cust_id").groupBy("country").agg((F.count("*").cast("double") / F.countDistinct("cust_id")).alias("rate"))), f"WITH per AS (SELECT country, CAST(count(*) AS DOUBLE) / count(DISTINCT cust_id) AS rate FROM ord JOIN cust USING (cust_id) GROUP BY country) SELECT country, rate FROM per WHERE rate > (SELECT {exact_mean('rate')} FROM per)"),
    T("v30_price_bands", lambda m, n: place_rows(m.goods.select("good_id", "price"), "ntile", "price", ["good_id"], tiles=n, place="band"), "SELECT good_id, price, ntile({n}) OVER (ORDER BY price DESC, good_id) AS band FROM goods", {"n": 5}),
]
