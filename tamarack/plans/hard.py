"""Templates that join, with semi and anti joins, subqueries and common tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tamarack.functions.semantics import in_year, mean, total
from tamarack.plans.mart import Template, exact_mean, exact_sum

C = F.col
T = Template
_REV, _VALUE = exact_sum("rev"), exact_sum("total")


def _instant(moment: str):
    return F.lit(moment).cast("timestamp_ntz")


TEMPLATES = [
    T("h01_orders_of_each_customer", lambda m: m.cust.join(m.ord, "cust_id").groupBy("cust_id", "cust").agg(F.count("ord_id").alias("n")).select("cust", "n"), "SELECT cust, count(ord_id) AS n FROM cust JOIN ord USING (cust_id) GROUP BY cust_id, cust"),
    T("h02_top_customers_by_value", lambda m, n: m.ord.groupBy("cust_id").agg(total(C("total")).alias("value")).orderBy(F.desc("value"), "cust_id").limit(n).join(m.cust.select("cust_id", "cust"), "cust_id"), f"SELECT cust_id, value, cust FROM (SELECT cust_id, {_VALUE} AS value FROM ord GROUP BY cust_id ORDER BY value DESC, cust_id LIMIT {{n}}) JOIN (SELECT cust_id, cust FROM cust) USING (cust_id)", {"n": 10}),
    T("h03_goods_of_category", lambda m, part: m.goods.join(m.cat.where(C("cat").contains(part)).select("cat_id", "cat"), "cat_id").select("good_id", "good", "cat"), "SELECT good_id, good, cat FROM goods JOIN cat USING (cat_id) WHERE contains(cat, {part})", {"part": "Steel"}),
    T("h04_goods_with_vendor", lambda m: m.goods.join(F.broadcast(m.vend), "vend_id").select("good_id", "good", "vend").orderBy("vend", "good"), "SELECT good_id, good, vend FROM goods JOIN vend USING (vend_id)"),
    T("h05_goods_of_each_vendor", lambda m: m.goods.groupBy("vend_id").agg(F.count("good_id").alias("n")).join(F.broadcast(m.vend.select("vend_id", "vend")), "vend_id"), "SELECT vend_id, vend, count(good_id) AS n FROM vend JOIN goods USING (vend_id) GROUP BY 1, 2"),
    T("h06_revenue_by_brand", lambda m: m.item.groupBy("part_id").agg(F.sum(C("rev").cast("decimal(18,4)")).alias("rev")).join(m.prod, "part_id").groupBy("brand").agg(F.sum("rev").cast("double").alias("revenue")), f"SELECT brand, {_REV} AS revenue FROM item JOIN prod USING (part_id) GROUP BY brand"),
    T("h07_staff_with_department", lambda m: m.emp.join(F.broadcast(m.dept), "dept_id").select("emp_id", "emp", "dept", "site").orderBy("dept", "emp"), "SELECT emp_id, emp, dept, site FROM emp JOIN dept USING (dept_id)"),
    T("h08_staff_with_manager", lambda m: m.emp.alias("e").join(m.emp.alias("b"), C("e.boss_id") == C("b.emp_id")).select(C("e.emp").alias("emp"), C("b.emp").alias("boss")), "SELECT e.emp AS emp, b.emp AS boss FROM emp e JOIN emp b ON b.emp_id = e.boss_id"),
    T("h09_customers_across_brands", lambda m, least: m.ord.join(m.item, "ord_id").join(m.prod, "part_id").groupBy("cust_id").agg(F.countDistinct("brand").alias("brands")).where(C("brands") > least).join(m.cust.select("cust_id", "cust"), "cust_id"), "SELECT cust_id, cust, count(DISTINCT brand) AS brands FROM ord JOIN item USING (ord_id) JOIN prod USING (part_id) JOIN cust USING (cust_id) GROUP BY 1, 2 HAVING count(DISTINCT brand) > {least}", {"least": 20}),
    T("h10_top_parts_by_revenue", lambda m, n: m.item.groupBy("part_id").agg(total(C("rev")).alias("revenue")).orderBy(F.desc("revenue"), "part_id").limit(n).join(m.prod.select("part_id", "part"), "part_id"), f"SELECT part_id, part, {_REV} AS revenue FROM item JOIN prod USING (part_id) GROUP BY 1, 2 ORDER BY revenue DESC, part_id LIMIT {{n}}", {"n": 10}),
    T("h11_customers_without_recent_order", lambda m, since: m.cust.join(m.ord.where(C("placed") >= _instant(since)), "cust_id", "left_anti").select("cust_id", "cust"), "SELECT c.cust_id, c.cust FROM cust c LEFT JOIN (SELECT cust_id AS hit FROM ord WHERE placed >= CAST({since} AS TIMESTAMP)) o ON c.cust_id = hit WHERE hit IS NULL", {"since": "2001-01-01"}),
    T("h12_parts_not_shipped_lately", lambda m, since: m.prod.join(m.ship.where(C("sent") >= _instant(since)), "part_id", "left_anti").select("part_id", "part"), "SELECT part_id, part FROM prod p WHERE NOT EXISTS (FROM ship s WHERE s.part_id = p.part_id AND sent >= CAST({since} AS TIMESTAMP))", {"since": "2001-10-01"}),
    T("h13_customers_above_mean_spend", lambda m: (lambda spent: spent.crossJoin(F.broadcast(spent.agg(mean(C("spent")).alias("typical")))).where("spent > typical").select("cust_id", "spent"))(m.ord.groupBy("cust_id").agg(total(C("total")).alias("spent"))), f"SELECT cust_id, {_VALUE} AS spent FROM ord GROUP BY cust_id HAVING {_VALUE} > (SELECT {exact_mean('spent')} FROM (SELECT {_VALUE} AS spent FROM ord GROUP BY cust_id))"),
    T("h14_goods_above_category_mean", lambda m: m.goods.withColumn("typical", F.sum(C("price").cast("decimal(18,4)")).over(Window.partitionBy("cat_id")).cast("double") / F.count("price").over(Window.partitionBy("cat_id"))).where("price > typical").select("good_id", "cat_id", "price"), f"SELECT good_id, cat_id, price FROM goods g WHERE price > (SELECT {exact_mean('x.price')} FROM goods x WHERE x.cat_id = g.cat_id)"),
    T("h15_staff_above_department_mean", lambda m: m.emp.join(F.broadcast(m.emp.groupBy("dept_id").agg(mean(C("salary")).alias("typical"))), "dept_id").where("salary > typical").select("emp_id", "emp", "salary"), f"SELECT emp_id, emp, salary FROM emp e WHERE salary > (SELECT {exact_mean('x.salary')} FROM emp x WHERE x.dept_id = e.dept_id)"),
    T("h16_top_brands_through_common_table", lambda m, n: m.item.join(m.prod, "part_id").groupBy("brand").agg(total(C("rev")).alias("revenue")).orderBy(F.desc("revenue"), "brand").limit(n), f"WITH sold AS (SELECT part_id, CAST(rev AS DECIMAL(18,4)) AS rev FROM item) SELECT brand, CAST(sum(rev) AS DOUBLE) AS revenue FROM sold JOIN prod USING (part_id) GROUP BY brand ORDER BY revenue DESC, brand LIMIT {{n}}", {"n": 5}),
    T("h17_value_of_country_in_year", lambda m, country, year: m.ord.where(in_year(C("placed"), year)).join(m.cust.where(C("country") == country), "cust_id", "left_semi").agg(total(C("total")).alias("value")), f"SELECT {_VALUE} AS value FROM ord JOIN cust USING (cust_id) WHERE country = {{country}} AND extract(year FROM placed) = {{year}}", {"country": "NATION_5", "year": 1998}),
    T("h18_shipments_of_each_warehouse", lambda m: m.ship.groupBy("wh_id").agg(F.count("*").alias("n")).join(m.wh.select("wh_id", "wh"), "wh_id"), "SELECT wh_id, wh, count(*) AS n FROM ship JOIN wh USING (wh_id) GROUP BY 1, 2"),
    T("h19_parts_held_in_country", lambda m, country: m.inv_part.join(m.wh.where(C("country") == country).select("wh_id"), "wh_id").select("part_id", "part").distinct(), "SELECT DISTINCT part_id, part FROM inv JOIN wh USING (wh_id) JOIN prod USING (part_id) WHERE country = {country}", {"country": "NATION_2"}),
    T("h20_parts_in_many_warehouses", lambda m, least: m.inv.groupBy("part_id").agg(F.countDistinct("wh_id").alias("places")).where(C("places") > least), "SELECT part_id, count(DISTINCT wh_id) AS places FROM inv GROUP BY part_id HAVING count(DISTINCT wh_id) > {least}", {"least": 34}),
    T("h21_categories_without_goods", lambda m: m.cat.join(m.goods, "cat_id", "left_anti").select("cat_id", "cat"), "SELECT c.cat_id, c.cat FROM cat c LEFT JOIN goods g ON g.cat_id = c.cat_id WHERE g.cat_id IS NULL"),
    T("h22_top_representatives", lambda m, n: m.ord.where("rep_id is not null").groupBy(C("rep_id").alias("emp_id")).agg(total(C("total")).alias("value")).join(m.emp.select("emp_id", "emp"), "emp_id").orderBy(F.desc("value"), "emp_id").limit(n), f"SELECT emp_id, emp, {_VALUE} AS value FROM emp JOIN ord ON rep_id = emp_id GROUP BY 1, 2 ORDER BY value DESC, emp_id LIMIT {{n}}", {"n": 5}),
    T("h23_orders_not_fully_paid", lambda m: m.pay.where("status = 'F'").groupBy("ord_id").agg(total(C("amount")).alias("paid")).join(m.ord.select("ord_id", "total"), "ord_id").where("paid < total"), f"SELECT ord_id, {exact_sum('amount')} AS paid, total FROM ord JOIN pay USING (ord_id) WHERE pay.status = 'F' GROUP BY ord_id, total HAVING {exact_sum('amount')} < total"),
    T("h24_goods_of_vendors_in_country", lambda m: m.goods.join(F.broadcast(m.vend.where(C("active")).select("vend_id", "vend", "country")), "vend_id").groupBy("vend_id", "vend", "country").agg(F.count("*").alias("n")), "SELECT vend_id, vend, country, count(*) AS n FROM vend JOIN goods USING (vend_id) WHERE active GROUP BY 1, 2, 3"),
    T("h25_collected_by_country", lambda m: m.pay.where("status = 'F'").join(m.ord.select("ord_id", "cust_id"), "ord_id").join(m.cust.select("cust_id", "country"), "cust_id").groupBy("country").agg(total(C("amount")).alias("collected")), f"SELECT country, {exact_sum('amount')} AS collected FROM pay JOIN ord USING (ord_id) JOIN cust USING (cust_id) WHERE pay.status = 'F' GROUP BY country"),
    T("h26_shipments_by_country", lambda m: m.ship.groupBy("wh_id").agg(F.count("*").alias("k")).join(m.wh, "wh_id").groupBy("country").agg(F.sum("k").alias("n")), "SELECT country, count(*) AS n FROM ship JOIN wh USING (wh_id) GROUP BY country"),
    T("h27_mean_pay_by_department", lambda m: m.emp.join(F.broadcast(m.dept), "dept_id").groupBy("dept").agg(mean(C("salary")).alias("mean_pay")), f"SELECT dept, {exact_mean('salary')} AS mean_pay FROM emp JOIN dept USING (dept_id) GROUP BY dept"),
    T("h28_departments_above_mean_pay", lambda m, least: m.emp.join(F.broadcast(m.dept), "dept_id").groupBy("dept").agg(mean(C("salary")).alias("mean_pay")).where(C("mean_pay") > least), f"SELECT dept, {exact_mean('salary')} AS mean_pay FROM emp JOIN dept USING (dept_id) GROUP BY dept HAVING {exact_mean('salary')} > {{least}}", {"least": 4500}),
    T("h29_goods_by_named_category", lambda m: m.goods.groupBy("cat_id").agg(F.count("*").alias("n")).join(m.cat.select("cat_id", "cat"), "cat_id"), "SELECT cat_id, cat, count(*) AS n FROM cat JOIN goods USING (cat_id) GROUP BY 1, 2"),
    T("h30_goods_from_rated_countries", lambda m, rating: m.goods.join(F.broadcast(m.vend.where(C("rating") > rating).select("vend_id", "country")), "vend_id").select("good_id", "good", "country"), "SELECT good_id, good, country FROM goods JOIN vend USING (vend_id) WHERE rating > {rating}", {"rating": 4.5}),
    T("h31_orders_of_status_by_country", lambda m, status: m.ord.where(C("status") == status).join(m.cust.select("cust_id", "country"), "cust_id").groupBy("country").agg(F.count("*").alias("n")), "SELECT country, count(*) AS n FROM ord JOIN cust USING (cust_id) WHERE status = {status} GROUP BY country", {"status": "P"}),
    T("h32_most_valuable_warehouses", lambda m, n: m.inv_part.groupBy("wh_id").agg(total(C("on_hand") * C("list_price")).alias("value")).orderBy(F.desc("value"), "wh_id").limit(n).join(m.wh.select("wh_id", "wh"), "wh_id"), f"SELECT wh_id, wh, {exact_sum('on_hand * list_price')} AS value FROM inv JOIN wh USING (wh_id) JOIN prod USING (part_id) GROUP BY 1, 2 ORDER BY value DESC, wh_id LIMIT {{n}}", {"n": 5}),
    T("h33_categories_above_mean_price", lambda m, least: m.goods.groupBy("cat_id").agg(mean(C("price")).alias("mean_price")).where(C("mean_price") > least).join(m.cat.select("cat_id", "cat"), "cat_id"), f"SELECT cat_id, cat, {exact_mean('price')} AS mean_price FROM cat JOIN goods USING (cat_id) GROUP BY 1, 2 HAVING {exact_mean('price')} > {{least}}", {"least": 150}),
    T("h34_customers_with_unpaid_order", lambda m: m.ord.join(m.pay, "ord_id", "left_anti").select("cust_id").distinct().join(m.cust.select("cust_id", "cust"), "cust_id"), "SELECT DISTINCT cust_id, cust FROM cust JOIN ord USING (cust_id) WHERE NOT EXISTS (FROM pay WHERE pay.ord_id = ord.ord_id)"),
    T("h35_vendors_without_light_goods", lambda m, weight: m.vend.join(m.goods.where(C("weight") < weight), "vend_id", "left_anti").select("vend_id", "vend"), "SELECT v.vend_id, v.vend FROM vend v LEFT JOIN (SELECT vend_id FROM goods WHERE weight < {weight}) g ON g.vend_id = v.vend_id WHERE g.vend_id IS NULL", {"weight": 1.0}),
    T("h36_top_suppliers_by_revenue", lambda m, n: m.item.groupBy(C("sup_id").alias("wh_id")).agg(total(C("rev")).alias("revenue")).orderBy(F.desc("revenue"), "wh_id").limit(n).join(m.wh.select("wh_id", "wh"), "wh_id"), f"SELECT wh_id, wh, {_REV} AS revenue FROM item JOIN wh ON wh_id = sup_id GROUP BY 1, 2 ORDER BY revenue DESC, wh_id LIMIT {{n}}", {"n": 8}),
]
