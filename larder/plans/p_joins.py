"""Joins, set operations and promotion days."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import calendars
from larder.functions.exprs import exact_sum
from larder.operators import demand, joins, promo
from larder.plans import frames
from larder.plans.p_scan import _OUDIN
from larder.plans.registry import query
from larder.plans.sqlbase import CTES, Q, S
from larder.sources import bindings

CTES.update({
    "products": ([], """SELECT p_partkey AS id, p_name AS title, p_type AS category, p_brand AS brand, p_size AS size, p_retailprice AS price,
  CASE WHEN p_size > 10 THEN 'Active' WHEN p_size > 5 THEN 'Inactive' END AS status FROM part"""),
    "skus": ([], """SELECT p_partkey + 1000000 AS id, p_partkey AS item_id, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS stock_category_id,
  'stock ' || p_name || ' ' || p_partkey AS title, CASE WHEN p_size % 9 <> 0 THEN p_size * 3.0::DOUBLE END AS quantity,
  CASE WHEN p_size % 7 <> 0 THEN 60.0::DOUBLE END AS low_stock_threshold,
  CASE WHEN p_type = 'PROMO' THEN 'composite' ELSE 'normal' END AS type, CASE WHEN p_size % 2 = 0 THEN 'kg' ELSE 'pcs' END AS unit
FROM part WHERE p_size <= 45"""),
    "cats": ([], "SELECT DISTINCT CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS id, p_brand AS title FROM part WHERE p_brand <> 'Brand#1'"),
    "bom": (["skus"], "SELECT id AS parent_sku_id, id + k AS sku_id, k / 2.0::DOUBLE AS quantity FROM skus, (VALUES (1), (2), (3)) v(k) WHERE type = 'composite'"),
    "all_sales": ([], """SELECT o_orderkey AS order_id, CAST(c_nationkey AS BIGINT) AS place_id, CAST(o_orderdate AS DATE) AS date, p_type AS item_id,
  p_name AS title, l_quantity AS quantity, l_extendedprice AS cost, p_retailprice AS price, l_linenumber AS line_no
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey"""),
    "weather": ([], """SELECT CAST(ts AS DATE) AS date, CAST(SUM(CAST(value AS DECIMAL(28,6))) AS DOUBLE) / COUNT(*) AS temperature_max, MIN(value) AS temperature_min,
  COUNT(*) FILTER (event_type = 'error') / 64 AS precipitation_mm, COUNT(*) % 100 AS weather_code,
  100 * COUNT(*) FILTER (event_type = 'view') AS sunshine_s, COUNT(*) FILTER (event_type = 'click') AS precip_probability
FROM events WHERE CAST(ts AS DATE) <> DATE '2024-01-10' GROUP BY 1"""),
})


@query("orders_with_items", """SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS total, l_linenumber AS line_no, l_partkey AS item_id,
  l_quantity AS quantity, l_extendedprice AS cost FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey""")
def _(spark, sf):
    o = bindings.read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"))
    l = bindings.read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"), F.col("l_partkey").alias("item_id"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("cost"))
    return joins.orders_with_items(o, l)


def _status(spark, sf):
    return joins.inventory_status(bindings.products(spark, sf), bindings.skus(spark, sf), bindings.stock_categories(spark, sf))


CTES["inv"] = (["products", "skus", "cats"], """SELECT p.id, p.title, s.id AS sku_id, s.quantity, s.low_stock_threshold AS threshold, s.unit, c.title AS category
FROM products p LEFT JOIN skus s ON s.item_id = p.id LEFT JOIN cats c ON s.stock_category_id = c.id""")
CTES["menu"] = (["bom", "skus", "products"], """SELECT b.parent_sku_id, b.sku_id, p.title AS parent_title, i.title AS menu_item, c.title AS ingredient, b.quantity, c.unit
FROM bom b JOIN skus p ON p.id = b.parent_sku_id JOIN skus c ON c.id = b.sku_id LEFT JOIN products i ON i.id = p.item_id""")


@query("inventory_status", Q("inv", "SELECT * FROM inv"))
def _(spark, sf):
    return _status(spark, sf)


def menu(spark, sf):
    return joins.menu_ingredients(bindings.bill_of_materials(spark, sf), bindings.skus(spark, sf), bindings.products(spark, sf))


@query("menu_ingredients", Q("menu", "SELECT * FROM menu"))
def _(spark, sf):
    return menu(spark, sf)


@query("bom_lookup", Q("menu", """SELECT parent_sku_id, sku_id, parent_title, COALESCE(menu_item, parent_title) AS menu_item, ingredient, quantity, unit
FROM menu WHERE COALESCE(menu_item, parent_title) ILIKE '%ring%'"""))
def _(spark, sf):
    return joins.bom_lookup(menu(spark, sf), "Ring")


@query("enrich_dims", Q("daily items places", """SELECT date, place_id, item_id, quantity_sold, item_name, item_price, item_type, store_name
FROM daily LEFT JOIN items USING (item_id) LEFT JOIN places USING (place_id)"""))
def _(spark, sf):
    items = bindings.dim_items(spark, sf).toDF("item_id", "item_name", "item_price", "item_type")
    places = bindings.dim_places(spark, sf).toDF("place_id", "store_name")
    d = frames.daily(spark, sf).select("date", "place_id", "item_id", "quantity_sold")
    return joins.enrich_dims(d, [(items, "item_id"), (places, "place_id")])


_MOST = "most AS (SELECT place_id, item_id, COUNT(DISTINCT order_id) AS order_count FROM sales_nb GROUP BY ALL)"


@query("places_by_orders", Q("sales_nb", _MOST, """SELECT CAST(n_nationkey AS BIGINT) AS place_id, n_name AS title, SUM(order_count)::BIGINT AS total_orders
FROM most JOIN nation ON place_id = n_nationkey GROUP BY ALL"""))
def _(spark, sf):
    places = bindings.dim_places(spark, sf, "nation").withColumnRenamed("id", "place_id")
    return joins.places_by_orders(joins.most_ordered(frames.sales(spark, sf, "nation")), places)


@query("products_for_place", Q("sales_nb", _MOST, """it AS (SELECT p_brand AS item_id, MIN(p_name) AS title,
  CASE WHEN MIN(p_partkey) % 3 = 0 THEN 'Inactive' ELSE 'Active' END AS status FROM part WHERE p_brand <> 'Brand#5' GROUP BY 1)""",
  "SELECT place_id, item_id, order_count, title, status FROM most LEFT JOIN it USING (item_id) WHERE place_id = 2 AND (status = 'Active' OR status IS NULL) ORDER BY order_count DESC, item_id LIMIT 200"))
def _(spark, sf):
    items = bindings.read(spark, sf, "part").where(F.col("p_brand") != "Brand#5").groupBy(F.col("p_brand").alias("item_id")).agg(
        F.min("p_name").alias("title"), F.when(F.min("p_partkey") % 3 == 0, "Inactive").otherwise("Active").alias("status"))
    return joins.products_for_place(joins.most_ordered(frames.sales(spark, sf, "nation")), items, 2)


@query("top_items_semi", Q("sales", """SELECT title, date, SUM(quantity) AS quantity_sold FROM sales WHERE place_id = 1 AND title IN
  (SELECT title FROM sales WHERE place_id = 1 GROUP BY title ORDER BY SUM(quantity) DESC, title LIMIT 10) GROUP BY ALL"""))
def _(spark, sf):
    return joins.top_title_semi(frames.sales(spark, sf), 10, 1).groupBy("title", "date").agg(F.sum("quantity").alias("quantity_sold"))


@query("join_types", Q("", "l AS (SELECT c_custkey AS k, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING')",
       "r AS (SELECT o_custkey AS k, COUNT(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1995-06-01' GROUP BY 1)",
       " UNION ALL ".join(f"SELECT '{h}' AS how, COUNT(*) AS n_rows, SUM(n)::BIGINT AS n_orders, {S('c_acctbal', 2)} AS balance FROM l {j} JOIN r USING (k)"
                          for h, j in (("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT"), ("outer", "FULL")))))
def _(spark, sf):
    l = bindings.read(spark, sf, "customer").where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("k"), "c_acctbal")
    r = bindings.read(spark, sf, "orders").where(F.col("o_orderdate") < F.lit("1995-06-01")).groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    out = None
    for how in ("inner", "left", "right", "outer"):
        one = joins.merge(l, r, ["k"], how).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n").alias("n_orders"),
                                               exact_sum("c_acctbal", 2).alias("balance")).withColumn("how", F.lit(how))
        out = one if out is None else out.unionByName(one)
    return out


@query("promo_days", Q("promo_days", "SELECT date, place_id, campaign_id, discount, type FROM promo_days"))
def _(spark, sf):
    return frames.campaign_days(spark, sf)


@query("promo_calendar", Q("promo_cal", "SELECT * FROM promo_cal"))
def _(spark, sf):
    return promo.promo_calendar(frames.campaign_days(spark, sf))


CTES["recency"] = (["promo_cal", "days", "places"], """SELECT *, COALESCE(date - MAX(hit) OVER (PARTITION BY place_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS days_since_last_promotion,
  COALESCE(MIN(hit) OVER (PARTITION BY place_id ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - date, -1) AS days_until_next_promotion
FROM (SELECT days.date, p.place_id, COALESCE(c.is_promotion_active, 0) AS is_promotion_active, COALESCE(c.campaign_count, 0) AS campaign_count,
  COALESCE(c.discount_percentage, 0) AS discount_percentage, COALESCE(c.promotion_type, '') AS promotion_type,
  CASE WHEN c.is_promotion_active = 1 THEN days.date END AS hit
  FROM places p CROSS JOIN days LEFT JOIN promo_cal c ON c.date = days.date AND c.place_id = p.place_id)""")


@query("promo_recency", Q("recency", "SELECT date, place_id, is_promotion_active, days_since_last_promotion, days_until_next_promotion FROM recency"))
def _(spark, sf):
    cal = promo.promo_calendar(frames.campaign_days(spark, sf)).select("date", "place_id", "is_promotion_active")
    days = frames.grid(spark, sf).select("date", "place_id").distinct().join(cal, ["date", "place_id"], "left")
    return promo.promo_recency(days.withColumn("is_promotion_active", F.coalesce("is_promotion_active", F.lit(0))))


@query("promo_features", Q("grid recency", """SELECT date, place_id, item_id, is_promotion_active, discount_percentage, promotion_type, campaign_count,
  days_since_last_promotion, days_until_next_promotion FROM grid JOIN recency USING (date, place_id)"""))
def _(spark, sf):
    cal = promo.promo_calendar(frames.campaign_days(spark, sf))
    return promo.add_promotion_features(frames.grid(spark, sf).select("date", "place_id", "item_id"), cal)


@query("orders_nested", """WITH e AS (SELECT l_orderkey AS k, l_linenumber AS a, l_partkey AS b, l_quantity AS c, l_extendedprice AS d, COUNT(*) AS n FROM lineitem GROUP BY ALL),
n AS (SELECT k, '[' || STRING_AGG('{"l_linenumber":' || a || ',"l_partkey":' || b || ',"l_quantity":' || c || ',"l_extendedprice":' || d || ',"copies":' || n || '}', ',' ORDER BY a, b, c, d) || ']' AS items FROM e GROUP BY k)
SELECT o_orderkey, o_orderstatus, o_totalprice, CASE WHEN k IS NOT NULL THEN 0 END AS chunk, items FROM orders LEFT JOIN n ON k = o_orderkey""")
def _(spark, sf):
    l = bindings.read(spark, sf, "lineitem")
    o = bindings.read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    nested = joins.nest_children(l.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey",
                                 ["l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"])
    out = o.join(nested, "o_orderkey", "left")
    return out.withColumn("items", F.to_json("items"))


@query("nested_children", """WITH n AS (SELECT s_nationkey AS k, '[' || STRING_AGG('{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '","s_acctbal":' || s_acctbal || ',"copies":1}', ',' ORDER BY s_suppkey) || ']' AS suppliers
  FROM supplier GROUP BY 1) SELECT n_nationkey, n_name, n_regionkey, CASE WHEN k IS NOT NULL THEN 0 END AS chunk, suppliers FROM nation LEFT JOIN n ON k = n_nationkey""")
def _(spark, sf):
    s = bindings.read(spark, sf, "supplier")
    n = bindings.read(spark, sf, "nation")
    nested = joins.nest_children(s.withColumnRenamed("s_nationkey", "n_nationkey"), "n_nationkey", ["s_suppkey", "s_name", "s_acctbal"], "suppliers")
    return n.join(nested, "n_nationkey", "left").withColumn("suppliers", F.to_json("suppliers"))


@query("parent_child_counts", """SELECT n_nationkey, n_name, (SELECT COUNT(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal < 0) AS debtors,
  (SELECT COUNT(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation""")
def _(spark, sf):
    n = bindings.read(spark, sf, "nation").select("n_nationkey", "n_name")
    c = bindings.read(spark, sf, "customer").where(F.col("c_acctbal") < 0).withColumnRenamed("c_nationkey", "n_nationkey")
    s = bindings.read(spark, sf, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    return joins.child_counts(n, "n_nationkey", {"debtors": c, "suppliers": s})


@query("semi_members", """SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN
  (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) AND c_mktsegment = 'BUILDING')""")
def _(spark, sf):
    nations = bindings.read(spark, sf, "nation").where(F.col("n_regionkey") == 2).select(F.col("n_nationkey").alias("c_nationkey"))
    users = joins.members_of(bindings.read(spark, sf, "customer").where(F.col("c_mktsegment") == "BUILDING"), nations, ["c_nationkey"])
    o = bindings.read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return joins.members_of(o, users.select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"])


@query("unmapped_anti", Q("all_sales skus", """SELECT DISTINCT l_partkey AS item_id FROM lineitem WHERE l_partkey NOT IN (SELECT item_id FROM skus)"""))
def _(spark, sf):
    sold = bindings.read(spark, sf, "lineitem").select(F.col("l_partkey").alias("item_id")).distinct()
    return joins.not_in(sold, bindings.skus(spark, sf).select("item_id"), ["item_id"])


@query("store_totals", f"""SELECT CAST(n_nationkey AS BIGINT) AS place_id, n_name AS title, COUNT(*) AS orders, {S('o_totalprice', 2)} AS revenue
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def _(spark, sf):
    totals = bindings.fct_orders(spark, sf, "nation").groupBy("place_id").agg(
        F.count(F.lit(1)).alias("orders"), exact_sum("total_amount", 2).alias("revenue"))
    return totals.join(bindings.dim_places(spark, sf, "nation").withColumnRenamed("id", "place_id"), "place_id")


_HOL24 = _OUDIN.replace("SELECT MIN(YEAR(o_orderdate)) AS a, MAX(YEAR(o_orderdate)) AS b FROM orders",
                        "SELECT MIN(YEAR(ts)) - 1 AS a, MAX(YEAR(ts)) + 1 AS b FROM events")


@query("calendar_join", Q("weather", _HOL24, """d AS (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events)""",
       """SELECT d.date, temperature_max, temperature_min, precipitation_mm, CASE WHEN precipitation_mm > 1.0 THEN 1 ELSE 0 END AS is_rainy,
  COALESCE(h.holiday_name, '') AS holiday_name, CAST(h.date IS NOT NULL AS BIGINT) AS is_holiday,
  CAST(d.date + 1 IN (SELECT date FROM hol) AS BIGINT) AS is_day_before_holiday, CAST(d.date - 1 IN (SELECT date FROM hol) AS BIGINT) AS is_day_after_holiday
FROM d LEFT JOIN weather USING (date) LEFT JOIN hol h ON h.date = d.date"""))
def _(spark, sf):
    e = bindings.read(spark, sf, "events")
    days = e.select(F.to_date("ts").alias("date")).distinct()
    return joins.calendar_join(days, bindings.weather(spark, sf), calendars.holidays(calendars.years_of(e, "ts", 1, 1)))


@query("union_catalog", """SELECT id, title, MIN(src) AS src FROM (SELECT p_partkey AS id, p_name AS title, 'items' AS src FROM part WHERE p_size <= 30)
GROUP BY ALL UNION ALL SELECT p_partkey, 'menu ' || p_name, 'menu' FROM part WHERE p_size >= 20 AND p_size > 30""")
def _(spark, sf):
    p = bindings.read(spark, sf, "part")
    items = p.where(F.col("p_size") <= 30).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.lit("items").alias("src"))
    menu_items = p.where(F.col("p_size") >= 20).select(
        F.col("p_partkey").alias("id"), F.concat(F.lit("menu "), "p_name").alias("title"), F.lit("menu").alias("src"))
    return joins.union_catalog(items, menu_items)


@query("upsert_merge", """SELECT c_custkey, c_acctbal, 'old' AS src FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)
UNION ALL SELECT o_custkey, MAX(o_totalprice), 'new' FROM orders WHERE o_totalprice > 400000 GROUP BY o_custkey""")
def _(spark, sf):
    base = bindings.read(spark, sf, "customer").select("c_custkey", "c_acctbal", F.lit("old").alias("src"))
    new = bindings.read(spark, sf, "orders").where(F.col("o_totalprice") > 400000).groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max("o_totalprice").alias("c_acctbal")).withColumn("src", F.lit("new"))
    return joins.upsert(base, new, ["c_custkey"])


@query("replace_children", Q("bom", """new AS (SELECT DISTINCT parent_sku_id FROM bom WHERE parent_sku_id % 5 = 0)""",
       """SELECT parent_sku_id, CAST(2 * quantity - 1 AS BIGINT) AS sort_order, sku_id FROM bom WHERE parent_sku_id NOT IN (SELECT parent_sku_id FROM new)
UNION ALL SELECT parent_sku_id, v.k, parent_sku_id + v.off FROM new, (VALUES (0, 10), (1, 7)) v(k, off)"""))
def _(spark, sf):
    b = bindings.bill_of_materials(spark, sf).select(
        "parent_sku_id", (F.col("quantity") * 2 - 1).cast("int").alias("sort_order"), "sku_id")
    new = b.where(F.col("parent_sku_id") % 5 == 0).select("parent_sku_id").distinct().withColumn(
        "items", F.array(F.col("parent_sku_id") + 10, F.col("parent_sku_id") + 7))
    return joins.replace_children(b, new, "parent_sku_id", "items", "sku_id")
