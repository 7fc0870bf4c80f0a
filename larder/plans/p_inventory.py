"""Inventory, waste, promotion and business-impact queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions.exprs import exact_mean, exact_sum, rnd, rnd_even
from larder.operators import baselines, business, coldstart, demand, inventory, joins, promotion, reports
from larder.plans import frames, p_calendar, p_joins, p_reports
from larder.plans.p_demand import PERISHABLE, _PERISH_SQL, _c
from larder.plans.registry import ORACLES, query
from larder.plans.sqlbase import CTES, M, Q, S, _W
from larder.sources import bindings

RE1 = "ROUND_EVEN"


@query("safety_stock", Q("grid", f"""g AS (SELECT place_id, item_id, ROUND(STDDEV_SAMP(quantity_sold), 9) AS s, {M('quantity_sold')} AS m FROM grid GROUP BY ALL)""",
       "SELECT place_id, item_id, ROUND(s * 1.65 * SQRT(3), 6) AS safety_stock, ROUND(m * 3 + s * 1.65 * SQRT(3), 6) AS reorder_point FROM g"))
def _(spark, sf):
    s = frames.grid(spark, sf).groupBy("place_id", "item_id").agg(
        F.round(F.stddev_samp("quantity_sold"), 9).alias("s"), exact_mean("quantity_sold").alias("m"))
    ss = inventory.safety_stock("s", 3)
    return s.select("place_id", "item_id", rnd(ss).alias("safety_stock"), rnd(inventory.reorder_point("m", ss, 3)).alias("reorder_point"))


@query("prep_recommendations", Q("pred", f"""s AS (SELECT place_id, item_id, MIN(item_name) AS item_name, MIN(store_name) AS store_name, MAX(date) AS date,
  GREATEST(COALESCE(ROUND(CASE WHEN COUNT(*) > 7 THEN STDDEV_SAMP(quantity_sold - predicted) ELSE STDDEV_SAMP(quantity_sold) END, 9), 0.1), 0.1) AS sd,
  {M('quantity_sold')} AS av, ARG_MAX(predicted, date) AS fc FROM pred GROUP BY place_id, item_id)""",
  """SELECT place_id, item_id, item_name, store_name, date, ROUND_EVEN(fc, 1)::DOUBLE AS forecast_demand, ROUND_EVEN(sd * 1.65, 1)::DOUBLE AS safety_stock,
  CAST(GREATEST(CEIL(fc + sd * 1.65), 0) AS BIGINT) AS recommended_prep_qty, ROUND_EVEN(av + sd * 1.65, 1)::DOUBLE AS reorder_point,
  ROUND_EVEN(av, 1)::DOUBLE AS avg_daily_demand, ROUND_EVEN(sd, 1)::DOUBLE AS demand_std,
  CASE WHEN sd / GREATEST(av, 0.1) > 0.8 THEN 'red' WHEN sd / GREATEST(av, 0.1) > 0.4 THEN 'yellow' ELSE 'green' END AS alert_level FROM s"""))
def _(spark, sf):
    return inventory.prep_recommendations(frames.predictions(spark, sf))


@query("prep_schedule", Q("pred", f"""w AS (SELECT *, GREATEST(COALESCE(ROUND(COALESCE(CASE WHEN COUNT(*) OVER ({_W} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) >= 3 THEN
  STDDEV_SAMP(quantity_sold) OVER ({_W} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) END, STDDEV_SAMP(quantity_sold) OVER (PARTITION BY place_id, item_id)), 9), 0.1), 0.1) * 1.65 AS ss FROM pred)""",
  """SELECT date, place_id, item_id, item_name, store_name, ROUND_EVEN(predicted, 1)::DOUBLE AS forecast, ROUND_EVEN(ss, 1)::DOUBLE AS safety_stock,
  CAST(GREATEST(CEIL(predicted + ss), 0) AS BIGINT) AS recommended_qty FROM w"""))
def _(spark, sf):
    return inventory.prep_schedule(frames.predictions(spark, sf))


def _waste_sql(p):
    return f"""SELECT *, o / GREATEST(total_demand, 1) AS waste_rate, u / GREATEST(total_demand, 1) AS stockout_rate, o * c * 0.3::DOUBLE AS waste_cost_dkk, u * c AS lost_revenue_dkk
FROM (SELECT place_id, item_id, MIN(item_name) AS item_name, MIN(store_name) AS store_name, SUM(quantity_sold) AS total_demand,
  {S(f'GREATEST({p} - quantity_sold, 0)')} AS o, {S(f'GREATEST(quantity_sold - {p}, 0)')} AS u, COALESCE({M('item_price', 9)}, 50) AS c FROM pred GROUP BY place_id, item_id)"""


@query("waste_estimate", Q("pred", f"SELECT * RENAME (o AS total_overstock_units, u AS total_understock_units) EXCLUDE (c) FROM ({_waste_sql('predicted')})".replace(
    "* RENAME (o AS total_overstock_units, u AS total_understock_units) EXCLUDE (c)", "* EXCLUDE (c, o, u), o AS total_overstock_units, u AS total_understock_units")))
def _(spark, sf):
    return inventory.waste_estimate(frames.predictions(spark, sf))


@query("savings", Q("pred", f"n AS ({_waste_sql('naive')})", f"m AS ({_waste_sql('predicted')})",
       """SELECT n.place_id, n.item_id, n.waste_cost_dkk AS waste_cost_dkk_naive, n.lost_revenue_dkk AS lost_revenue_dkk_naive, m.waste_cost_dkk AS waste_cost_dkk_ml,
  m.lost_revenue_dkk AS lost_revenue_dkk_ml, n.waste_cost_dkk - m.waste_cost_dkk AS waste_savings_dkk, n.lost_revenue_dkk - m.lost_revenue_dkk AS revenue_recovery_dkk,
  (n.waste_cost_dkk - m.waste_cost_dkk) + (n.lost_revenue_dkk - m.lost_revenue_dkk) AS total_savings_dkk FROM n JOIN m USING (place_id, item_id)"""))
def _(spark, sf):
    p = frames.predictions(spark, sf)
    return inventory.savings(inventory.waste_estimate(p, "naive"), inventory.waste_estimate(p, "predicted"))


CTES["risk"] = (["pred"], f"""SELECT place_id, item_id, item_name, store_name, ROUND_EVEN(av, 2)::DOUBLE AS avg_daily_demand, ROUND_EVEN(sd, 2)::DOUBLE AS demand_std,
  ROUND_EVEN(sd / GREATEST(av, 0.1), 3)::DOUBLE AS cv, CASE WHEN sd / GREATEST(av, 0.1) > 1 THEN 'high' WHEN sd / GREATEST(av, 0.1) > 0.5 THEN 'medium' ELSE 'low' END AS waste_risk,
  {_PERISH_SQL} AS is_perishable FROM (SELECT place_id, item_id, MIN(item_name) AS item_name, MIN(store_name) AS store_name, {M('quantity_sold')} AS av,
  ROUND(STDDEV_SAMP(quantity_sold), 9) AS sd FROM pred GROUP BY place_id, item_id)""")
CTES["slow"] = (["pred"], f"""SELECT * EXCLUDE (t) FROM (SELECT *, quantile_cont(avg_daily_demand, 0.25) OVER () AS t FROM (SELECT place_id, item_id, {M('quantity_sold')} AS avg_daily_demand,
  SUM(quantity_sold) AS total_demand, COUNT(*) FILTER (quantity_sold > 0) AS days_with_sales, COUNT(*) AS total_days, MIN(item_name) AS item_name, MIN(store_name) AS store_name,
  COUNT(*) FILTER (quantity_sold > 0) / COUNT(*) AS sell_through_rate FROM pred GROUP BY place_id, item_id)) WHERE avg_daily_demand <= t""")
CTES["sugg"] = (["slow", "risk"], """SELECT s.*, r.waste_risk, r.cv, CASE WHEN waste_risk = 'high' THEN 25.0::DOUBLE WHEN waste_risk = 'medium' THEN 15.0 WHEN sell_through_rate < 0.2 THEN 20.0 ELSE 10.0 END AS suggested_discount_pct,
  'Monday-Tuesday' AS suggested_days, CASE waste_risk WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS priority FROM slow s LEFT JOIN risk r ON r.place_id = s.place_id AND r.item_id = s.item_id""")


@query("waste_risk", Q("risk", "SELECT * FROM risk"))
def _(spark, sf):
    return inventory.waste_risk(frames.predictions(spark, sf), PERISHABLE)


@query("slow_movers", Q("slow", "SELECT * FROM slow"))
def _(spark, sf):
    return promotion.slow_movers(frames.predictions(spark, sf))


def _suggestions(spark, sf):
    p = frames.predictions(spark, sf)
    return promotion.promo_suggestions(promotion.slow_movers(p), inventory.waste_risk(p, PERISHABLE))


@query("promo_suggestions", Q("sugg", "SELECT * FROM sugg"))
def _(spark, sf):
    return _suggestions(spark, sf)


@query("promo_revenue_impact", Q("sugg", """SELECT place_id, item_id, avg_daily_demand * 100 AS current_daily_revenue, ROUND(n, 6) AS new_daily_revenue, ROUND(n - avg_daily_demand * 100, 6) AS daily_revenue_change,
  ROUND(ROUND(n - avg_daily_demand * 100, 6) * 30, 4) AS monthly_revenue_change FROM (SELECT *, avg_daily_demand * 1.3::DOUBLE * (100 * (1 - suggested_discount_pct / 100)) AS n FROM sugg)
ORDER BY daily_revenue_change DESC, place_id, item_id LIMIT 10"""))
def _(spark, sf):
    return promotion.promo_revenue_impact(_suggestions(spark, sf))


@query("campaign_lift", Q("pgrid places", f"""SELECT place_id, store_name, ROUND_EVEN(p, 2)::DOUBLE AS avg_demand_with_promo, ROUND_EVEN(n, 2)::DOUBLE AS avg_demand_without_promo,
  ROUND_EVEN((p - n) / GREATEST(n, 0.01) * 100, 1)::DOUBLE AS demand_lift_pct, promo_days, non_promo_days FROM (SELECT place_id, MIN(store_name) AS store_name,
  {M('CASE WHEN is_promotion_active = 1 THEN quantity_sold END')} AS p, {M('CASE WHEN is_promotion_active = 0 THEN quantity_sold END')} AS n,
  COUNT(*) FILTER (is_promotion_active = 1) AS promo_days, COUNT(*) FILTER (is_promotion_active = 0) AS non_promo_days FROM pgrid JOIN places USING (place_id) GROUP BY place_id)
WHERE promo_days > 0 AND non_promo_days > 0"""))
def _(spark, sf):
    return promotion.campaign_lift(frames.enriched(p_reports._promo_grid(spark, sf), spark, sf))


# ---- stock -------------------------------------------------------------------------

@query("low_stock", Q("inv", "SELECT *, ROUND(quantity / threshold, 2) AS stock_ratio FROM inv WHERE threshold > 0 AND quantity <= threshold ORDER BY stock_ratio, id LIMIT 50"))
def _(spark, sf):
    return inventory.low_stock(p_joins._status(spark, sf))


@query("days_of_stock", Q("inv all_sales", "r AS (SELECT LOWER(title) AS t, SUM(quantity) / COUNT(DISTINCT date) AS avg_daily_sales FROM all_sales GROUP BY 1)",
       "SELECT id, title, quantity, unit, category, avg_daily_sales, ROUND(quantity / avg_daily_sales, 4) AS days_of_stock FROM inv JOIN r ON t = LOWER(title) WHERE quantity > 0 AND avg_daily_sales > 0 ORDER BY days_of_stock, id LIMIT 30"))
def _(spark, sf):
    return inventory.days_of_stock(p_joins._status(spark, sf), bindings.all_sales(spark, sf))


@query("inventory_query", Q("inv", "SELECT * FROM inv WHERE sku_id IS NOT NULL AND category ILIKE '%brand#1%' ORDER BY quantity NULLS LAST, id LIMIT 50"))
def _(spark, sf):
    return inventory.inventory_query(p_joins._status(spark, sf), "Brand#1")


@query("stock_list", Q("inv", "SELECT * REPLACE (COALESCE(quantity, 0) AS quantity) FROM inv WHERE title ILIKE '%widget%' AND category = 'Brand#7' AND COALESCE(quantity, 0) <= threshold"))
def _(spark, sf):
    return inventory.stock_list(p_joins._status(spark, sf), "Widget", "Brand#7", True)


@query("reorder_simple", Q("daily_nb", "r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY place_id, item_id ORDER BY date DESC) AS rn FROM daily_nb)",
       "SELECT place_id, item_id, AVG(quantity_sold) AS mean_last_7, CAST(CEIL(AVG(quantity_sold) * 3 + AVG(quantity_sold) * 3 * 0.5) AS BIGINT) AS reorder_point FROM r WHERE rn <= 7 GROUP BY ALL"))
def _(spark, sf):
    return inventory.reorder_simple(baselines.tail_mean(frames.daily(spark, sf, "nation"), (7,)), "mean_last_7")


def _product_demand(spark, sf, days=7):
    return p_reports.forecasts(spark, sf, days).groupBy("item_name").agg(exact_sum("predicted_quantity").alias("demand"))


CTES["pdem"] = ([], f"SELECT item_name, {S('predicted_quantity')} AS demand FROM ({ORACLES['fc_history']}) GROUP BY 1")
CTES["linked"] = (["pdem", "products", "skus"], """SELECT pdem.item_name AS product, pdem.demand, s.id AS sku, s.type FROM pdem
JOIN (SELECT LOWER(title) AS t, MAX(id) AS pid FROM products GROUP BY 1) p ON p.t = LOWER(pdem.item_name) JOIN skus s ON s.item_id = p.pid""")
CTES["expl"] = (["linked", "bom"], """SELECT b.sku_id, product, demand * b.quantity AS demand FROM linked JOIN bom b ON b.parent_sku_id = linked.sku WHERE linked.type = 'composite'
UNION ALL SELECT sku, product, demand FROM linked WHERE NOT (linked.type = 'composite' AND sku IN (SELECT parent_sku_id FROM bom))""")
CTES["drv"] = (["expl"], f"SELECT sku_id, product, {S('demand')} AS demand FROM expl GROUP BY ALL")


@query("ingredient_drivers", Q("drv", "SELECT * FROM drv"))
def _(spark, sf):
    return inventory.ingredient_drivers(_product_demand(spark, sf), bindings.products(spark, sf), bindings.skus(spark, sf), bindings.bill_of_materials(spark, sf))


@query("ingredient_demand", Q("drv skus", f"n AS (SELECT sku_id, {S('demand')} AS d, COUNT(*) AS k FROM drv GROUP BY 1)",
       """x AS (SELECT s.*, COALESCE(d, 0) AS dem, COALESCE(k, 0) AS k, COALESCE(quantity, 0) AS st, COALESCE(low_stock_threshold, 0) AS lo, COALESCE(d, 0) / 7 AS rate FROM skus s LEFT JOIN n ON n.sku_id = s.id)""",
       "y AS (SELECT *, CASE WHEN rate > 0 THEN st / rate ELSE 999 END AS lft FROM x)",
       """SELECT id AS sku_id, title AS ingredient, unit, type, ROUND(st, 2) AS current_stock, ROUND(dem, 2) AS forecasted_demand, ROUND(rate, 2) AS daily_consumption_rate,
  ROUND(LEAST(lft, 999), 1) AS days_of_stock_remaining, lo AS low_stock_threshold, st < lo OR (rate > 0 AND lft < 7) AS needs_reorder,
  CASE WHEN lft < 2 THEN 'critical' WHEN lft < 7 THEN 'soon' WHEN st < lo THEN 'low_stock' ELSE 'ok' END AS reorder_urgency,
  ROUND(CASE WHEN rate > 0 THEN GREATEST(rate * 7 * 1.5 - st, 0) ELSE 0 END, 2) AS suggested_reorder_qty, k AS driver_count FROM y"""))
def _(spark, sf):
    return inventory.by_urgency(inventory.ingredient_demand(
        _product_demand(spark, sf), bindings.products(spark, sf), bindings.skus(spark, sf), bindings.bill_of_materials(spark, sf), 7))


def _edges(spark, sf):
    return bindings.bill_of_materials(spark, sf).withColumnRenamed("parent_sku_id", "recipe_id")


@query("recipe_cost", Q("bom skus", "l AS (SELECT b.parent_sku_id AS recipe_id, b.sku_id, b.quantity, COALESCE(p.p_retailprice * 0.1::DOUBLE, 0) AS u, b.quantity * COALESCE(p.p_retailprice * 0.1::DOUBLE, 0) AS cost FROM bom b LEFT JOIN part p ON p.p_partkey + 1000000 = b.sku_id AND p.p_size <= 45)",
       f"t AS (SELECT recipe_id, {S('cost')} AS total_cost FROM l GROUP BY 1)",
       "r AS (SELECT p_partkey + 1000000 AS recipe_id, p_size % 4 AS y, p_retailprice AS sp FROM part)",
       """SELECT l.recipe_id, sku_id, quantity, u AS cost_per_unit, cost, total_cost, CASE WHEN total_cost > 0 THEN cost / total_cost * 100 ELSE 0 END AS share_pct,
  CASE WHEN y > 0 THEN total_cost / y ELSE 0 END AS cost_per_serving, sp AS selling_price, (sp - CASE WHEN y > 0 THEN total_cost / y ELSE 0 END) / sp * 100 AS profit_margin
FROM l JOIN t USING (recipe_id) JOIN r USING (recipe_id)"""))
def _(spark, sf):
    p = bindings.read(spark, sf, "part")
    costs = p.where(F.col("p_size") <= 45).select((F.col("p_partkey") + 1000000).alias("sku_id"), (F.col("p_retailprice") * 0.1).alias("cost_per_unit"))
    recipes = p.select((F.col("p_partkey") + 1000000).alias("recipe_id"), (F.col("p_size") % 4).alias("yield_quantity"), F.col("p_retailprice").alias("selling_price"))
    return inventory.recipe_cost(_edges(spark, sf), costs, recipes)


def batches(spark, sf):
    l = bindings.read(spark, sf, "lineitem")
    return l.select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"), (F.col("l_partkey") + 1000000).alias("sku_id"),
                    F.col("l_quantity").alias("quantity"), F.date_add(F.to_date("l_shipdate"), F.col("l_linenumber") * 3).alias("expiry_date"),
                    (F.col("l_returnflag") == "R").alias("disposed"))


CTES["exp"] = ([], """SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey + 1000000 AS sku_id, l_quantity AS quantity,
  CAST(l_shipdate AS DATE) + l_linenumber * 3 AS expiry_date, CAST(l_shipdate AS DATE) + l_linenumber * 3 - DATE '1998-06-01' AS days_until_expiry
FROM lineitem WHERE l_returnflag <> 'R' AND l_quantity > 0 AND CAST(l_shipdate AS DATE) + l_linenumber * 3 - DATE '1998-06-01' BETWEEN 0 AND 14""")


@query("expiring_batches", Q("exp", "SELECT * FROM exp"))
def _(spark, sf):
    return inventory.open_batches(batches(spark, sf), "1998-06-01", 14).drop("disposed")


@query("expiring_recipes", Q("exp bom", "st AS (SELECT sku_id, SUM(quantity) AS q, MIN(days_until_expiry) AS d FROM exp GROUP BY 1)",
       "SELECT parent_sku_id AS recipe_id, COUNT(*) AS expiring_ingredients, CAST(MIN(FLOOR(q / quantity)) AS BIGINT) AS max_servings, MIN(d) AS urgency FROM bom JOIN st USING (sku_id) GROUP BY 1"))
def _(spark, sf):
    return inventory.expiring_recipes(inventory.open_batches(batches(spark, sf), "1998-06-01", 14), _edges(spark, sf))


@query("purchase_orders", """SELECT l_suppkey AS po_id, COUNT(*) AS order_lines, CAST(SUM(ROUND(l_quantity * (l_extendedprice / 7))) AS DOUBLE) AS total_amount,
  BOOL_AND(l_linenumber > 1 OR l_orderkey % 50 <> 0) AS fully_received FROM lineitem GROUP BY 1""")
def _(spark, sf):
    l = bindings.read(spark, sf, "lineitem")
    short = F.when((F.col("l_linenumber") <= 1) & (F.col("l_orderkey") % 50 == 0), 0.5).otherwise(0.0)
    return inventory.purchase_orders(l.select(F.col("l_suppkey").alias("po_id"), F.col("l_quantity").alias("quantity"),
                                              (F.col("l_extendedprice") / 7).alias("unit_cost"), (F.col("l_quantity") - short).alias("received")))


@query("order_repricing", """WITH l AS (SELECT l_orderkey AS order_id, CASE WHEN p_size <> 13 THEN p_retailprice END AS price, l_tax * 100 AS modifiers, l_quantity AS quantity FROM lineitem JOIN part ON p_partkey = l_partkey),
t AS (SELECT order_id, CAST(SUM(CAST((price + modifiers) * quantity AS DECIMAL(28,4))) AS DOUBLE) AS subtotal FROM l GROUP BY 1 HAVING COUNT(*) = COUNT(price))
SELECT o_orderkey AS order_id, o_totalprice AS stored_total, subtotal, subtotal - d + x + tip AS total, ROUND(subtotal - d + x + tip - o_totalprice, 2) AS difference
FROM (SELECT *, CAST(o_orderkey % 50 AS DOUBLE) AS d, CAST(o_custkey % 90 AS DOUBLE) AS x, CAST(o_orderkey % 7 AS DOUBLE) AS tip FROM orders) JOIN t ON t.order_id = o_orderkey""")
def _(spark, sf):
    l = bindings.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"),
                                                    (F.col("l_tax") * 100).alias("modifiers"), F.col("l_quantity").alias("quantity"))
    p = bindings.read(spark, sf, "part").where(F.col("p_size") != 13).select(F.col("p_partkey").alias("product_id"), F.col("p_retailprice").alias("price"))
    o = bindings.read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("stored_total"), (F.col("o_orderkey") % 50).cast("double").alias("discount_amount"),
        (F.col("o_custkey") % 90).cast("double").alias("tax_amount"), (F.col("o_orderkey") % 7).cast("double").alias("tip_amount"))
    audit, _unknown = inventory.order_repricing(o, l, p)
    return audit.select("order_id", "stored_total", "subtotal", "total", "difference")


SCENARIOS = [("discount", "ring", 20, 7), ("demand", "", 15, 30), ("demand", "bolt", -10, 7), ("removal", "red", 100, 30), ("outage", "", 100, 5), ("new_item", "", 0, 30)]


@query("scenario_impact", Q("all_sales", "d AS (SELECT date, title AS item_title, SUM(quantity) AS q, CAST(SUM(CAST(quantity * price AS DECIMAL(28,2))) AS DOUBLE) AS r FROM all_sales GROUP BY ALL)",
       "b AS (SELECT item_title, tq / n AS av, tr / CASE WHEN tq = 0 THEN 1 ELSE tq END AS pr, tr FROM (SELECT item_title, SUM(q) AS tq, CAST(SUM(CAST(r AS DECIMAL(28,2))) AS DOUBLE) AS tr, COUNT(*) AS n FROM d WHERE date >= (SELECT MAX(date) FROM d) - 30 GROUP BY 1))",
       "s AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}', '{w}', {p}::DOUBLE, {d})" for i, (k, w, p, d) in enumerate(SCENARIOS)) + ") v(no, kind, word, pct, days))",
       """x AS (SELECT no, kind, days, CASE kind WHEN 'discount' THEN av * (1 + pct / 100 * 1.5) WHEN 'demand' THEN av * (1 + pct / 100) ELSE 0 END AS nq, CASE kind WHEN 'discount' THEN pr * (1 - pct / 100) ELSE pr END AS np,
  av, pr, tr FROM b JOIN s ON kind <> 'new_item' AND (word = '' OR contains(LOWER(item_title), word)))""",
       f"""e AS (SELECT no, kind, days, COUNT(*) AS items, {S('nq - av')} AS dq, {S("nq * np - CASE WHEN kind = 'removal' THEN tr / 30 ELSE av * pr END")} AS dr FROM x GROUP BY ALL
  UNION ALL SELECT no, kind, days, (SELECT COUNT(*) FROM b), (SELECT quantile_cont(av, 0.5) FROM b) * 0.6::DOUBLE, (SELECT quantile_cont(av, 0.5) FROM b) * 0.6::DOUBLE * (SELECT quantile_cont(pr, 0.5) FROM b) FROM s WHERE kind = 'new_item')""",
       "SELECT no, kind, items, ROUND(dq, 4) AS daily_qty_change, ROUND(dr, 4) AS daily_revenue_change, ROUND(dr * days, 4) AS total_revenue_change FROM e"))
def _(spark, sf):
    d = bindings.all_sales(spark, sf).groupBy("date", F.col("title").alias("item_title")).agg(
        F.sum("quantity").alias("total_quantity"), exact_sum(F.col("quantity") * F.col("price"), 2).alias("total_revenue"))
    return promotion.scenario_impact(d, SCENARIOS)


# ---- coupons and strategy -----------------------------------------------------------

def _coupon_frames(spark, sf):
    p = bindings.read(spark, sf, "part")
    coupons = p.select(
        F.concat(F.lit("SAVE"), "p_partkey").alias("code"), (F.col("p_size") % 11 != 0).alias("is_active"),
        F.date_add(F.lit("1996-01-01").cast("date"), F.col("p_size") * 10).alias("valid_from"),
        F.date_add(F.lit("2000-01-01").cast("date"), F.col("p_size") * 10).alias("valid_until"),
        F.when(F.col("p_size") % 3 == 0, F.lit(None)).otherwise(F.col("p_size") % 5 * 2).alias("max_uses"),
        (F.col("p_size") % 7).alias("used_count"), F.when(F.col("p_size") % 2 == 0, 100000.0).alias("min_order_amount"),
        F.when(F.col("p_type") == "SMALL", F.array("p_brand")).otherwise(F.array().cast("array<string>")).alias("applicable_products"),
        F.when(F.col("p_type") == "LARGE", F.array(F.lit("BUILDING"))).alias("applicable_categories"))
    o = bindings.read(spark, sf, "orders").join(bindings.read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    uses = o.select(
        F.col("o_orderkey").alias("order_id"), F.concat(F.lit("save"), (F.col("o_orderkey") % 4000)).alias("code"),
        F.to_date("o_orderdate").alias("now"), F.col("o_totalprice").alias("order_total"),
        F.array(F.concat(F.lit("Brand#"), (F.col("o_custkey") % 25 + 1))).alias("product_ids"), F.array("c_mktsegment").alias("category_ids"))
    return uses, coupons


_COUPON_SQL = """c AS (SELECT 'SAVE' || p_partkey AS code, p_size % 11 <> 0 AS act, DATE '1996-01-01' + p_size * 10 AS vf, DATE '2000-01-01' + p_size * 10 AS vu,
  CASE WHEN p_size % 3 <> 0 THEN p_size % 5 * 2 END AS mu, p_size % 7 AS uc, CASE WHEN p_size % 2 = 0 THEN 100000 END AS mo, CASE WHEN p_type = 'SMALL' THEN p_brand END AS ap, p_type = 'LARGE' AS ac FROM part)""", \
    """u AS (SELECT o_orderkey AS order_id, 'save' || (o_orderkey % 4000) AS code, CAST(o_orderdate AS DATE) AS now, o_totalprice AS t, 'Brand#' || (o_custkey % 25 + 1) AS pid, c_mktsegment AS cid FROM orders JOIN customer ON o_custkey = c_custkey)"""


@query("coupon_validity", Q("", *_COUPON_SQL, """SELECT order_id, reason, reason IS NULL AS is_valid FROM (SELECT order_id, CASE WHEN act IS NULL THEN 'Coupon not found' WHEN NOT act THEN 'Coupon is inactive'
  WHEN vf > now THEN 'Coupon is not yet valid' WHEN vu < now THEN 'Coupon has expired' WHEN mu > 0 AND uc >= mu THEN 'Coupon usage limit reached' WHEN mo > 0 AND t < mo THEN 'Minimum order amount'
  WHEN ap IS NOT NULL AND ap <> pid THEN 'Coupon not valid for these products' WHEN ac AND cid <> 'BUILDING' THEN 'Coupon not valid for these categories' END AS reason FROM u LEFT JOIN c ON LOWER(c.code) = LOWER(u.code))"""))
def _(spark, sf):
    return promotion.coupon_validity(*_coupon_frames(spark, sf)).select("order_id", "reason", "is_valid")


@query("coupon_usage", Q("", *_COUPON_SQL, "SELECT c.code, uc AS used_count, COALESCE(n, 0) AS new_uses, uc + COALESCE(n, 0) AS total_uses FROM c LEFT JOIN (SELECT LOWER(code) AS k, COUNT(*) AS n FROM u GROUP BY 1) ON k = LOWER(c.code)"))
def _(spark, sf):
    return promotion.coupon_usage(*_coupon_frames(spark, sf)).select("code", "used_count", "new_uses", "total_uses")


_CTX = ["is_monday", "is_friday", "is_weekend", "is_day_after_holiday", "is_day_before_holiday", "precip_probability", "days_since_payday",
        "is_grilling_season", "temperature_max", "is_payday_week", "is_school_holiday", "is_julefrokost_season", "is_christmas_season", "is_sankt_hans", "severe_weather"]
CTES["fallback"] = ([], ORACLES["fc_sql_fallback"])


@query("strategy_choice", Q("fallback bias", "i AS (SELECT *, ROW_NUMBER() OVER (ORDER BY avg_daily_demand DESC, item_name) <= 5 AS top FROM fallback)",
       """r AS (SELECT b.date, i.item_name, i.avg_daily_demand AS a, i.safety_stock AS ss, CAST(is_perishable AS INT) + CAST(is_monday OR is_day_after_holiday = 1 AS INT) + COALESCE(CAST(precip_probability > 60 AS INT), 0) + CAST(demand_cv > 0.8 AS INT) + CAST(days_since_payday > 10 AS INT) AS w,
  CAST(is_friday OR is_weekend OR is_day_before_holiday = 1 AS INT) + COALESCE(CAST(is_grilling_season AND temperature_max > 18 AS INT), 0) + CAST(is_payday_week AS INT) + CAST(is_school_holiday AS INT) + CAST(is_julefrokost_season OR is_christmas_season OR is_sankt_hans AS INT)
  + COALESCE(CAST(severe_weather AS INT), 0) + CAST(demand_cv < 0.3 AS INT) + CAST(top AS INT) AS s FROM i JOIN bias b ON b.date > (SELECT MAX(date) - 7 FROM bias))""",
       """SELECT date, item_name, w AS waste_rules, s AS stockout_rules, CASE WHEN s > w THEN 'stockout_optimized' WHEN w > s THEN 'waste_optimized' ELSE 'balanced' END AS strategy,
  ROUND(CASE WHEN s > w THEN a * 1.2 WHEN w > s THEN a * 0.85 ELSE a END, 4) AS forecast, CAST(CEIL(ROUND(CASE WHEN s > w THEN a * 1.2 WHEN w > s THEN a * 0.85 ELSE a END + ss, 6)) AS BIGINT) AS prep_qty FROM r"""))
def _(spark, sf):
    d = demand.item_daily_demand(frames.sales(spark, sf))
    f = baselines.average_fallback(d, 60, 30, PERISHABLE)
    best = f.orderBy(F.desc("avg_daily_demand"), "item_name").limit(5).select("item_name", F.lit(True).alias("is_top_seller"))
    last = bindings.read(spark, sf, "orders").agg(F.max(F.to_date("o_orderdate")).alias("d")).scalar()
    items = f.join(best, "item_name", "left").withColumn("is_top_seller", F.coalesce("is_top_seller", F.lit(False))).withColumnRenamed("demand_cv", "cv").withColumn(
        "date", F.explode(F.sequence(F.date_sub(last, 6), last, F.expr("interval 1 day"))))
    ctx = p_calendar.context(spark, sf).select("date", "calendar.*", "retail.*", "holidays.*", "business.*", "weather.*").select("date", *_CTX)
    return promotion.strategy_choice(items, ctx).select("date", "item_name", "waste_rules", "stockout_rules", "strategy", "forecast", "prep_qty")


# ---- business impact ----------------------------------------------------------------

def _rc(p, w=1.0, s=1.5):
    return f"(GREATEST({p} - quantity_sold, 0) * ({w}::DOUBLE * 0.3::DOUBLE) + GREATEST(quantity_sold - {p}, 0) * {s}::DOUBLE) * item_price"


_DAYN = "['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday'][day_of_week + 1]"


@query("business_impact", Q("pred", f"""pp AS (SELECT {S('GREATEST(ma28 - quantity_sold, 0) * item_price * 0.3::DOUBLE')} AS bw, {S('GREATEST(quantity_sold - ma28, 0) * item_price')} AS bs,
  {S('GREATEST(predicted - quantity_sold, 0) * item_price * 0.3::DOUBLE')} AS mw, {S('GREATEST(quantity_sold - predicted, 0) * item_price')} AS ms FROM pred)""",
  f"""(SELECT 'item_savings' AS section, item_id AS name, {S(_rc('ma28'))} - {S(_rc('predicted'))} AS value FROM pred GROUP BY item_id ORDER BY value DESC, item_id LIMIT 15)
UNION ALL (SELECT 'store_annual_savings', store_name, ({S(_rc('ma28'))} - {S(_rc('predicted'))}) * (365::DOUBLE / (SELECT COUNT(DISTINCT date) FROM pred)) AS value FROM pred GROUP BY store_name ORDER BY value DESC, store_name LIMIT 20)
UNION ALL SELECT 'weekday_baseline', {_DAYN}, {S(_rc('ma28'))} FROM pred GROUP BY day_of_week
UNION ALL SELECT 'weekday_model', {_DAYN}, {S(_rc('predicted'))} FROM pred GROUP BY day_of_week
UNION ALL SELECT 'waterfall', 'baseline_total', bw + bs * 1.5 FROM pp UNION ALL SELECT 'waterfall', 'waste_reduction', bw - mw FROM pp
UNION ALL SELECT 'waterfall', 'stockout_reduction', bs * 1.5 - ms * 1.5 FROM pp UNION ALL SELECT 'waterfall', 'model_total', mw + ms * 1.5 FROM pp
UNION ALL SELECT 'waterfall', 'waste_reduction_pct', (1 - mw / GREATEST(bw, 1)) * 100 FROM pp"""))
def _(spark, sf):
    return business.business_impact(frames.predictions(spark, sf), "ma28", "predicted")


@query("savings_by_preset", Q("pred", " UNION ALL ".join(f"SELECT '{m}' AS model, '{p}' AS preset, {S(_rc(c, w, s))} AS total_cost FROM pred"
       for m, c in (("ma28", "ma28"), ("ma7", "predicted"), ("buffered", "buffered"))
       for p, (w, s) in {"default": (1.0, 1.5), "balanced": (1.0, 1.0), "profit": (1.0, 2.0), "sustainability": (2.0, 1.0)}.items())))
def _(spark, sf):
    return business.savings_by_preset(frames.predictions(spark, sf), {"ma28": "ma28", "ma7": "predicted", "buffered": "buffered"})


# ---- cold start --------------------------------------------------------------------

@query("cold_start", Q("all_sales", "d AS (SELECT title AS item, date, SUM(quantity) AS qty FROM all_sales GROUP BY ALL)",
       f"st AS (SELECT item, {M('qty')} AS av FROM d GROUP BY item HAVING COUNT(*) >= 5)",
       "np AS (SELECT p_partkey AS id, p_brand AS category, CASE WHEN p_partkey % 3 = 0 THEN 'Unseen thing' WHEN p_partkey % 3 = 1 THEN 'Big ' || split_part(p_name, ' ', 2) ELSE split_part(p_name, ' ', 1) || ' of xy' END AS name FROM part)",
       "w AS (SELECT DISTINCT id, word FROM (SELECT id, UNNEST(list_filter(string_split(LOWER(name), ' '), lambda x: len(x) > 2)) AS word FROM np))",
       "cat AS (SELECT DISTINCT p_brand AS category, p_name AS item FROM part WHERE p_brand <> 'Brand#2')",
       """cand AS (SELECT DISTINCT w.id, 1 AS tier, st.item, st.av FROM w JOIN st ON contains(LOWER(st.item), w.word)
  UNION ALL SELECT np.id, 2, st.item, st.av FROM np JOIN cat USING (category) JOIN st ON st.item = cat.item)""",
       "rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY id, tier ORDER BY av DESC, item) AS r FROM cand)",
       f"tr AS (SELECT id, tier, {S('av * av', 9)} / {S('av', 9)} AS wv, COUNT(*) AS k FROM rk WHERE r <= 20 GROUP BY ALL)",
       "bt AS (SELECT id, ARG_MIN(wv, tier) AS wv, ARG_MIN(k, tier) AS k, MIN(tier) AS tier FROM tr GROUP BY id)",
       f"es AS (SELECT np.id, COALESCE(wv, (SELECT {M('av', 9)} FROM st)) * 0.7::DOUBLE AS e, COALESCE(k, 1) AS k, CASE tier WHEN 1 THEN 'keyword_match' WHEN 2 THEN 'category_match' ELSE 'global_median' END AS method FROM np LEFT JOIN bt USING (id))",
       "f AS (SELECT es.*, CAST((SELECT MAX(date) FROM all_sales) + CAST(j AS INTEGER) AS DATE) AS date FROM es, range(1, 8) t(j))",
       "p AS (SELECT *, e * CASE WHEN ISODOW(date) >= 6 THEN 0.8::DOUBLE WHEN ISODOW(date) = 5 THEN 1.1 ELSE 1.0 END AS pr FROM f)",
       "SELECT id, method, k AS similar_items, ROUND(e, 4) AS estimated_daily_demand, date, ROUND(pr, 4) AS predicted_quantity, ROUND(pr * 0.6, 4) AS lower_bound, ROUND(pr * 1.5, 4) AS upper_bound FROM p"))
def _(spark, sf):
    p = bindings.read(spark, sf, "part")
    second, first = F.split_part("p_name", F.lit(" "), F.lit(2)), F.split_part("p_name", F.lit(" "), F.lit(1))
    k = F.col("p_partkey") % 3
    name = F.when(k == 0, "Unseen thing").when(k == 1, F.concat(F.lit("Big "), second)).otherwise(F.concat(first, F.lit(" of xy")))
    new = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("category"), coldstart.keywords(name).alias("words"))
    cats = p.where(F.col("p_brand") != "Brand#2").select(F.col("p_brand").alias("category"), F.col("p_name").alias("item"))
    sales = bindings.all_sales(spark, sf)
    last = sales.agg(F.max("date").alias("d")).scalar()
    return coldstart.cold_start(new, coldstart.item_stats(coldstart.title_days(sales)), cats, F.date_add(last, 1))


@query("keyword_match", """WITH w AS (SELECT DISTINCT word FROM (SELECT UNNEST(list_filter(string_split(LOWER(p_name || ' ' || p_type), ' '), lambda x: len(x) > 2)[:5]) AS word FROM part)),
t AS (SELECT DISTINCT source || ' ' || lang || ' ' || p AS item FROM documents, (SELECT DISTINCT p_name AS p FROM part WHERE p_size = 7)) SELECT word, item FROM w JOIN t ON contains(LOWER(item), word)""".replace(
    "t AS (SELECT DISTINCT source || ' ' || lang || ' ' || p AS item FROM documents, (SELECT DISTINCT p_name AS p FROM part WHERE p_size = 7))", "t AS (SELECT p_partkey || ' ' || p_name || ' ' || p_brand AS item FROM part)"))
def _(spark, sf):
    p = bindings.read(spark, sf, "part")
    words = p.select(F.explode(coldstart.keywords(F.concat_ws(" ", "p_name", "p_type"))).alias("word"))
    titles = p.select(F.concat_ws(" ", F.col("p_partkey").cast("string"), "p_name", "p_brand").alias("item"))
    return coldstart.match_titles(words, titles)


@query("stock_status", Q("inv", "SELECT id, sku_id, quantity, threshold, CASE WHEN quantity <= threshold THEN 'LOW' ELSE 'OK' END AS stock_status FROM inv WHERE quantity IS NOT NULL"))
def _(spark, sf):
    return inventory.stock_status(p_joins._status(spark, sf)).select("id", "sku_id", "quantity", "threshold", "stock_status")


@query("low_stock_count", Q("inv", "SELECT COUNT(*) AS total_items, COUNT(*) FILTER (quantity < threshold) AS low_stock_count FROM inv"))
def _(spark, sf):
    return inventory.low_stock_count(p_joins._status(spark, sf))
