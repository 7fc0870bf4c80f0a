"""Report and exploration aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions.exprs import exact_mean, exact_sum, rnd, rnd_even
from larder.operators import baselines, cleaning, demand, joins, metrics, promo, reports
from larder.plans import frames
from larder.plans.p_demand import MODELS, PERISHABLE, _HIST, _LONG, _PERISH_SQL
from larder.plans.registry import ORACLES, query
from larder.plans.sqlbase import CTES, M, Q, S
from larder.sources import bindings

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _orders(spark, sf):
    return bindings.read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("type"), F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("total_amount"))


@query("daily_sales", Q("all_sales", f"""SELECT date, title AS item_title, SUM(quantity) AS total_quantity,
  {S('quantity * price', 2)} AS total_revenue, COUNT(DISTINCT order_id) AS order_count FROM all_sales GROUP BY ALL"""))
def _(spark, sf):
    return bindings.all_sales(spark, sf).groupBy("date", F.col("title").alias("item_title")).agg(
        F.sum("quantity").alias("total_quantity"), exact_sum(F.col("quantity") * F.col("price"), 2).alias("total_revenue"),
        F.countDistinct("order_id").alias("order_count"))


@query("item_daily_demand", Q("sales", "SELECT COALESCE(NULLIF(title, 'red widget'), 'Unknown Item') AS item_name, date, SUM(quantity) AS quantity_sold FROM sales GROUP BY ALL"))
def _(spark, sf):
    return demand.item_daily_demand(frames.sales(spark, sf).withColumn("title", F.nullif(F.col("title"), F.lit("red widget"))))


@query("sales_for_forecast", Q("all_sales", """SELECT title AS item, place_id, date, SUM(quantity) AS quantity_sold FROM all_sales
WHERE place_id = 3 AND title IN (SELECT title FROM all_sales WHERE place_id = 3 GROUP BY title ORDER BY SUM(quantity) DESC, title LIMIT 12) GROUP BY ALL"""))
def _(spark, sf):
    top = joins.top_title_semi(bindings.all_sales(spark, sf), 12, 3)
    return top.groupBy(F.col("title").alias("item"), "place_id", "date").agg(F.sum("quantity").alias("quantity_sold"))


@query("sales_history", Q("all_sales", f"""SELECT date, title, SUM(quantity) AS quantity, ROUND({S('cost', 2)}, 2) AS revenue, COUNT(DISTINCT order_id) AS orders
FROM all_sales WHERE date >= (SELECT MAX(date) FROM all_sales) - 30 GROUP BY ALL ORDER BY date DESC, quantity DESC, title LIMIT 200"""))
def _(spark, sf):
    return reports.sales_history(bindings.all_sales(spark, sf), 30)


@query("top_sellers", Q("all_sales", f"""SELECT title, SUM(quantity) AS quantity, {S('cost', 2)} AS revenue, COUNT(DISTINCT order_id) AS orders
FROM all_sales WHERE date >= (SELECT MAX(date) FROM all_sales) - 90 GROUP BY title ORDER BY revenue DESC, title LIMIT 10"""))
def _(spark, sf):
    return reports.top_sellers(bindings.all_sales(spark, sf), 90, 10, "revenue")


@query("order_stats", f"""SELECT COUNT(*) AS total_orders, COUNT(*) FILTER (o_orderstatus = 'F') AS completed, COUNT(*) FILTER (o_orderstatus = 'P') AS cancelled,
  CAST(SUM(CAST(o_totalprice AS DECIMAL(28,2))) FILTER (o_orderstatus = 'F') AS DOUBLE) AS revenue,
  CAST(SUM(CAST(o_totalprice AS DECIMAL(28,2))) FILTER (o_orderstatus = 'F') AS DOUBLE) / COUNT(*) FILTER (o_orderstatus = 'F') AS avg_order_value,
  {', '.join(f"COUNT(*) FILTER (o_orderpriority = '{p}') AS type_{i}" for i, p in enumerate(PRIORITIES))} FROM orders""")
def _(spark, sf):
    return reports.order_stats(_orders(spark, sf), PRIORITIES)


@query("today_summary", """SELECT date, COUNT(*) AS total, COUNT(*) FILTER (s = 'F') AS completed, COUNT(*) FILTER (s = 'O') AS open,
  COALESCE(CAST(SUM(CAST(v AS DECIMAL(28,2))) FILTER (s = 'F') AS DOUBLE), 0) AS revenue,
  COALESCE(CAST(SUM(CAST(v AS DECIMAL(28,2))) FILTER (s = 'F') AS DOUBLE) / NULLIF(COUNT(*) FILTER (s = 'F'), 0), 0) AS average_ticket
FROM (SELECT CAST(o_orderdate AS DATE) AS date, o_orderstatus AS s, o_totalprice AS v FROM orders) WHERE date = (SELECT MAX(CAST(o_orderdate AS DATE)) FROM orders) GROUP BY date""")
def _(spark, sf):
    return reports.today_summary(_orders(spark, sf))


@query("status_breakdown", """SELECT v.k AS position, v.s AS status, (SELECT COUNT(*) FROM orders WHERE o_orderstatus = v.s) AS orders
FROM (VALUES (0, 'O'), (1, 'X'), (2, 'P'), (3, 'F')) v(k, s)""")
def _(spark, sf):
    return reports.status_breakdown(_orders(spark, sf), ["O", "X", "P", "F"])


@query("inventory_stats", Q("inv products", f"""x AS (SELECT COALESCE(inv.quantity, 0) AS q, COALESCE(inv.threshold, 10) AS low,
  COALESCE(CASE WHEN p.category <> 'PROMO' THEN p.price * 0.5::DOUBLE END, p.price) AS c FROM inv JOIN products p ON p.id = inv.id)""",
  f"""SELECT COUNT(*) AS items, {S('q')} AS total_quantity, COUNT(*) FILTER (q <= 0) AS out_of_stock, COUNT(*) FILTER (q > 0 AND q <= low) AS low_stock,
  {S('q * c', 4)} AS stock_value FROM x"""))
def _(spark, sf):
    p = bindings.products(spark, sf)
    stock = joins.inventory_status(p, bindings.skus(spark, sf), bindings.stock_categories(spark, sf)).join(
        p.select("id", "price", F.when(F.col("category") != "PROMO", F.col("price") * 0.5).alias("cost")), "id")
    return reports.inventory_stats(stock)


@query("customer_stats", """WITH f AS (SELECT o_custkey AS u, MIN(CAST(o_orderdate AS DATE)) AS first, CAST(SUM(CAST(o_totalprice AS DECIMAL(28,2))) AS DOUBLE) AS spent FROM orders GROUP BY 1)
SELECT 'total' AS metric, NULL AS customer, CAST(COUNT(*) AS DOUBLE) AS value FROM f
UNION ALL SELECT 'new', NULL, CAST(COUNT(*) AS DOUBLE) FROM f WHERE first >= DATE '1995-01-01' AND first < DATE '1995-02-01'
UNION ALL (SELECT 'top', u, spent FROM f ORDER BY spent DESC, u LIMIT 5)""")
def _(spark, sf):
    f = _orders(spark, sf).groupBy("user_id").agg(F.min("date").alias("first"), exact_sum("total_amount", 2).alias("spent"))
    none = F.lit(None).cast("long")
    month = F.date_trunc("month", "first").cast("date") == F.lit("1995-01-01").cast("date")
    one = f.agg(F.count(F.lit(1)).cast("double").alias("total"), F.count_if(month).cast("double").alias("new"))
    head = one.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), none.alias("customer"), F.col(m).alias("value")) for m in ("total", "new")])).alias("x")).select("x.*")
    top = reports.top_rows(f, [F.desc("spent"), F.asc("user_id")], 5)
    return head.unionByName(top.select(F.lit("top").alias("metric"), F.col("user_id").alias("customer"), F.col("spent").alias("value")))


@query("platform_stats", """SELECT 'orders' AS entity, o_orderstatus AS status, COUNT(*) AS n FROM orders GROUP BY 2
UNION ALL SELECT 'customers', c_mktsegment, COUNT(*) FROM customer GROUP BY 2 UNION ALL SELECT 'suppliers', CASE WHEN s_acctbal < 0 THEN 'debt' ELSE 'ok' END, COUNT(*) FROM supplier GROUP BY 2
UNION ALL SELECT 'orders_7d', 'all', COUNT(*) FROM orders WHERE CAST(o_orderdate AS DATE) >= (SELECT MAX(CAST(o_orderdate AS DATE)) FROM orders) - 7""")
def _(spark, sf):
    o = _orders(spark, sf)
    by = lambda df, name, c: df.groupBy(c.alias("status")).agg(F.count(F.lit(1)).alias("n")).withColumn("entity", F.lit(name))
    week = demand.recent(o, 7).agg(F.count(F.lit(1)).alias("n")).select(F.lit("all").alias("status"), "n", F.lit("orders_7d").alias("entity"))
    return reports.stack_rows([
        by(o, "orders", F.col("status")), by(bindings.read(spark, sf, "customer"), "customers", F.col("c_mktsegment")),
        by(bindings.read(spark, sf, "supplier"), "suppliers", F.when(F.col("s_acctbal") < 0, "debt").otherwise("ok")), week])


@query("recent_revenue", f"""SELECT user_id, COUNT(*) AS orders, {S('o_totalprice', 2)} AS recent_revenue FROM (SELECT o_custkey AS user_id, o_totalprice,
  ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn <= 30 GROUP BY user_id""")
def _(spark, sf):
    return reports.recent_revenue(_orders(spark, sf), "user_id", 30)


@query("category_counts", "SELECT COALESCE(NULLIF(p_type, 'LARGE'), 'OTHER') AS category, COUNT(*) AS n FROM part GROUP BY 1")
def _(spark, sf):
    p = bindings.read(spark, sf, "part").withColumn("c", F.nullif(F.col("p_type"), F.lit("LARGE")))
    return p.groupBy(F.coalesce("c", F.lit("OTHER")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("top_menu_items", Q("all_sales", f"""SELECT title, COUNT(*) AS order_count, SUM(quantity) AS total_qty, ROUND({M('price', 2)}, 2) AS avg_price
FROM all_sales GROUP BY title ORDER BY total_qty DESC, title LIMIT 40"""))
def _(spark, sf):
    t = bindings.all_sales(spark, sf).groupBy("title").agg(
        F.count(F.lit(1)).alias("order_count"), F.sum("quantity").alias("total_qty"), F.round(exact_mean("price", 2), 2).alias("avg_price"))
    return reports.top_rows(t, [F.desc("total_qty"), F.asc("title")], 40)


@query("recent_30d", Q("sales", _HIST[0], "r AS (SELECT * FROM d WHERE date >= (SELECT MAX(date) FROM d) - 30)",
       "p AS (SELECT date, SUM(quantity_sold) AS q FROM r GROUP BY date)",
       f"""SELECT 'avg_daily' AS metric, '' AS item, {M('q')} AS value FROM p UNION ALL SELECT 'total', '', SUM(q) FROM p
UNION ALL SELECT 'days', '', CAST(COUNT(*) AS DOUBLE) FROM p
UNION ALL (SELECT 'top', item_name, SUM(quantity_sold) AS v FROM r GROUP BY item_name ORDER BY v DESC, item_name LIMIT 15)"""))
def _(spark, sf):
    return reports.recent_summary(demand.item_daily_demand(frames.sales(spark, sf)))


@query("wow_trend", Q("all_sales", "d AS (SELECT title AS item_name, date, SUM(quantity) AS quantity_sold FROM all_sales GROUP BY ALL)",
       "m AS (SELECT MAX(date) AS hi FROM d)",
       """w AS (SELECT item_name, SUM(quantity_sold) FILTER (date >= hi - 14 AND date < hi - 7) AS prev, COALESCE(SUM(quantity_sold) FILTER (date >= hi - 7), 0) AS curr FROM d, m GROUP BY 1)""",
       """SELECT item_name, prev, curr, (curr - prev) / prev * 100 AS change_pct, CASE WHEN (curr - prev) / prev * 100 > 30 THEN 'up'
  WHEN (curr - prev) / prev * 100 < -30 THEN 'down' ELSE 'flat' END AS trend FROM w WHERE prev > 5"""))
def _(spark, sf):
    return reports.wow_trend(demand.item_daily_demand(bindings.all_sales(spark, sf)))


def _roll(p, label):
    return f"SELECT '{p}' AS freq, CAST({label} AS DATE) AS period, {S('quantity_sold')} AS quantity_sold, {S('predicted')} AS predicted FROM pred GROUP BY 2"


@query("period_rollup", Q("pred", _roll("D", "date") + " UNION ALL " + _roll("W", "date_trunc('week', date) + INTERVAL 6 DAY")
                          + " UNION ALL " + _roll("M", "last_day(date)")))
def _(spark, sf):
    p = frames.predictions(spark, sf).select("date", "quantity_sold", "predicted")
    return reports.stack_rows([demand.period_rollup(p, f, ["quantity_sold", "predicted"]).withColumn("freq", F.lit(f)) for f in "DWM"])


@query("overview_kpis", Q("", "o AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS date, c_nationkey AS p, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F')",
       f"dd AS (SELECT date, COUNT(*) AS n FROM o GROUP BY date)",
       f"SELECT (SELECT COUNT(*) FROM o) AS orders, (SELECT {S('v', 2)} FROM o) AS revenue, (SELECT {M('n')} FROM dd) AS avg_daily_orders, (SELECT COUNT(DISTINCT p) FROM o) AS stores"))
def _(spark, sf):
    o = frames.orders(spark, sf, "nation")
    mean = o.groupBy(F.to_date("created_dt").alias("date")).agg(F.count(F.lit(1)).alias("n")).agg(exact_mean("n").alias("m")).scalar()
    return o.agg(F.count(F.lit(1)).alias("orders"), exact_sum("total_amount", 2).alias("revenue"),
                 F.countDistinct("place_id").alias("stores")).withColumn("avg_daily_orders", mean)


@query("demand_by_dim", Q("pred", f"""SELECT 'date' AS dim, CAST(date AS VARCHAR) AS key, SUM(quantity_sold) AS quantity, {S('predicted')} AS predicted FROM pred GROUP BY date
UNION ALL SELECT 'store', store_name, SUM(quantity_sold), {S('predicted')} FROM pred GROUP BY store_name
UNION ALL (SELECT 'item', item_id, SUM(quantity_sold) AS q, {S('predicted')} FROM pred GROUP BY item_id ORDER BY q DESC, item_id LIMIT 4)"""))
def _(spark, sf):
    p = frames.predictions(spark, sf)
    by = lambda dim, c: p.groupBy(F.col(c).cast("string").alias("key")).agg(
        F.sum("quantity_sold").alias("quantity"), exact_sum("predicted").alias("predicted")).withColumn("dim", F.lit(dim))
    return reports.stack_rows([by("date", "date"), by("store", "store_name"),
                               reports.top_rows(by("item", "item_id"), [F.desc("quantity"), F.asc("key")], 4)])


@query("dow_month_pivot", Q("grid", "SELECT ISODOW(date) - 1 AS day_of_week, " + ", ".join(
    f"{M(f'CASE WHEN MONTH(date) = {m} THEN quantity_sold END')} AS m{m}" for m in range(1, 13)) + " FROM grid GROUP BY 1"))
def _(spark, sf):
    g = frames.grid(spark, sf)
    out = g.groupBy(F.weekday("date").alias("day_of_week")).pivot("month", list(range(1, 13))) if "month" in g.columns else \
        g.withColumn("month", F.month("date")).groupBy(F.weekday("date").alias("day_of_week")).pivot("month", list(range(1, 13)))
    out = out.agg(exact_mean("quantity_sold"))
    return out.toDF("day_of_week", *[f"m{m}" for m in range(1, 13)])


def _promo_grid(spark, sf):
    cal = promo.promo_calendar(frames.campaign_days(spark, sf)).select("date", "place_id", "is_promotion_active")
    return frames.grid(spark, sf).join(cal, ["date", "place_id"], "left").withColumn(
        "is_promotion_active", F.coalesce("is_promotion_active", F.lit(0)))


CTES["pgrid"] = (["grid", "promo_cal"], """SELECT grid.*, COALESCE(c.is_promotion_active, 0) AS is_promotion_active FROM grid
LEFT JOIN promo_cal c ON c.date = grid.date AND c.place_id = grid.place_id""")


@query("promo_split", Q("pgrid", f"SELECT is_promotion_active, {M('quantity_sold')} AS mean, ROUND(STDDEV_SAMP(quantity_sold), 6) AS std, COUNT(*) AS n FROM pgrid GROUP BY 1"))
def _(spark, sf):
    return _promo_grid(spark, sf).groupBy("is_promotion_active").agg(
        exact_mean("quantity_sold").alias("mean"), rnd(F.stddev_samp("quantity_sold")).alias("std"), F.count(F.lit(1)).alias("n"))


@query("demand_summary", Q("daily_nb", f"""SELECT place_id, item_id, {M('quantity_sold')} AS mean, ROUND(STDDEV_SAMP(quantity_sold), 6) AS std, SUM(quantity_sold) AS total
FROM daily_nb GROUP BY ALL ORDER BY total DESC, place_id, item_id LIMIT 30"""))
def _(spark, sf):
    s = frames.daily(spark, sf, "nation").groupBy("place_id", "item_id").agg(
        exact_mean("quantity_sold").alias("mean"), rnd(F.stddev_samp("quantity_sold")).alias("std"), F.sum("quantity_sold").alias("total"))
    return reports.top_rows(s, [F.desc("total"), F.asc("place_id"), F.asc("item_id")], 30)


@query("orders_daily", f"SELECT CAST(o_orderdate AS DATE) AS date, COUNT(*) AS orders, {S('o_totalprice', 2)} AS revenue FROM orders GROUP BY 1")
def _(spark, sf):
    return _orders(spark, sf).groupBy("date").agg(F.count(F.lit(1)).alias("orders"), exact_sum("total_amount", 2).alias("revenue"))


@query("value_counts", """SELECT 'type' AS "column", COALESCE(NULLIF(o_orderpriority, '5-LOW'), 'Unknown') AS value, COUNT(*) AS n FROM orders GROUP BY 2
UNION ALL SELECT 'status', o_orderstatus, COUNT(*) FROM orders GROUP BY 2""")
def _(spark, sf):
    return reports.value_counts(_orders(spark, sf).withColumn("type", F.nullif(F.col("type"), F.lit("5-LOW"))), ["type", "status"])


@query("item_totals", f"""WITH t AS (SELECT l_partkey AS item_id, SUM(l_quantity) AS quantity, {S('l_extendedprice', 2)} AS revenue,
  ARG_MIN(p_name, l_orderkey * 100 + l_linenumber) AS title FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
(SELECT 'quantity' AS ranking, * FROM t ORDER BY quantity DESC, item_id LIMIT 20) UNION ALL (SELECT 'revenue', * FROM t ORDER BY revenue DESC, item_id LIMIT 20)""")
def _(spark, sf):
    l = bindings.read(spark, sf, "lineitem").join(bindings.read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    t = l.groupBy(F.col("l_partkey").alias("item_id")).agg(
        F.sum("l_quantity").alias("quantity"), exact_sum("l_extendedprice", 2).alias("revenue"),
        F.min_by("p_name", F.struct("l_orderkey", "l_linenumber")).alias("title"))
    return reports.stack_rows([reports.top_rows(t, [F.desc(k), F.asc("item_id")], 20).withColumn("ranking", F.lit(k)) for k in ("quantity", "revenue")])


_LP = ["l_quantity", "l_extendedprice", "l_discount"]


@query("numeric_profile", f"""SELECT metric, COUNT(value) AS n, {M('value')} AS mean, CAST(MIN(d) AS DATE) AS first_date, CAST(MAX(d) AS DATE) AS last_date,
  quantile_cont(value, 0.5) AS median FROM (SELECT l_shipdate AS d, UNNEST(['l_quantity', 'l_extendedprice', 'l_discount']) AS metric,
  UNNEST([l_quantity, l_extendedprice, l_discount]) AS value FROM lineitem) GROUP BY metric""")
def _(spark, sf):
    return reports.numeric_profile(bindings.read(spark, sf, "lineitem"), _LP, "l_shipdate")


def _iqr_sql(table, col, m):
    return (f"SELECT '{col}' AS metric, ROUND(lo, 6) AS lower, ROUND(hi, 6) AS upper, COUNT(*) FILTER ({col} BETWEEN lo AND hi) AS inliers, "
            f"COUNT(*) FILTER (NOT {col} BETWEEN lo AND hi) AS outliers, CAST(SUM(CAST({col} AS DECIMAL(28,2))) FILTER ({col} BETWEEN lo AND hi) AS DOUBLE) AS inlier_total "
            f"FROM {table}, (SELECT q1 - {m}::DOUBLE * (q3 - q1) AS lo, q3 + {m}::DOUBLE * (q3 - q1) AS hi FROM "
            f"(SELECT quantile_cont({col}, 0.25) AS q1, quantile_cont({col}, 0.75) AS q3 FROM {table})) GROUP BY lo, hi")


@query("iqr_filter", " UNION ALL ".join([_iqr_sql("orders", "o_totalprice", 0.2), _iqr_sql("lineitem", "l_quantity", 0.25), _iqr_sql("lineitem", "l_extendedprice", 3.0)]))
def _(spark, sf):
    return reports.stack_rows([
        reports.iqr_summary(bindings.read(spark, sf, table), c, m).withColumns({x: rnd(x) for x in ("lower", "upper")})
        for table, c, m in (("orders", "o_totalprice", 0.2), ("lineitem", "l_quantity", 0.25), ("lineitem", "l_extendedprice", 3.0))])


@query("sample_rows", """SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
WHERE CAST('0x' || substr(md5('42-' || l_orderkey || '-' || l_linenumber), 1, 8) AS BIGINT) % 10000 < 200""")
def _(spark, sf):
    return reports.sample_rows(bindings.read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], 0.02, 42).select(
        "l_orderkey", "l_linenumber", "l_extendedprice")


@query("seasonality_counts", """SELECT 'weekday' AS kind, ISODOW(o_orderdate) - 1 AS bucket, COUNT(*) AS orders FROM orders GROUP BY 2
UNION ALL SELECT 'month', MONTH(o_orderdate), COUNT(*) FROM orders GROUP BY 2""")
def _(spark, sf):
    o = _orders(spark, sf)
    by = lambda kind, c: o.groupBy(c.alias("bucket")).agg(F.count(F.lit(1)).alias("orders")).withColumn("kind", F.lit(kind))
    return by("weekday", F.weekday("date")).unionByName(by("month", F.month("date")))


_LINE_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                 "l_returnflag", "l_linestatus", "l_shipdate", "d"]


@query("dq_summary", """SELECT COUNT(*) AS rows, COUNT(l_orderkey) - COUNT(DISTINCT l_orderkey) AS duplicate_ids, CAST(MIN(l_shipdate) AS DATE) AS first_date,
  CAST(MAX(l_shipdate) AS DATE) AS last_date, COUNT(DISTINCT l_returnflag) AS statuses, """ + ", ".join(
    f"COUNT(*) FILTER ({c} IS NULL) AS {c}_nulls" for c in _LINE_COLUMNS) + " FROM (SELECT *, NULLIF(l_discount, 0.05) AS d FROM lineitem)")
def _(spark, sf):
    l = bindings.read(spark, sf, "lineitem").withColumn("d", F.nullif(F.col("l_discount"), F.lit(0.05)))
    return reports.dq_summary(l, "l_orderkey", "l_shipdate", "l_returnflag")


_CORR = ["demand_lag_1d", "demand_lag_7d", "demand_lag_28d", "rolling_mean_7d", "rolling_mean_30d", "rolling_std_14d", "expanding_mean"]


@query("feature_corr", Q("feats", " UNION ALL ".join(f"SELECT '{c}' AS feature, ROUND(CORR(quantity_sold, {c}), 6) AS correlation FROM feats" for c in _CORR)))
def _(spark, sf):
    return reports.feature_correlations(frames.features_frame(spark, sf), "quantity_sold", _CORR).withColumn("correlation", rnd("correlation"))


@query("describe_table")
def _(spark, sf):
    return bindings.read(spark, sf, "orders").summary()


@query("eligible_items", Q("sales", _HIST[0], "SELECT item_name, SUM(quantity_sold) AS total_demand, COUNT(DISTINCT date) AS active_days FROM d GROUP BY 1 HAVING SUM(quantity_sold) >= 6000 AND COUNT(DISTINCT date) >= 200"))
def _(spark, sf):
    return demand.eligible_items(demand.item_daily_demand(frames.sales(spark, sf)), 6000, 200)


@query("model_leaderboard", Q("pred", _LONG, f"ps AS (SELECT model, place_id, item_id, {S('ABS(quantity_sold - pred)')} / COUNT(*) AS mae FROM long GROUP BY ALL)",
       "w AS (SELECT model, COUNT(*) AS series_won FROM (SELECT place_id, item_id, model, ROW_NUMBER() OVER (PARTITION BY place_id, item_id ORDER BY mae, model) AS r FROM ps) WHERE r = 1 GROUP BY model)",
       """r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY model ORDER BY mae, place_id, item_id) AS b, ROW_NUMBER() OVER (PARTITION BY model ORDER BY mae DESC, place_id DESC, item_id DESC) AS z FROM ps)""",
       """SELECT r.model, ROUND(AVG(mae), 6) AS mean_mae, ROUND(STDDEV_SAMP(mae), 6) AS std_mae, COUNT(*) FILTER (mae < 1) / COUNT(*) * 100 AS share_under_1,
  COUNT(*) FILTER (mae < 2) / COUNT(*) * 100 AS share_under_2, MAX(CASE WHEN b = 1 THEN place_id || '/' || item_id END) AS best_series,
  MAX(CASE WHEN z = 1 THEN place_id || '/' || item_id END) AS worst_series, COALESCE(MAX(w.series_won), 0) AS series_won FROM r LEFT JOIN w ON w.model = r.model GROUP BY r.model"""))
def _(spark, sf):
    long = metrics.long_models(frames.predictions(spark, sf), MODELS)
    per = long.groupBy("model", "place_id", "item_id").agg((exact_sum(F.abs(F.col("quantity_sold") - F.col("pred"))) / F.count(F.lit(1))).alias("mae"))
    return reports.model_leaderboard(per)


@query("similar_item_stats", Q("all_sales", "d AS (SELECT title AS item, date, SUM(quantity) AS qty FROM all_sales GROUP BY ALL)",
       f"""SELECT item, {M('qty')} AS avg_daily, ROUND(STDDEV_SAMP(qty), 6) AS std_daily, ROUND(quantile_cont(qty, 0.25), 6) AS p25, ROUND(quantile_cont(qty, 0.75), 6) AS p75,
  COUNT(*) AS active_days, MAX(date) AS last_sale FROM d GROUP BY item HAVING COUNT(*) >= 5"""))
def _(spark, sf):
    from larder.operators import coldstart
    return coldstart.item_stats(coldstart.title_days(bindings.all_sales(spark, sf))).withColumns(
        {c: rnd(c) for c in ("std_daily", "p25", "p75")})


# ---- forecast boards ---------------------------------------------------------------

CTES["hd"] = (["sales"], "SELECT title AS item_name, date, SUM(quantity) AS quantity_sold FROM sales GROUP BY ALL")
_fc_sql = ORACLES["fc_history"]


def forecasts(spark, sf, days=7):
    return baselines.history_forecast(demand.item_daily_demand(frames.sales(spark, sf)), days, PERISHABLE)


def FC(select: str) -> str:
    return f"WITH fc AS ({_fc_sql}) {select}"


_ITEMS = f"""ib AS (SELECT item_name, MIN(CASE demand_risk WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) AS r, BOOL_OR(is_perishable) AS per,
  {M('predicted_quantity')} AS av, {S('predicted_quantity')} AS tot, {M('upper_bound - lower_bound')} AS sp FROM fc GROUP BY 1)"""


@query("forecast_board", f"""WITH fc AS ({_fc_sql}), {_ITEMS} SELECT COUNT(*) AS items, {S('tot')} AS total_demand, COUNT(*) FILTER (r = 0) AS high_risk,
  COUNT(*) FILTER (r = 1) AS medium_risk, COUNT(*) FILTER (r = 2) AS low_risk, COUNT(*) FILTER (per) AS perishables FROM ib""")
def _(spark, sf):
    return reports.board_summary(forecasts(spark, sf))


@query("forecast_trend", f"""WITH fc AS ({_fc_sql}), n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY item_name ORDER BY date) <= COUNT(*) OVER (PARTITION BY item_name) // 2 AS f FROM fc),
h AS (SELECT item_name, {M('CASE WHEN f THEN predicted_quantity END')} AS avg_first, {M('CASE WHEN NOT f THEN predicted_quantity END')} AS avg_second FROM n GROUP BY 1),
c AS (SELECT *, ROUND(CASE WHEN avg_first > 0 THEN (avg_second - avg_first) / avg_first * 100 ELSE 0 END, 6) AS change_pct FROM h)
SELECT * FROM c WHERE ABS(change_pct) > 5 ORDER BY ABS(change_pct) DESC, item_name LIMIT 6""")
def _(spark, sf):
    return reports.forecast_trend(forecasts(spark, sf))


@query("forecast_insights", f"""WITH fc AS ({_fc_sql}), {_ITEMS}, pd AS (SELECT date, {S('predicted_quantity')} AS q FROM fc GROUP BY date)
(SELECT 'peak_day' AS kind, CAST(date AS VARCHAR) AS name, q AS value FROM pd ORDER BY q DESC, date LIMIT 1)
UNION ALL (SELECT 'slowest_day', CAST(date AS VARCHAR), q FROM pd ORDER BY q, date LIMIT 1)
UNION ALL (SELECT 'volatile', item_name, ROUND(sp / av, 6) AS v FROM ib WHERE ROUND(sp / av, 6) > 0.5 ORDER BY v DESC, item_name LIMIT 5)
UNION ALL (SELECT 'prep', item_name, CAST(CEIL(predicted_quantity) AS DOUBLE) FROM fc WHERE date = (SELECT MIN(date) FROM fc))""")
def _(spark, sf):
    return reports.forecast_insights(forecasts(spark, sf))


@query("topn_forecast", f"""WITH fc AS ({_fc_sql}) SELECT * FROM fc WHERE item_name IN (SELECT item_name FROM fc GROUP BY 1 ORDER BY {S('ABS(predicted_quantity)')} DESC, item_name LIMIT 8)""")
def _(spark, sf):
    fc = forecasts(spark, sf)
    top = reports.top_rows(fc.groupBy("item_name").agg(exact_sum(F.abs("predicted_quantity")).alias("_q")), [F.desc("_q"), F.asc("item_name")], 8)
    return fc.join(top, "item_name", "left_semi")


@query("cumulative_savings", Q("pred", f"d AS (SELECT date, {S('(GREATEST(ma28 - quantity_sold, 0) * 0.3::DOUBLE + GREATEST(quantity_sold - ma28, 0) * 1.5::DOUBLE) * item_price')} AS baseline_cost, "
       f"{S('(GREATEST(predicted - quantity_sold, 0) * 0.3::DOUBLE + GREATEST(quantity_sold - predicted, 0) * 1.5::DOUBLE) * item_price')} AS model_cost FROM pred GROUP BY date)",
       """SELECT date, baseline_cost, model_cost, ROUND(CAST(SUM(CAST(baseline_cost AS DECIMAL(28,6))) OVER (ORDER BY date) AS DOUBLE), 2) AS baseline_cum, ROUND(CAST(SUM(CAST(model_cost AS DECIMAL(28,6))) OVER (ORDER BY date) AS DOUBLE), 2) AS model_cum,
  ROUND(CAST(SUM(CAST(baseline_cost AS DECIMAL(28,6))) OVER (ORDER BY date) AS DOUBLE) - CAST(SUM(CAST(model_cost AS DECIMAL(28,6))) OVER (ORDER BY date) AS DOUBLE), 2) AS savings_cum FROM d"""))
def _(spark, sf):
    from larder.operators import business
    out = business.cumulative_savings(frames.predictions(spark, sf), "ma28", "predicted")
    return out.withColumns({c: rnd(c, 2) for c in ("baseline_cum", "model_cum", "savings_cum")})


@query("table_stats", """SELECT COUNT(*) AS total, COUNT(*) FILTER (s = 0) AS available, COUNT(*) FILTER (s = 1) AS occupied, COUNT(*) FILTER (s = 2) AS reserved,
  COUNT(*) FILTER (s = 3) AS dirty, CAST(SUM(c) AS BIGINT) AS total_capacity, COUNT(*) FILTER (s = 1) * 100.0::DOUBLE / COUNT(*) AS occupancy_rate
FROM (SELECT s_nationkey % 5 AS s, s_suppkey % 8 + 2 AS c FROM supplier)""")
def _(spark, sf):
    s = bindings.read(spark, sf, "supplier")
    names = F.array(*[F.lit(x) for x in ("AVAILABLE", "OCCUPIED", "RESERVED", "DIRTY", "CLOSED")])
    return reports.table_stats(s.select(names[F.col("s_nationkey") % 5].alias("status"), (F.col("s_suppkey") % 8 + 2).alias("capacity")))


@query("live_order_items", """SELECT o_orderkey, l_linenumber, l_partkey, l_quantity, CAST(o_orderdate AS DATE) AS created FROM lineitem JOIN orders ON o_orderkey = l_orderkey
ORDER BY o_orderdate DESC, o_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_quantity DESC LIMIT 5000""")
def _(spark, sf):
    o = bindings.read(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("created"))
    l = bindings.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_quantity")
    j = l.join(o, "o_orderkey").withColumn("tie", F.struct("o_orderkey", "l_linenumber", "l_partkey", "l_quantity"))
    return reports.latest_rows(j, "created", "tie").drop("tie")
