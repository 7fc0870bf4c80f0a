"""Queries over helpers that have no other entry: projections, histories, stored predictions, bands, training rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions.exprs import exact_sum, rnd
from larder.operators import ledger, ml, projections
from larder.plans import frames, p_ledger
from larder.plans.p_ledger import RQ, _PEV, _SEV
from larder.plans.registry import query
from larder.plans.sqlbase import Q, S
from larder.session import scratch_path
from larder.sources import bindings, files


@query("catalog_summary", Q("items", "SELECT item_id AS id, item_name AS title, item_price AS price, item_type AS type FROM items"))
def _(spark, sf):
    return projections.catalog_summary(bindings.dim_items(spark, sf).withColumn("other", F.lit(1)))


@query("campaign_summary", """SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS type, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS start_date_time_dt,
  strftime(o_orderdate + INTERVAL 3 DAY, '%Y-%m-%d %H:%M:%S') AS end_date_time_dt, o_custkey AS place_id FROM orders WHERE o_orderpriority = '1-URGENT'""")
def _(spark, sf):
    o = bindings.read(spark, sf, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    day = F.col("o_orderdate").cast("timestamp_ntz")
    c = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("type"), F.col("o_custkey").alias("place_id"),
                 day.cast("string").alias("start_date_time"), (day + F.expr("INTERVAL 3 DAY")).cast("string").alias("end_date_time_dt"))
    return projections.campaign_summary(c).withColumns({f"{e}_date_time_dt": F.date_format(f"{e}_date_time_dt", "yyyy-MM-dd HH:mm:ss") for e in ("start", "end")})


@query("adjustment_history", RQ(_SEV, "ingredient_id, location_id", """SELECT event_id, ingredient_id, adjustment_type, quantity, quantity_before, quantity_after, c_name AS ingredient_name, n_name AS adjusted_by_name,
  (SELECT COUNT(*) FROM led WHERE adjustment_type = 'WASTE' AND location_id = 1) AS total FROM (SELECT * FROM led WHERE adjustment_type = 'WASTE' AND location_id = 1 ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 10) l
  LEFT JOIN customer ON c_custkey = ingredient_id LEFT JOIN nation ON n_nationkey = event_id % 30"""))
def _(spark, sf):
    led = ledger.stock_ledger(p_ledger.stock_events(spark, sf), ["ingredient_id", "location_id"]).withColumn("adjusted_by", F.col("event_id") % 30)
    ingredients = bindings.read(spark, sf, "customer").select(F.col("c_custkey").alias("ingredient_id"), F.col("c_name").alias("ingredient_name"))
    users = bindings.read(spark, sf, "nation").select(F.col("n_nationkey").alias("adjusted_by"), F.col("n_name").alias("adjusted_by_name"))
    return ledger.adjustment_history(led, ingredients, users, location=1, kind="WASTE", limit=50, offset=10).select(
        "event_id", "ingredient_id", "adjustment_type", "quantity", "quantity_before", "quantity_after", "ingredient_name", "adjusted_by_name", "total")


@query("points_history", RQ(_PEV, "member_id", """SELECT event_id, member_id, type, x AS change, quantity_after, accepted FROM led
  WHERE member_id = (SELECT MAX(user_id) FROM events) ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 2"""))
def _(spark, sf):
    led = ledger.points_ledger(p_ledger.point_events(spark, sf), *p_ledger.members(spark, sf))
    member = bindings.read(spark, sf, "events").agg(F.max("user_id").alias("m")).scalar()
    return ledger.history(led, "member_id", member, 20, 2).select("event_id", "member_id", "type", "change", "quantity_after", "accepted")


@query("stored_predictions", Q("pred", f"SELECT place_id, COUNT(*) AS n, {S('predicted')} AS predicted, {S('quantity_sold')} AS quantity_sold FROM pred GROUP BY place_id"))
def _(spark, sf):
    path = scratch_path(spark, "predictions")
    files.save_predictions(frames.predictions(spark, sf).select(*files.PREDICTION_COLUMNS), path)
    return files.load_predictions(spark, path).groupBy(F.col("place_id").cast("long").alias("place_id")).agg(
        F.count(F.lit(1)).alias("n"), exact_sum("predicted").alias("predicted"), exact_sum("quantity_sold").alias("quantity_sold"))


@query("forecast_band", Q("pred", f"e AS (SELECT SQRT({S('(quantity_sold - predicted) * (quantity_sold - predicted)')} / COUNT(*)) AS rmse FROM pred)",
       "SELECT date, place_id, item_id, ROUND(GREATEST(predicted - 1.645 * rmse, 0), 6) AS lower, ROUND(predicted + 1.645 * rmse, 6) AS upper FROM pred, e"))
def _(spark, sf):
    p = frames.predictions(spark, sf)
    error = F.col("quantity_sold") - F.col("predicted")
    rmse = p.agg(F.sqrt(exact_sum(error * error) / F.count(F.lit(1))).alias("r")).scalar()
    return ml.with_confidence(p, "predicted", rmse, 0.9).select("date", "place_id", "item_id", rnd("lower").alias("lower"), rnd("upper").alias("upper"))


@query("training_rows", Q("feats", """SELECT place_id, COUNT(*) FILTER (COALESCE(demand_lag_1d, demand_lag_7d, demand_lag_14d, demand_lag_28d) IS NOT NULL) AS known_lag,
  COUNT(*) FILTER (demand_lag_1d IS NOT NULL AND demand_lag_7d IS NOT NULL AND demand_lag_14d IS NOT NULL AND demand_lag_28d IS NOT NULL) AS all_lags FROM feats GROUP BY place_id"""))
def _(spark, sf):
    f = frames.features_frame(spark, sf).select("place_id", "item_id", "date", "quantity_sold", *ml.LAG_COLS)
    n = lambda df, name: df.groupBy("place_id").agg(F.count(F.lit(1)).alias(name))
    return n(ml.training_rows(f), "known_lag").join(n(ml.training_rows(f, dropna=True), "all_lags"), "place_id", "left")
