"""Streams run to the end of the data and compared with their batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.plans.p_ledger import RQ, _SEV, _ST, _STSQL
from larder.plans.registry import query
from larder.plans.sqlbase import S
from larder.sources import bindings
from larder.streaming import live, timed

#: The tables come in one file each and not in the order of time, so nothing may be late.
LATENESS = "3650 days"


@query("stream_today", """SELECT CAST(ts AS DATE) AS date, COUNT(*) AS total, COUNT(*) FILTER (event_type = 'purchase') AS completed, COUNT(*) FILTER (event_type IN ('click', 'view')) AS open,
  CAST(SUM(CAST(value AS DECIMAL(28,6))) FILTER (event_type = 'purchase') AS DOUBLE) AS revenue FROM events GROUP BY 1""")
def _(spark, sf):
    schema = bindings.read(spark, sf, "events").schema
    return live.drain(spark, live.day_summary(live.file_stream(spark, sf, "events.parquet", schema)))


@query("stream_demand", """SELECT CAST(o_orderdate AS DATE) AS date, l_linenumber AS item_id, SUM(l_quantity) AS quantity_sold, COUNT(DISTINCT l_orderkey) AS order_count
FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' GROUP BY ALL""")
def _(spark, sf):
    schema = bindings.read(spark, sf, "lineitem").schema
    lines = live.file_stream(spark, sf, "lineitem.parquet", schema).select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("item_id"), F.col("l_quantity").alias("quantity"))
    orders = bindings.read(spark, sf, "orders").where(F.col("o_orderstatus") == "F").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("ts"))
    return timed.run_demand(spark, lines, orders, LATENESS)


def event_stream(spark, sf):
    return live.file_stream(spark, sf, "events.parquet", bindings.read(spark, sf, "events").schema)


@query("stream_ledger", RQ(_SEV, "ingredient_id, location_id", "SELECT event_id, ingredient_id, location_id, quantity, quantity_before, quantity_after, accepted FROM led"))
def _(spark, sf):
    qty = (F.when(F.col("event_type") == "purchase", F.ceil("value")).when(F.col("event_type") == "signup", 0)
           .when(F.col("event_type") == "view", -F.floor(F.col("value") / 5)).otherwise(-F.floor(F.col("value") / 2)))
    adj = event_stream(spark, sf).select(F.col("user_id").alias("ingredient_id"), (F.col("event_id") % 2).alias("location_id"), "event_id", "ts", qty.alias("quantity"))
    return timed.run_ledger(spark, adj, LATENESS)


@query("stream_open_orders", f"""SELECT order_id, status, strftime(last_change, '%Y-%m-%d %H:%M:%S') AS last_change, CASE WHEN m >= 5 THEN 'red' WHEN m >= 2 THEN 'amber' ELSE 'normal' END AS tier
FROM (SELECT order_id, status, last_change, (epoch_us((SELECT MAX(ts) FROM events)) - epoch_us(last_change)) / 60000000 AS m FROM
  (SELECT user_id AS order_id, ARG_MAX({_STSQL}, event_id) AS status, MAX(ts) AS last_change FROM events GROUP BY 1)) WHERE status IN ('OPEN', 'IN_PROGRESS', 'READY')""")
def _(spark, sf):
    s = event_stream(spark, sf).select("event_id", "ts", F.col("user_id").alias("order_id"), F.create_map(*[F.lit(x) for kv in _ST.items() for x in kv])[F.col("event_type")].alias("status"))
    return timed.run_board(spark, s, ["OPEN", "IN_PROGRESS", "READY"], "0 seconds").withColumn("last_change", F.date_format("last_change", "yyyy-MM-dd HH:mm:ss"))
