"""Binding of the star-schema test tables to the retail model.

Operators take column names as they come from here; nothing else in the
package knows the source tables. Two grains exist: ``region`` x ``type`` gives
dense series, ``nation`` x ``brand`` many sparse ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from larder.functions.exprs import dealt_join, exact_mean, task_count

STATUS = {"F": "Closed", "O": "Open", "P": "Pending"}  # fixed values


_SCHEMAS: dict[str, T.StructType] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table; its schema is inferred once per path, later reads skip the footer job."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def status_name(c) -> F.Column:
    return F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])[c]


def places_of_customers(spark, sf_dir, grain: str = "region") -> DataFrame:
    c, n = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    key = "n_regionkey" if grain == "region" else "n_nationkey"
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").alias("user_id"), F.col(key).cast("long").alias("place_id"))


def fct_orders(spark, sf_dir, grain: str = "region") -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.join(places_of_customers(spark, sf_dir, grain), o.o_custkey == F.col("user_id")).select(
        F.col("o_orderkey").alias("id"), "user_id", "place_id",
        F.col("o_orderdate").alias("created_dt"),
        status_name(F.col("o_orderstatus")).alias("status"),
        F.col("o_orderpriority").alias("channel"),
        F.col("o_totalprice").alias("total_amount"))


def fct_order_items(spark, sf_dir, grain: str = "region") -> DataFrame:
    l, p = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    item = "p_type" if grain == "region" else "p_brand"
    return l.join(p, l.l_partkey == p.p_partkey).select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"),
        F.col(item).alias("item_id"), F.col("p_name").alias("title"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("cost"),
        F.col("l_discount").alias("discount"), F.col("p_retailprice").alias("price"))


_TASKS: dict[tuple[str, str], int | None] = {}


def line_tasks(spark, sf_dir) -> int | None:
    """Tasks for joins of order lines by order, from the row count in the file footers."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TASKS:
        _TASKS[key] = task_count(read(spark, sf_dir, "lineitem"))
    return _TASKS[key]


def dim_items(spark, sf_dir, grain: str = "region") -> DataFrame:
    item = "p_type" if grain == "region" else "p_brand"
    return read(spark, sf_dir, "part").groupBy(F.col(item).alias("id")).agg(
        F.min("p_name").alias("title"), exact_mean("p_retailprice", 2).alias("price"),
        F.max("p_brand").alias("type"))


def dim_places(spark, sf_dir, grain: str = "region") -> DataFrame:
    if grain == "region":
        return read(spark, sf_dir, "region").select(
            F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("title"))
    return read(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("title"))


def campaigns(spark, sf_dir) -> DataFrame:
    """Campaigns: every urgent closed order opens an interval at its place."""
    o = fct_orders(spark, sf_dir).where((F.col("channel") == "1-URGENT") & (F.col("status") == "Closed"))
    start = F.to_date("created_dt")
    return o.select(
        F.col("id").alias("campaign_id"), "place_id",
        start.alias("start_date"),
        F.date_add(start, (F.col("id") % 5 - 1).cast("int")).alias("end_date"),
        ((F.col("id") % 4 + 1) * 5).cast("double").alias("discount"),
        F.element_at(F.array(F.lit("percent"), F.lit("amount"), F.lit("bundle")),
                     (F.col("id") % 3 + 1).cast("int")).alias("type"))


def retail_tables(spark, sf_dir, grain: str = "region") -> dict[str, DataFrame]:
    return {
        "fct_orders": fct_orders(spark, sf_dir, grain),
        "fct_order_items": fct_order_items(spark, sf_dir, grain),
        "dim_items": dim_items(spark, sf_dir, grain),
        "dim_places": dim_places(spark, sf_dir, grain),
    }


def products(spark, sf_dir) -> DataFrame:
    """Single products (one per part) with a status, as the menu sees them."""
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("category"),
        F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"),
        F.when(F.col("p_size") > 10, "Active").when(F.col("p_size") > 5, "Inactive").alias("status"))


def skus(spark, sf_dir) -> DataFrame:
    """Stock units: most products have one; promo products are composites of others."""
    p = read(spark, sf_dir, "part").where(F.col("p_size") <= 45)
    return p.select(
        (F.col("p_partkey") + 1000000).alias("id"), F.col("p_partkey").alias("item_id"),
        F.regexp_extract("p_brand", "([0-9]+)", 1).cast("long").alias("stock_category_id"),
        F.concat(F.lit("stock "), "p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("title"),
        F.when(F.col("p_size") % 9 != 0, F.col("p_size") * 3.0).alias("quantity"),
        F.when(F.col("p_size") % 7 != 0, F.lit(60.0)).alias("low_stock_threshold"),
        F.when(F.col("p_type") == "PROMO", "composite").otherwise("normal").alias("type"),
        F.when(F.col("p_size") % 2 == 0, "kg").otherwise("pcs").alias("unit"))


def stock_categories(spark, sf_dir) -> DataFrame:
    """One row per brand, without the first one, so some stock units lack a category."""
    b = read(spark, sf_dir, "part").select("p_brand").distinct().where(F.col("p_brand") != "Brand#1")
    return b.select(F.regexp_extract("p_brand", "([0-9]+)", 1).cast("long").alias("id"), F.col("p_brand").alias("title"))


def bill_of_materials(spark, sf_dir) -> DataFrame:
    """Each composite uses the next three part numbers."""
    s = skus(spark, sf_dir).where(F.col("type") == "composite")
    return s.select(F.col("id").alias("parent_sku_id"), F.posexplode(F.array(*[F.col("id") + k for k in (1, 2, 3)])).alias("pos", "sku_id")).select(
        "parent_sku_id", "sku_id", ((F.col("pos") + 1) / 2).alias("quantity"))


def all_sales(spark, sf_dir) -> DataFrame:
    """Lines of all orders, whatever their status, with customer nation as place."""
    o = read(spark, sf_dir, "orders").join(
        places_of_customers(spark, sf_dir, "nation"), F.col("o_custkey") == F.col("user_id")).select(
        F.col("o_orderkey").alias("order_id"), "place_id", F.to_date("o_orderdate").alias("date"))
    return dealt_join(fct_order_items(spark, sf_dir), o, "order_id", line_tasks(spark, sf_dir))


def weather(spark, sf_dir) -> DataFrame:
    """Daily weather stand-in from event values, for some days of the event month."""
    e = read(spark, sf_dir, "events").where(F.to_date("ts") != F.lit("2024-01-10").cast("date"))
    return e.groupBy(F.to_date("ts").alias("date")).agg(
        exact_mean("value").alias("temperature_max"), F.min("value").alias("temperature_min"),
        (F.count_if(F.col("event_type") == "error") / 64).alias("precipitation_mm"),
        (F.count(F.lit(1)) % 100).alias("weather_code"),
        F.sum(F.when(F.col("event_type") == "view", 100).otherwise(0)).alias("sunshine_s"),
        (F.count_if(F.col("event_type") == "click")).alias("precip_probability"))


def weather_by_order_day(spark, sf_dir) -> DataFrame:
    """Daily weather stand-in over the order days, derived from order counts and customer keys."""
    o = read(spark, sf_dir, "orders")
    n, s = F.count(F.lit(1)), F.sum("o_custkey")
    return o.groupBy(F.to_date("o_orderdate").alias("date")).agg(
        (n * 5 % 31).cast("double").alias("temperature_max"), (n * 5 % 31 - 8).cast("double").alias("temperature_min"),
        ((s % 37) / 10).alias("precipitation_mm"), (s % 100).alias("precip_probability"),
        F.nullif(s % 100, F.lit(50)).alias("weather_code"), (s % 40000).alias("sunshine_s"),
        (n % 13 == 0).alias("severe_weather"))


def opening_hours(spark, sf_dir) -> DataFrame:
    """Places with opening hours as JSON text: good, empty, broken and missing ones."""
    text = {
        0: '{"monday": {"from": "closed", "to": "closed"}, "tuesday": {"from": "10.00", "to": "20.30"}}',
        1: "", 2: "not json {", 3: '{"saturday": {"from": "closed"}, "sunday": {"from": "closed"}}'}
    m = F.create_map(*[F.lit(x) for kv in text.items() for x in kv])
    return dim_places(spark, sf_dir).select(F.col("id").alias("place_id"), F.try_element_at(m, F.col("id").cast("int")).alias("opening_hours"))
