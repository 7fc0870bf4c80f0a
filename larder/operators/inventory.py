"""Safety stock, preparation, waste, stock status, bill-of-materials demand, batches, purchase orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from larder.functions.exprs import clipped, col, exact_mean, exact_sum, over_part, rnd, rnd_even, top_per_group
from larder.operators.baselines import matches_any, risk_tier
from larder.operators.demand import SERIES
from larder.operators.metrics import WASTE_SHARE

Z95 = 1.65  # fixed value: 95 % service level


def safety_stock(std: str | Column, lead_days: float = 1, z: float = Z95) -> Column:
    return col(std) * z * F.sqrt(F.lit(float(lead_days)))


def reorder_point(mean: str | Column, safety: Column, lead_days: float = 1) -> Column:
    return col(mean) * float(lead_days) + safety


def _floor_std(std: Column) -> Column:
    return F.greatest(F.coalesce(std, F.lit(0.1)), F.lit(0.1))


def alert_level(cv: Column) -> Column:
    return F.when(cv > 0.8, "red").when(cv > 0.4, "yellow").otherwise("green")


def prep_recommendations(df: DataFrame, pred: str = "predicted", actual: str = "quantity_sold", z: float = Z95,
                         lead_days: float = 1) -> DataFrame:
    """Next preparation per series from its error deviation, mean demand and last forecast."""
    err = F.col(actual) - F.col(pred)
    std = F.round(F.when(F.count(F.lit(1)) > 7, F.stddev_samp(err)).otherwise(F.stddev_samp(actual)), 9)
    s = df.groupBy(*SERIES).agg(
        F.min("item_name").alias("item_name"), F.min("store_name").alias("store_name"), F.max("date").alias("date"),
        _floor_std(std).alias("_std"), exact_mean(actual).alias("_avg"), F.max_by(pred, "date").alias("_fc"))
    safety = safety_stock("_std", lead_days, z)
    cv = F.col("_std") / F.greatest(F.col("_avg"), F.lit(0.1))
    return s.select(
        *SERIES, "item_name", "store_name", "date", rnd_even("_fc", 1).alias("forecast_demand"),
        rnd_even(safety, 1).alias("safety_stock"),
        F.greatest(F.ceil(F.col("_fc") + safety), F.lit(0)).cast("long").alias("recommended_prep_qty"),
        rnd_even(reorder_point("_avg", safety, lead_days), 1).alias("reorder_point"),
        rnd_even("_avg", 1).alias("avg_daily_demand"), rnd_even("_std", 1).alias("demand_std"),
        alert_level(cv).alias("alert_level"))


def prep_schedule(df: DataFrame, pred: str = "predicted", actual: str = "quantity_sold", z: float = Z95) -> DataFrame:
    """Quantity to prepare for each row from the deviation of the last 14 days (at least 3), else of the series."""
    w = Window.partitionBy(*SERIES).orderBy("date").rowsBetween(-13, 0)
    recent = F.when(F.count(actual).over(w) >= 3, F.stddev_samp(actual).over(w))
    whole = F.stddev_samp(actual).over(Window.partitionBy(*SERIES))
    std = _floor_std(F.round(F.coalesce(recent, whole), 9))
    out = df.withColumn("_safety", safety_stock(std, 1, z))
    return out.select(
        "date", *SERIES, "item_name", "store_name", rnd_even(pred, 1).alias("forecast"),
        rnd_even("_safety", 1).alias("safety_stock"),
        F.greatest(F.ceil(F.col(pred) + F.col("_safety")), F.lit(0)).cast("long").alias("recommended_qty"))


DEFAULT_COST = 50.0  # fixed value, used where a series has no price


def waste_estimate(df: DataFrame, pred: str = "predicted", actual: str = "quantity_sold", cost: str = "item_price") -> DataFrame:
    """Units over and under per series with their rates and money."""
    a, p = F.col(actual), F.col(pred)
    s = df.groupBy(*SERIES).agg(
        F.min("item_name").alias("item_name"), F.min("store_name").alias("store_name"), F.sum(actual).alias("total_demand"),
        exact_sum(over_part(p, a)).alias("total_overstock_units"), exact_sum(over_part(a, p)).alias("total_understock_units"),
        F.coalesce(exact_mean(cost, 9), F.lit(DEFAULT_COST)).alias("_cost"))
    base = F.greatest(F.col("total_demand"), F.lit(1.0))
    return s.withColumns({
        "waste_rate": F.col("total_overstock_units") / base, "stockout_rate": F.col("total_understock_units") / base,
        "waste_cost_dkk": F.col("total_overstock_units") * F.col("_cost") * WASTE_SHARE,
        "lost_revenue_dkk": F.col("total_understock_units") * F.col("_cost")}).drop("_cost")


def waste_risk(df: DataFrame, perishable: list[str], actual: str = "quantity_sold") -> DataFrame:
    s = df.groupBy(*SERIES).agg(
        F.min("item_name").alias("item_name"), F.min("store_name").alias("store_name"),
        exact_mean(actual).alias("_avg"), F.round(F.stddev_samp(actual), 9).alias("_std"))
    cv = F.col("_std") / F.greatest(F.col("_avg"), F.lit(0.1))
    return s.select(*SERIES, "item_name", "store_name", rnd_even("_avg", 2).alias("avg_daily_demand"),
                    rnd_even("_std", 2).alias("demand_std"), rnd_even(cv, 3).alias("cv"), risk_tier(cv).alias("waste_risk"),
                    matches_any(F.col("item_name"), perishable).alias("is_perishable"))


def savings(naive: DataFrame, model: DataFrame) -> DataFrame:
    """Waste and revenue gained by the model forecast over the naive one, per series."""
    cols = ["waste_cost_dkk", "lost_revenue_dkk"]
    n = naive.select(*SERIES, *[F.col(c).alias(f"{c}_naive") for c in cols])
    m = model.select(*SERIES, *[F.col(c).alias(f"{c}_ml") for c in cols])
    return n.join(m, SERIES).withColumns({
        "waste_savings_dkk": F.col("waste_cost_dkk_naive") - F.col("waste_cost_dkk_ml"),
        "revenue_recovery_dkk": F.col("lost_revenue_dkk_naive") - F.col("lost_revenue_dkk_ml")}).withColumn(
        "total_savings_dkk", F.col("waste_savings_dkk") + F.col("revenue_recovery_dkk"))


# ---- stock -------------------------------------------------------------------------

def low_stock(status: DataFrame, limit: int = 50, strict: bool = False) -> DataFrame:
    q, t = F.col("quantity"), F.col("threshold")
    hit = status.where((t > 0) & ((q < t) if strict else (q <= t)))
    return hit.withColumn("stock_ratio", F.round(q / t, 2)).orderBy("stock_ratio", "id").limit(limit)


def days_of_stock(status: DataFrame, sales: DataFrame, limit: int = 30) -> DataFrame:
    """Stock over mean sales per active day, titles compared without case; soonest first."""
    rate = sales.groupBy(F.lower("title").alias("_t")).agg((F.sum("quantity") / F.countDistinct("date")).alias("avg_daily_sales"))
    j = status.where(F.col("quantity") > 0).withColumn("_t", F.lower("title")).join(rate.where(F.col("avg_daily_sales") > 0), "_t")
    return j.withColumn("days_of_stock", F.round(F.col("quantity") / F.col("avg_daily_sales"), 4)).select(
        "id", "title", "quantity", "unit", "category", "avg_daily_sales", "days_of_stock").orderBy("days_of_stock", "id").limit(limit)


def inventory_query(status: DataFrame, category: str | None = None, limit: int = 50) -> DataFrame:
    df = status.where(F.col("sku_id").isNotNull())
    if category:
        df = df.where(F.lower("category").contains(category.lower()))
    return df.orderBy(F.asc_nulls_last("quantity"), "id").limit(limit)


def stock_list(status: DataFrame, search: str | None = None, category: str | None = None, low_only: bool = False) -> DataFrame:
    """Stock with optional search, category and low-stock filter; unknown quantity counts as 0."""
    df = status.withColumn("quantity", F.coalesce("quantity", F.lit(0.0)))
    if search:
        df = df.where(F.lower("title").contains(search.lower()))
    if category:
        df = df.where(F.col("category") == category)
    if low_only:
        df = df.where(F.col("quantity") <= F.col("threshold"))
    return df


def reorder_simple(tail: DataFrame, mean: str, lead_days: int = 3) -> DataFrame:
    """Demand over the lead time plus half of it, rounded up."""
    need = F.col(mean) * lead_days
    return tail.withColumn("reorder_point", F.ceil(need + need * 0.5).cast("long"))


# ---- bill of materials -------------------------------------------------------------

def _exploded(product_demand: DataFrame, products: DataFrame, skus: DataFrame, bom: DataFrame) -> DataFrame:
    """(sku_id, product, demand): forecast of each product on its stock units, composites through their parts.

    Equal titles map to the product with the largest id, as the last of a listing.
    """
    ids = products.groupBy(F.lower("title").alias("_t")).agg(F.max("id").alias("item_id"))
    s = skus.select(F.col("id").alias("sku_id"), "item_id", "type")
    linked = product_demand.select(F.lower("item_name").alias("_t"), F.col("item_name").alias("product"), "demand").join(ids, "_t").join(s, "item_id")
    # only composites go through their parts; a plain unit with parts of its own still counts once
    parts = bom.join(skus.where(F.col("type") == "composite").select(F.col("id").alias("parent_sku_id")), "parent_sku_id", "left_semi").select(
        F.col("parent_sku_id").alias("sku_id"), F.col("sku_id").alias("_child"), F.col("quantity").alias("_per"))
    both = linked.join(parts, "sku_id", "left")
    through = F.col("_child").isNotNull()
    return both.select(
        F.when(through, F.col("_child")).otherwise(F.col("sku_id")).alias("sku_id"), "product",
        F.when(through, F.col("demand") * F.col("_per")).otherwise(F.col("demand")).alias("demand"))


def ingredient_drivers(product_demand, products, skus, bom) -> DataFrame:
    """Which products drive the demand of each stock unit, one row per pair."""
    return _exploded(product_demand, products, skus, bom).groupBy("sku_id", "product").agg(exact_sum("demand").alias("demand"))


def ingredient_demand(product_demand: DataFrame, products: DataFrame, skus: DataFrame, bom: DataFrame, days: int) -> DataFrame:
    """Demand, daily rate, days left, urgency and reorder quantity of every stock unit."""
    need = ingredient_drivers(product_demand, products, skus, bom).groupBy("sku_id").agg(
        exact_sum("demand").alias("_d"), F.count(F.lit(1)).alias("_k"))
    j = skus.withColumnRenamed("id", "sku_id").join(need, "sku_id", "left")
    demand = F.coalesce("_d", F.lit(0.0))
    stock, low = F.coalesce("quantity", F.lit(0.0)), F.coalesce("low_stock_threshold", F.lit(0.0))
    j = j.withColumns({"_demand": demand, "_stock": stock, "_low": low}).withColumn("_rate", F.col("_demand") / float(days))
    left = F.when(F.col("_rate") > 0, F.col("_stock") / F.when(F.col("_rate") > 0, F.col("_rate"))).otherwise(999.0)
    j = j.withColumn("_left", left)
    urgency = (F.when(F.col("_left") < 2, "critical").when(F.col("_left") < days, "soon")
               .when(F.col("_stock") < F.col("_low"), "low_stock").otherwise("ok"))
    reorder = F.when(F.col("_rate") > 0, F.greatest(F.col("_rate") * days * 1.5 - F.col("_stock"), F.lit(0.0))).otherwise(0.0)
    return j.select(
        "sku_id", F.col("title").alias("ingredient"), "unit", "type", rnd("_stock", 2).alias("current_stock"),
        rnd("_demand", 2).alias("forecasted_demand"), rnd("_rate", 2).alias("daily_consumption_rate"),
        rnd(F.least("_left", F.lit(999.0)), 1).alias("days_of_stock_remaining"), F.col("_low").alias("low_stock_threshold"),
        ((F.col("_stock") < F.col("_low")) | ((F.col("_rate") > 0) & (F.col("_left") < days))).alias("needs_reorder"),
        urgency.alias("reorder_urgency"), rnd(reorder, 2).alias("suggested_reorder_qty"),
        F.coalesce("_k", F.lit(0)).alias("driver_count"))


URGENCY = {"critical": 0, "soon": 1, "low_stock": 2, "ok": 3}  # fixed values


def by_urgency(df: DataFrame) -> DataFrame:
    order = F.create_map(*[F.lit(x) for kv in URGENCY.items() for x in kv])
    return df.orderBy(order[F.col("reorder_urgency")], F.desc("forecasted_demand"), "sku_id")


def recipe_cost(edges: DataFrame, costs: DataFrame, recipes: DataFrame) -> DataFrame:
    """Cost and share of each ingredient, cost per serving, margin. Totals come from a
    pre-aggregated join, so a recipe with very many lines stays spread."""
    lines = edges.join(costs, "sku_id", "left").withColumn("cost_per_unit", F.coalesce("cost_per_unit", F.lit(0.0))).withColumn(
        "cost", F.col("quantity") * F.col("cost_per_unit"))
    totals = lines.groupBy("recipe_id").agg(exact_sum("cost").alias("total_cost"))
    per = F.when(F.col("yield_quantity") > 0, F.col("total_cost") / F.col("yield_quantity")).otherwise(0.0)
    j = lines.join(totals, "recipe_id").join(recipes, "recipe_id").withColumn("cost_per_serving", per)
    return j.select(
        "recipe_id", "sku_id", "quantity", "cost_per_unit", "cost", "total_cost",
        F.when(F.col("total_cost") > 0, F.col("cost") / F.col("total_cost") * 100).otherwise(0.0).alias("share_pct"),
        "cost_per_serving", "selling_price",
        F.when(F.col("selling_price") > 0, (F.col("selling_price") - F.col("cost_per_serving")) / F.col("selling_price") * 100)
        .otherwise(0.0).alias("profit_margin"))


# ---- batches -----------------------------------------------------------------------

def open_batches(batches: DataFrame, as_of, days: int | None = None) -> DataFrame:
    """Undisposed batches with days to expiry; with ``days`` those that expire within them."""
    left = F.datediff("expiry_date", F.lit(as_of).cast("date"))
    df = batches.where(~F.col("disposed") & (F.col("quantity") > 0)).withColumn("days_until_expiry", left)
    if days is not None:
        df = df.where(F.col("days_until_expiry").between(0, days))
    return df


def expiring_recipes(expiring: DataFrame, edges: DataFrame) -> DataFrame:
    """Recipes that use expiring ingredients: servings they allow and the nearest expiry; most urgent first."""
    stock = expiring.groupBy("sku_id").agg(F.sum("quantity").alias("_q"), F.min("days_until_expiry").alias("_d"))
    used = edges.join(stock, "sku_id")
    return used.groupBy("recipe_id").agg(
        F.count(F.lit(1)).alias("expiring_ingredients"),
        F.min(F.floor(F.col("_q") / F.col("quantity"))).alias("max_servings"), F.min("_d").alias("urgency")
    ).orderBy("urgency", F.desc("max_servings"), "recipe_id")


def purchase_orders(lines: DataFrame) -> DataFrame:
    """Order total of line amounts rounded to whole units, and whether every line was received in full."""
    return lines.groupBy("po_id").agg(
        F.count(F.lit(1)).alias("order_lines"), exact_sum(F.round(F.col("quantity") * F.col("unit_cost")), 0).alias("total_amount"),
        F.bool_and(F.col("received") >= F.col("quantity")).alias("fully_received"))


def order_repricing(orders: DataFrame, lines: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Totals from catalog prices beside the stored ones, and the lines of unknown products.

    Orders with an unknown product are rejected as a whole.
    """
    priced = lines.join(products.select("product_id", F.col("price").alias("_price")), "product_id", "left")
    unknown = priced.where(F.col("_price").isNull()).drop("_price")
    per = priced.groupBy("order_id").agg(
        exact_sum((F.col("_price") + F.col("modifiers")) * F.col("quantity"), 4).alias("subtotal"),
        F.count_if(F.col("_price").isNull()).alias("_unknown")).where(F.col("_unknown") == 0).drop("_unknown")
    total = F.col("subtotal") - F.col("discount_amount") + F.col("tax_amount") + F.col("tip_amount")
    audit = orders.join(per, "order_id").withColumn("total", total).withColumn("difference", F.round(F.col("total") - F.col("stored_total"), 2))
    return audit, unknown


def stock_status(status: DataFrame) -> DataFrame:
    """LOW or OK per tracked item; untracked items are left out."""
    q, t = F.col("quantity"), F.col("threshold")
    return status.where(q.isNotNull()).withColumn("stock_status", F.when(q <= t, "LOW").otherwise("OK"))


def low_stock_count(status: DataFrame) -> DataFrame:
    """Items, and how many of them lie strictly below their threshold."""
    return status.agg(F.count(F.lit(1)).alias("total_items"), F.count_if(F.col("quantity") < F.col("threshold")).alias("low_stock_count"))
