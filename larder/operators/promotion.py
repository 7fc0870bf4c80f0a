"""Slow movers, campaign lift, promotion suggestions, scenarios, coupons, strategy choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from larder.functions.exprs import exact_mean, exact_sum, rnd, rnd_even
from larder.functions.quantiles import exact_quantiles
from larder.operators.demand import SERIES, recent


def slow_movers(df: DataFrame, quantile: float = 0.25, actual: str = "quantity_sold") -> DataFrame:
    """Series whose mean demand lies at or below the quantile over all series."""
    n = F.count(actual)
    s = df.groupBy(*SERIES).agg(
        exact_mean(actual).alias("avg_daily_demand"), F.sum(actual).alias("total_demand"),
        F.count_if(F.col(actual) > 0).alias("days_with_sales"), n.alias("total_days"),
        F.min("item_name").alias("item_name"), F.min("store_name").alias("store_name"),
        (F.count_if(F.col(actual) > 0) / n).alias("sell_through_rate"))
    cut = exact_quantiles(s, "avg_daily_demand", {"t": quantile}).scalar()
    return s.where(F.col("avg_daily_demand") <= cut)


def campaign_lift(df: DataFrame, actual: str = "quantity_sold") -> DataFrame:
    """Demand with against without promotion per place; places with only one side are left out."""
    on = F.col("is_promotion_active") == 1
    s = df.groupBy("place_id").agg(
        F.min("store_name").alias("store_name"), exact_mean(F.when(on, F.col(actual))).alias("_p"),
        exact_mean(F.when(~on, F.col(actual))).alias("_n"), F.count_if(on).alias("promo_days"),
        F.count_if(~on).alias("non_promo_days")).where((F.col("promo_days") > 0) & (F.col("non_promo_days") > 0))
    lift = (F.col("_p") - F.col("_n")) / F.greatest(F.col("_n"), F.lit(0.01)) * 100
    return s.select("place_id", "store_name", rnd_even("_p", 2).alias("avg_demand_with_promo"),
                    rnd_even("_n", 2).alias("avg_demand_without_promo"), rnd_even(lift, 1).alias("demand_lift_pct"),
                    "promo_days", "non_promo_days")


def promo_suggestions(slow: DataFrame, risk: DataFrame) -> DataFrame:
    """Discount and priority of each slow mover from its waste risk and sell-through."""
    j = slow.join(risk.select(*SERIES, "waste_risk", "cv"), SERIES, "left")
    r = F.col("waste_risk")
    return j.withColumns({
        "suggested_discount_pct": F.when(r == "high", 25.0).when(r == "medium", 15.0)
        .when(F.col("sell_through_rate") < 0.2, 20.0).otherwise(10.0),
        "suggested_days": F.lit("Monday-Tuesday"),
        "priority": F.when(r == "high", 1).when(r == "medium", 2).otherwise(3)})


def promo_revenue_impact(suggestions: DataFrame, lift_pct: float = 30, price: float = 100, top: int = 10) -> DataFrame:
    q = F.col("avg_daily_demand")
    df = suggestions.withColumns({
        "current_daily_revenue": q * price, "boosted_demand": q * (1 + lift_pct / 100),
        "discounted_price": F.lit(float(price)) * (1 - F.col("suggested_discount_pct") / 100)})
    df = df.withColumn("new_daily_revenue", F.col("boosted_demand") * F.col("discounted_price")).withColumn(
        "daily_revenue_change", rnd(F.col("new_daily_revenue") - F.col("current_daily_revenue")))
    return df.orderBy(F.desc("daily_revenue_change"), *SERIES).limit(top).select(
        *SERIES, "current_daily_revenue", rnd("new_daily_revenue").alias("new_daily_revenue"), "daily_revenue_change",
        rnd(F.col("daily_revenue_change") * 30, 4).alias("monthly_revenue_change"))


# ---- scenarios ---------------------------------------------------------------------

ELASTICITY = 1.5  # fixed value


def item_baselines(daily: DataFrame, days: int = 30) -> DataFrame:
    """Totals, mean day and mean price per item over the last n days."""
    s = recent(daily, days).groupBy("item_title").agg(
        F.sum("total_quantity").alias("total_qty"), exact_sum("total_revenue", 2).alias("total_rev"),
        F.count(F.lit(1)).alias("active_days"))
    return s.withColumns({
        "avg_daily_qty": F.col("total_qty") / F.col("active_days"),
        "avg_price": F.col("total_rev") / F.when(F.col("total_qty") == 0, 1.0).otherwise(F.col("total_qty"))})


def scenario_impact(daily: DataFrame, scenarios: list[tuple[str, str, float, int]], days: int = 30) -> DataFrame:
    """Daily quantity and revenue change of each scenario.

    A scenario is (kind, word in the item title or '', percent, days); the list is
    an argument of a few rows, carried on each item row as an array.
    Kinds: discount, demand, removal, outage, new_item.
    """
    base = item_baselines(daily, days)
    arr = F.array(*[F.struct(F.lit(i).alias("no"), F.lit(k).alias("kind"), F.lit(w).alias("word"), F.lit(float(p)).alias("pct"),
                             F.lit(d).alias("days")) for i, (k, w, p, d) in enumerate(scenarios)])
    j = base.withColumn("s", F.explode(arr)).select("*", "s.*").where(
        (F.col("kind") != "new_item") & ((F.col("word") == "") | F.lower("item_title").contains(F.lower("word"))))
    q, p, x = F.col("avg_daily_qty"), F.col("avg_price"), F.col("pct") / 100
    new_q = (F.when(F.col("kind") == "discount", q * (1 + x * ELASTICITY)).when(F.col("kind") == "demand", q * (1 + x)).otherwise(0.0))
    new_p = F.when(F.col("kind") == "discount", p * (1 - x)).otherwise(p)
    old_rev = F.when(F.col("kind") == "removal", F.col("total_rev") / days).otherwise(q * p)
    rows = j.select("no", "kind", "days", (new_q - q).alias("dq"), (new_q * new_p - old_rev).alias("dr"))
    effects = rows.groupBy("no", "kind", "days").agg(
        F.count(F.lit(1)).alias("items"), exact_sum("dq").alias("daily_qty_change"), exact_sum("dr").alias("daily_revenue_change"))
    med = exact_quantiles(base, "avg_daily_qty", {"q": 0.5}).select(F.struct("q").alias("m")).scalar()
    med_p = exact_quantiles(base, "avg_price", {"p": 0.5}).select(F.struct("p").alias("m")).scalar()
    new = base.agg(F.count(F.lit(1)).alias("items")).withColumn("s", F.explode(F.filter(arr, lambda e: e["kind"] == "new_item")))
    new = new.select(F.col("s.no").alias("no"), F.col("s.kind").alias("kind"), F.col("s.days").alias("days"), "items",
                     med["q"].alias("_q"), med_p["p"].alias("_p")).select(
        "no", "kind", "days", "items", (F.col("_q") * 0.6).alias("daily_qty_change"), (F.col("_q") * 0.6 * F.col("_p")).alias("daily_revenue_change"))
    return effects.unionByName(new).select(
        "no", "kind", "items", rnd("daily_qty_change", 4).alias("daily_qty_change"),
        rnd("daily_revenue_change", 4).alias("daily_revenue_change"),
        rnd(F.col("daily_revenue_change") * F.col("days"), 4).alias("total_revenue_change"))


# ---- coupons -----------------------------------------------------------------------

def coupon_validity(uses: DataFrame, coupons: DataFrame) -> DataFrame:
    """Reason why a coupon cannot be used on an order, or NULL; codes are compared without case.

    The checks follow one order: unknown, inactive, early, late, used up, minimum,
    products, categories.
    """
    c = coupons.withColumn("_code", F.lower("code"))
    j = uses.withColumn("_code", F.lower("code")).drop("code").join(c, "_code", "left")
    listed = lambda arr: F.coalesce(F.size(arr), F.lit(0)) > 0
    reason = (
        F.when(F.col("is_active").isNull(), "Coupon not found").when(~F.col("is_active"), "Coupon is inactive")
        .when(F.col("valid_from") > F.col("now"), "Coupon is not yet valid").when(F.col("valid_until") < F.col("now"), "Coupon has expired")
        .when((F.col("max_uses") > 0) & (F.col("used_count") >= F.col("max_uses")), "Coupon usage limit reached")
        .when((F.col("min_order_amount") > 0) & (F.col("order_total") < F.col("min_order_amount")), "Minimum order amount")
        .when(listed("applicable_products") & ~F.arrays_overlap("product_ids", "applicable_products"), "Coupon not valid for these products")
        .when(listed("applicable_categories") & ~F.arrays_overlap("category_ids", "applicable_categories"), "Coupon not valid for these categories"))
    return j.withColumn("reason", reason).withColumn("is_valid", reason.isNull())


def coupon_usage(uses: DataFrame, coupons: DataFrame) -> DataFrame:
    """Use count per coupon added to the stored counter."""
    n = uses.groupBy(F.lower("code").alias("_code")).agg(F.count(F.lit(1)).alias("new_uses"))
    return coupons.withColumn("_code", F.lower("code")).join(n, "_code", "left").withColumn(
        "new_uses", F.coalesce("new_uses", F.lit(0))).withColumn("total_uses", F.col("used_count") + F.col("new_uses")).drop("_code")


# ---- strategy ----------------------------------------------------------------------

def strategy_choice(items: DataFrame, context: DataFrame) -> DataFrame:
    """Waste- or stockout-leaning forecast per item and day from counted rules, and the preparation quantity."""
    j = items.join(context, "date")
    one = lambda c: F.when(c, 1).otherwise(0)
    waste = sum([one(F.col("is_perishable")), one(F.col("is_monday") | (F.col("is_day_after_holiday") == 1)),
                 one(F.col("precip_probability") > 60), one(F.col("cv") > 0.8), one(F.col("days_since_payday") > 10)], F.lit(0))
    stock = sum([one(F.col("is_friday") | F.col("is_weekend") | (F.col("is_day_before_holiday") == 1)),
                 one(F.col("is_grilling_season") & (F.col("temperature_max") > 18)), one(F.col("is_payday_week")),
                 one(F.col("is_school_holiday")),
                 one(F.col("is_julefrokost_season") | F.col("is_christmas_season") | F.col("is_sankt_hans")),
                 one(F.col("severe_weather")), one(F.col("cv") < 0.3), one(F.col("is_top_seller"))], F.lit(0))
    chosen = F.when(stock > waste, "stockout_optimized").when(waste > stock, "waste_optimized").otherwise("balanced")
    base = F.col("avg_daily_demand")
    qty = F.when(stock > waste, base * 1.2).when(waste > stock, base * 0.85).otherwise(base)
    return j.withColumns({"waste_rules": waste, "stockout_rules": stock, "strategy": chosen,
                          "forecast": rnd(qty, 4), "prep_qty": F.ceil(F.round(qty + F.col("safety_stock"), 6)).cast("long")})
