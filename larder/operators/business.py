"""Business impact of a forecast against a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from larder.functions.exprs import exact_sum, over_part
from larder.operators.metrics import DAY_NAMES, WASTE_SHARE, WEIGHTS


def row_cost(pred: str, preset: str = "default", actual: str = "quantity_sold", price: str = "item_price") -> Column:
    """Weighted cost of one row; sums of it are the cost of any group."""
    w, s = WEIGHTS[preset]
    a, p = F.col(actual), F.col(pred)
    return (over_part(p, a) * (WASTE_SHARE * w) + over_part(a, p) * s) * F.col(price)


def cumulative_savings(df: DataFrame, baseline: str, model: str, preset: str = "default") -> DataFrame:
    """Daily costs with running totals; the window runs over one row per day."""
    daily = df.groupBy("date").agg(
        exact_sum(row_cost(baseline, preset)).alias("baseline_cost"), exact_sum(row_cost(model, preset)).alias("model_cost"))
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    running = lambda c: F.sum(F.col(c).cast("decimal(28,6)")).over(w).cast("double")
    return daily.withColumns({"baseline_cum": running("baseline_cost"), "model_cum": running("model_cost")}).withColumn(
        "savings_cum", F.col("baseline_cum") - F.col("model_cum"))


def group_savings(df: DataFrame, keys: list[str], baseline: str, model: str, preset: str = "default") -> DataFrame:
    return df.groupBy(*keys).agg(
        exact_sum(row_cost(baseline, preset)).alias("baseline_cost"), exact_sum(row_cost(model, preset)).alias("model_cost"),
        F.sum("quantity_sold").alias("total_demand")).withColumn("savings", F.col("baseline_cost") - F.col("model_cost"))


def business_impact(df: DataFrame, baseline: str, model: str, preset: str = "default", items: int = 15,
                    stores: int = 20) -> DataFrame:
    """Item savings, annualised store savings, weekday costs and the waterfall parts, as (section, name, value) rows."""
    from larder.operators.reports import stack_rows, top_rows
    rows = lambda d, section, name, value: d.select(F.lit(section).alias("section"), F.col(name).cast("string").alias("name"), F.col(value).alias("value"))
    by_item = top_rows(group_savings(df, ["item_id"], baseline, model, preset), [F.desc("savings"), F.asc("item_id")], items)
    days = df.agg(F.countDistinct("date").alias("n")).scalar()
    by_store = group_savings(df, ["store_name"], baseline, model, preset).withColumn("annual", F.col("savings") * (F.lit(365.0) / days))
    by_dow = group_savings(df, ["day_of_week"], baseline, model, preset).withColumn(
        "day", F.element_at(F.array(*[F.lit(d) for d in DAY_NAMES]), F.col("day_of_week") + 1))
    w, s = WEIGHTS[preset]
    a, b, m = F.col("quantity_sold"), F.col(baseline), F.col(model)
    price = F.col("item_price")
    parts = df.agg(
        exact_sum(over_part(b, a) * price * WASTE_SHARE).alias("bw"), exact_sum(over_part(a, b) * price).alias("bs"),
        exact_sum(over_part(m, a) * price * WASTE_SHARE).alias("mw"), exact_sum(over_part(a, m) * price).alias("ms"))
    fall = parts.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in {
            "baseline_total": F.col("bw") * w + F.col("bs") * s, "waste_reduction": F.col("bw") * w - F.col("mw") * w,
            "stockout_reduction": F.col("bs") * s - F.col("ms") * s, "model_total": F.col("mw") * w + F.col("ms") * s,
            "waste_reduction_pct": (1 - F.col("mw") / F.greatest(F.col("bw"), F.lit(1.0))) * 100}.items()])).alias("x")
    ).select(F.lit("waterfall").alias("section"), "x.name", "x.value")
    return stack_rows([
        rows(by_item, "item_savings", "item_id", "savings"),
        rows(top_rows(by_store, [F.desc("annual"), F.asc("store_name")], stores), "store_annual_savings", "store_name", "annual"),
        rows(by_dow, "weekday_baseline", "day", "baseline_cost"), rows(by_dow, "weekday_model", "day", "model_cost"), fall])


def savings_by_preset(df: DataFrame, models: dict[str, str]) -> DataFrame:
    """Models x presets: total cost of each model under each weighting, in one pass."""
    cells = {(m, p): exact_sum(row_cost(c, p)) for m, c in models.items() for p in WEIGHTS}
    one = df.agg(*[v.alias(f"{m}|{p}") for (m, p), v in cells.items()])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.lit(p).alias("preset"), F.col(f"`{m}|{p}`").alias("total_cost")) for m, p in cells])).alias("x")).select("x.*")
