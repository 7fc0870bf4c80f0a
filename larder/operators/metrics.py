"""Forecast-quality and business-cost metrics as plain aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from larder.functions.exprs import clipped, col, exact_mean, exact_sum, finite, over_part, ratio

WASTE_SHARE = 0.3  # fixed value
DEFAULT_PRICE = 75.0  # fixed value
WEIGHTS = {"default": (1.0, 1.5), "balanced": (1.0, 1.0), "profit": (1.0, 2.0), "sustainability": (2.0, 1.0)}
DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def _apc(actual, pred, price):
    a, p = finite(actual), finite(pred)
    c = clipped(finite(F.coalesce(col(price).cast("double"), F.lit(DEFAULT_PRICE)))) if price is not None else F.lit(DEFAULT_PRICE)
    return a, p, c


def waste_cost(actual, pred, price) -> Column:
    a, p, c = _apc(actual, pred, price)
    return exact_sum(over_part(p, a) * c * WASTE_SHARE)


def stockout_cost(actual, pred, price) -> Column:
    a, p, c = _apc(actual, pred, price)
    return exact_sum(over_part(a, p) * c)


def weighted_cost(waste: Column, stockout: Column, preset: str = "default") -> Column:
    w, s = WEIGHTS[preset]
    return waste * w + stockout * s


def quality(actual="quantity_sold", pred="predicted") -> dict[str, Column]:
    """MAE, RMSE, MAPE over positive actuals, WMAPE and accuracy."""
    a, p, _ = _apc(actual, pred, None)
    err = F.abs(a - p)
    n = F.count(F.lit(1))
    w = F.coalesce(F.try_divide(exact_sum(err), exact_sum(a)) * 100, F.lit(0.0))
    wmape = F.when(exact_sum(a) == 0, F.lit(0.0)).otherwise(w)
    return {
        "mae": exact_sum(err) / n,
        "rmse": F.sqrt(exact_sum((a - p) * (a - p)) / n),
        "mape": F.coalesce(exact_mean(F.when(a > 0, err / F.when(a > 0, a)), 9) * 100, F.lit(0.0)),
        "wmape": wmape,
        "forecast_accuracy_pct": F.greatest(F.lit(0.0), F.lit(100.0) - wmape),
    }


def costs(actual="quantity_sold", pred="predicted", price="item_price", preset: str = "default") -> dict[str, Column]:
    w, s = waste_cost(actual, pred, price), stockout_cost(actual, pred, price)
    return {"waste_cost_dkk": w, "stockout_cost_dkk": s, "total_business_cost_dkk": weighted_cost(w, s, preset)}


def volumes(actual="quantity_sold", pred="predicted") -> dict[str, Column]:
    a, p, _ = _apc(actual, pred, None)
    n = F.count(F.lit(1))
    return {
        "total_actual_demand": exact_sum(a), "total_predicted": exact_sum(p),
        "overstock_units": exact_sum(over_part(p, a)), "understock_units": exact_sum(over_part(a, p)),
        "overstock_days_pct": F.count_if(p > a) / n * 100, "understock_days_pct": F.count_if(p < a) / n * 100,
        "n_samples": n,
    }


def named(cols: dict[str, Column]) -> list[Column]:
    return [c.alias(k) for k, c in cols.items()]


def evaluate_predictions(df: DataFrame, keys: list[str] = (), actual="quantity_sold", pred="predicted",
                         price="item_price") -> DataFrame:
    """All overall metrics; with keys one row per group. One pass, partial aggregates."""
    m = {**quality(actual, pred), **costs(actual, pred, price), **volumes(actual, pred)}
    return df.groupBy(*keys).agg(*named(m))


def extended_metrics(df: DataFrame, keys: list[str] = (), actual="quantity_sold", pred="predicted") -> DataFrame:
    """R2, stock-out and overstock rates, unit totals and the two MAPE variants."""
    a, p, _ = _apc(actual, pred, None)
    n, sa = F.count(F.lit(1)), exact_sum(a)
    sse, sst = exact_sum((a - p) * (a - p)), exact_sum(a * a) - sa * sa / n
    return df.groupBy(*keys).agg(*named({
        "r2": 1 - F.try_divide(sse, sst),
        "stockout_rate": F.count_if(p < a) / n, "overstock_rate": F.count_if(p > a) / n,
        "shortage_units": exact_sum(over_part(a, p)), "waste_units": exact_sum(over_part(p, a)),
        "mape_nonzero": exact_mean(F.when(a != 0, F.abs((a - p) / F.when(a != 0, a))), 9) * 100,
        "mape_floor1": exact_sum(F.abs(a - p) / F.greatest(a, F.lit(1.0)), 9) / n * 100,
    }))


def long_models(df: DataFrame, models: dict[str, str]) -> DataFrame:
    """One row per input row and model; the model list is a fixed array, no join."""
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("pred")) for m, c in models.items()])
    keep = [c for c in df.columns if c not in models.values()]
    return df.select(*keep, F.explode(pairs).alias("_x")).select(*keep, "_x.model", "_x.pred")


def compare_models(df: DataFrame, models: dict[str, str], actual="quantity_sold", price="item_price") -> DataFrame:
    """Per model: errors, costs and savings against the costliest model."""
    q = quality(actual, "pred")
    w, s = waste_cost(actual, "pred", price), stockout_cost(actual, "pred", price)
    v = volumes(actual, "pred")
    per = long_models(df, models).groupBy("model").agg(*named({
        "mae": q["mae"], "wmape": q["wmape"], "forecast_accuracy_pct": q["forecast_accuracy_pct"],
        "waste_cost_dkk": w, "stockout_cost_dkk": s, "total_cost_dkk": weighted_cost(w, s),
        "overstock_units": v["overstock_units"], "understock_units": v["understock_units"]}))
    worst = per.agg(F.max("total_cost_dkk").alias("w")).scalar()
    return per.withColumn("savings_vs_worst_dkk", worst - F.col("total_cost_dkk")).withColumn(
        "savings_vs_worst_pct", F.try_divide(F.col("savings_vs_worst_dkk"), worst) * 100)


def evaluate_by_store(df: DataFrame, **kw) -> DataFrame:
    m = {**quality(**_sub(kw)), **costs(**kw)}
    return df.groupBy("place_id").agg(F.min("store_name").alias("store_name"), *named({
        **{k: m[k] for k in ("mae", "wmape", "forecast_accuracy_pct", "waste_cost_dkk", "stockout_cost_dkk")},
        "total_cost_dkk": m["total_business_cost_dkk"],
        "total_demand": exact_sum("quantity_sold"), "n_samples": F.count(F.lit(1))}))


def evaluate_by_dow(df: DataFrame, **kw) -> DataFrame:
    m = {**quality(**_sub(kw)), **costs(**kw)}
    return df.groupBy("day_of_week").agg(*named(
        {k: m[k] for k in ("mae", "wmape", "forecast_accuracy_pct", "waste_cost_dkk", "stockout_cost_dkk")})
    ).withColumn("day_name", F.element_at(F.array(*[F.lit(d) for d in DAY_NAMES]), F.col("day_of_week") + 1))


def _sub(kw: dict) -> dict:
    return {k: v for k, v in kw.items() if k in ("actual", "pred")}


def business_summary(comparison: DataFrame, test_days: int | Column) -> DataFrame:
    """Best against worst model, annualised from ``test_days`` days: a number, or a scalar such as the distinct days."""
    best = F.min_by(F.struct(*comparison.columns), F.struct("total_cost_dkk", "model"))
    worst = F.max_by(F.struct(*comparison.columns), F.struct("total_cost_dkk", "model"))
    f = F.lit(365.0) / F.greatest(F.lit(test_days) if isinstance(test_days, int) else test_days, F.lit(1))
    x = comparison.agg(best.alias("b"), worst.alias("w"))
    diff = lambda c: F.col(f"w.{c}") - F.col(f"b.{c}")
    cut = lambda c: (1 - F.col(f"b.{c}") / F.greatest(F.col(f"w.{c}"), F.lit(1.0))) * 100
    return x.select(
        F.col("b.model").alias("best_model"), F.col("w.model").alias("worst_model"),
        F.col("b.forecast_accuracy_pct").alias("best_forecast_accuracy"), F.col("b.wmape").alias("best_wmape"),
        (diff("waste_cost_dkk") * f).alias("annual_waste_reduction_dkk"),
        (diff("stockout_cost_dkk") * f).alias("annual_stockout_reduction_dkk"),
        (diff("total_cost_dkk") * f).alias("annual_total_savings_dkk"),
        cut("waste_cost_dkk").alias("waste_reduction_pct"), cut("stockout_cost_dkk").alias("stockout_reduction_pct"))


def cost_presets(df: DataFrame, actual="quantity_sold", pred="predicted", price="item_price") -> DataFrame:
    """Waste, stock-out and weighted cost under each weight preset."""
    w, s = waste_cost(actual, pred, price), stockout_cost(actual, pred, price)
    one = df.agg(w.alias("waste_cost_dkk"), s.alias("stockout_cost_dkk"))
    presets = F.array(*[F.struct(F.lit(k).alias("preset"), F.lit(a).alias("waste_weight"), F.lit(b).alias("stockout_weight"))
                        for k, (a, b) in WEIGHTS.items()])
    return one.withColumn("_p", F.explode(presets)).select(
        "_p.*", "waste_cost_dkk", "stockout_cost_dkk",
        (F.col("waste_cost_dkk") * F.col("_p.waste_weight")
         + F.col("stockout_cost_dkk") * F.col("_p.stockout_weight")).alias("total_cost_dkk"))
