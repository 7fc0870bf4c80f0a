"""Baseline forecasts, blends, intervals and history-only forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from larder.functions.exprs import clipped, exact_mean, exact_sum, flag, rnd, rnd_even, series_window
from larder.operators.demand import SERIES

FEATURE_FOR_WINDOW = {7: 7, 14: 14, 28: 30}  # fixed values: the 28-day model reads the 30-day feature


def naive_last_week(df: DataFrame, out: str = "naive", target: str = "quantity_sold") -> DataFrame:
    lag = F.col("demand_lag_7d") if "demand_lag_7d" in df.columns else F.lag(target, 7).over(
        series_window(SERIES, "date"))
    return df.withColumn(out, F.coalesce(lag, F.lit(0.0)))


def moving_average(df: DataFrame, window: int, out: str, target: str = "quantity_sold",
                   use_feature_map: bool = True) -> DataFrame:
    """Mean of the days before; reuses a feature column where one exists."""
    n = FEATURE_FOR_WINDOW.get(window, window) if use_feature_map else window
    name = f"rolling_mean_{n}d"
    value = F.col(name) if name in df.columns else F.avg(target).over(series_window(SERIES, "date", -n, -1))
    return df.withColumn(out, F.coalesce(value, F.lit(0.0)))


def buffered(df: DataFrame, base: str, factor: float = 1.2, out: str = "buffered") -> DataFrame:
    return df.withColumn(out, clipped(F.col(base) * factor))


def hybrid(df: DataFrame, model: str, ma: str, weight: float = 0.3, out: str = "hybrid") -> DataFrame:
    """weight * model + (1 - weight) * average, half-even rounded, not below 0."""
    if not 0 <= weight <= 1:
        raise ValueError("weight must lie in [0, 1]")
    from larder.functions.exprs import finite
    blend = finite(model) * weight + finite(ma) * (1 - weight)
    return df.withColumn(out, clipped(rnd_even(blend)))


def waste_optimised(df: DataFrame, base: str = "hybrid", factor: float = 0.85, out: str = "waste_opt") -> DataFrame:
    return df.withColumn(out, clipped(rnd_even(F.col(base) * factor)))


def interval(df: DataFrame, pred: str = "predicted", std: str = "rolling_std_14d", z: float = 1.96,
             target: str = "quantity_sold") -> DataFrame:
    """pred +- z * recent deviation; the overall deviation where there is none."""
    overall = df.agg(F.stddev_samp(target).alias("s")).scalar()
    s = F.coalesce(F.col(std), overall)
    return df.withColumns({"lower": clipped(F.col(pred) - s * z), "upper": F.col(pred) + s * z})


def weekday_means(daily: DataFrame, key: str) -> DataFrame:
    """Mean demand per key and weekday beside the overall mean per key."""
    dow = daily.groupBy(key, F.weekday("date").alias("dow")).agg(
        F.sum("quantity_sold").alias("_s"), F.count("quantity_sold").alias("_n"))
    allday = dow.groupBy(key).agg((F.sum("_s") / F.sum("_n")).alias("overall"))
    return dow.select(key, "dow", (F.col("_s") / F.col("_n")).alias("dow_mean")).join(allday, key)


def weekday_factors(daily: DataFrame, key: str = "item_id", low: float = 0.5, high: float = 1.8,
                    missing: float = 0.8) -> DataFrame:
    """Clamped weekday factor for all seven days; items without positive mean are skipped."""
    raw = weekday_means(daily, key).where(F.col("overall") > 0)
    by_item = raw.groupBy(key).agg(F.map_from_entries(F.collect_list(
        F.struct("dow", F.least(F.greatest(F.col("dow_mean") / F.col("overall"), F.lit(low)), F.lit(high))))
    ).alias("_m"))
    return by_item.select(key, "_m", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("dow")).select(
        key, "dow", F.coalesce(F.try_element_at("_m", F.col("dow")), F.lit(missing)).alias("factor"))


def risk_tier(cv: Column) -> Column:
    return F.when(cv > 1.0, "high").when(cv > 0.5, "medium").otherwise("low")


def matches_any(name: Column, words: list[str]) -> Column:
    return F.coalesce(F.lower(name).rlike("|".join(words)), F.lit(False))


def history_stats(daily: DataFrame, key: str = "item_name") -> DataFrame:
    """Mean, sample deviation, count and total of the daily sums (exact for whole quantities)."""
    n, s = F.count("quantity_sold"), F.sum("quantity_sold")
    # the built-in deviation updates around the running mean, so large totals don't cancel
    return daily.groupBy(key).agg(
        (s / n).alias("avg_daily"), F.round(F.stddev_samp("quantity_sold"), 9).alias("std_daily"),
        n.alias("active_days"), s.alias("total_sold"),
        F.min("quantity_sold").alias("min_daily"), F.max("quantity_sold").alias("max_daily"))


def history_forecast(daily: DataFrame, days_ahead: int, perishable: list[str], key: str = "item_name",
                     top_n: int | None = None) -> DataFrame:
    """Mean times clamped weekday factor for the days after the data, with bands and tiers."""
    stats = history_stats(daily, key)
    if top_n:
        stats = stats.orderBy(F.desc("total_sold"), F.asc(key)).limit(top_n)
    last = daily.agg(F.max("date").alias("d")).scalar()
    future = stats.withColumn("date", F.explode(F.sequence(
        F.date_add(last, 1), F.date_add(last, days_ahead), F.expr("interval 1 day"))))
    dow = F.weekday("date")
    means = weekday_means(daily, key).select(key, F.col("dow").alias("_dow"), "dow_mean", "overall")
    joined = future.withColumn("_dow", dow).join(means, [key, "_dow"], "left")
    seen = F.least(F.greatest(F.col("dow_mean") / F.col("overall"), F.lit(0.5)), F.lit(1.8))
    default = F.when(F.col("_dow") >= 5, 0.8).when(F.col("_dow") == 4, 1.1).otherwise(1.0)
    pred = F.greatest(F.col("avg_daily") * F.coalesce(seen, default), F.lit(0.0))
    std = F.coalesce("std_daily", F.lit(0.0))
    cv = F.when(F.col("avg_daily") > 0, std / F.col("avg_daily")).otherwise(0.0)
    return joined.withColumn("_p", pred).select(
        key, "date", rnd("_p", 4).alias("predicted_quantity"),
        rnd(F.col("_p") * 0.7, 4).alias("lower_bound"), rnd(F.col("_p") * 1.4, 4).alias("upper_bound"),
        risk_tier(cv).alias("demand_risk"), matches_any(F.col(key), perishable).alias("is_perishable"),
        rnd(std * 1.65, 4).alias("safety_stock"),
        F.when(F.col("active_days") >= 14, "medium").when(F.col("active_days") >= 5, "low")
        .otherwise("very_low").alias("confidence"))


def average_fallback(daily: DataFrame, days: int, limit: int, perishable: list[str],
                     key: str = "item_name") -> DataFrame:
    """Mean of the last n days with a waste- and a stockout-leaning variant; largest items first."""
    from larder.operators.demand import recent
    s = history_stats(recent(daily, days), key).withColumn("_cv", F.when(
        F.col("avg_daily") > 0, F.col("std_daily") / F.col("avg_daily")).otherwise(0.0))
    return s.orderBy(F.desc("avg_daily"), F.asc(key)).limit(limit).select(
        key, rnd("avg_daily", 4).alias("avg_daily_demand"), rnd("_cv", 4).alias("demand_cv"),
        risk_tier(F.col("_cv")).alias("demand_risk"),
        matches_any(F.col(key), perishable).alias("is_perishable"),
        rnd(F.col("avg_daily") * 0.85, 4).alias("forecast_waste_optimized"),
        rnd(F.col("avg_daily") * 1.20, 4).alias("forecast_stockout_optimized"),
        rnd("avg_daily", 4).alias("forecast_balanced"), rnd(F.col("std_daily") * 1.65, 4).alias("safety_stock"),
        "active_days", "min_daily", "max_daily")


def tail_mean(daily: DataFrame, rows: tuple[int, ...] = (7, 4, 3), keys: list[str] = SERIES) -> DataFrame:
    """Mean of the last n rows of each series, for several n at once."""
    from pyspark.sql.window import Window
    w = Window.partitionBy(*keys).orderBy(F.desc("date"))
    tail = daily.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= max(rows))
    return tail.groupBy(*keys).agg(*[
        F.avg(F.when(F.col("_rn") <= n, F.col("quantity_sold"))).alias(f"mean_last_{n}") for n in rows])


def baseline_mae(df: DataFrame, models: dict[str, str], target: str = "quantity_sold") -> DataFrame:
    """One row per baseline with its mean absolute error."""
    long = df.select(target, F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("pred")) for m, c in models.items()])).alias("x"))
    return long.groupBy(F.col("x.model").alias("model")).agg(
        exact_mean(F.abs(F.col(target) - F.col("x.pred"))).alias("mae"))
