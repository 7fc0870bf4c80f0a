"""Report aggregates: order, stock, customer and platform figures, rankings, forecast boards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from larder.functions.exprs import exact_mean, exact_sum, ratio, top_per_group
from larder.functions.quantiles import exact_quantiles


def stack_rows(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def order_stats(orders: DataFrame, types: list[str], done: str = "F", cancelled: str = "P") -> DataFrame:
    """Counts by status and type, completed revenue and average order value, in one pass."""
    s, v = F.col("status"), F.col("total_amount")
    revenue = exact_sum(F.when(s == done, v), 2)
    return orders.agg(
        F.count(F.lit(1)).alias("total_orders"), F.count_if(s == done).alias("completed"),
        F.count_if(s == cancelled).alias("cancelled"), F.coalesce(revenue, F.lit(0.0)).alias("revenue"),
        F.coalesce(F.try_divide(revenue, F.count_if(s == done)), F.lit(0.0)).alias("avg_order_value"),
        *[F.count_if(F.col("type") == t).alias(f"type_{i}") for i, t in enumerate(types)])


def today_summary(orders: DataFrame, done: str = "F", open_status: tuple[str, ...] = ("O",)) -> DataFrame:
    """Figures of the last day of the data."""
    ref = orders.agg(F.max("date").alias("d")).scalar()
    s = F.col("status")
    rev = exact_sum(F.when(s == done, F.col("total_amount")), 2)
    return orders.where(F.col("date") >= ref).groupBy("date").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(s == done).alias("completed"),
        F.count_if(s.isin(*open_status)).alias("open"), F.coalesce(rev, F.lit(0.0)).alias("revenue"),
        F.coalesce(F.try_divide(rev, F.count_if(s == done)), F.lit(0.0)).alias("average_ticket"))


def status_breakdown(orders: DataFrame, statuses: list[str]) -> DataFrame:
    """Count per status of a fixed list, zeros included, in list order."""
    counts = orders.agg(*[F.count_if(F.col("status") == s).alias(f"_{i}") for i, s in enumerate(statuses)])
    return counts.select(F.posexplode(F.array(*[
        F.struct(F.lit(s).alias("status"), F.col(f"_{i}").alias("n")) for i, s in enumerate(statuses)])).alias("position", "x")
    ).select("position", "x.status", F.col("x.n").alias("orders"))


def inventory_stats(stock: DataFrame, low_default: float = 10) -> DataFrame:
    q, low = F.coalesce("quantity", F.lit(0.0)), F.coalesce("threshold", F.lit(low_default))
    return stock.agg(
        F.count(F.lit(1)).alias("items"), exact_sum(q).alias("total_quantity"),
        F.count_if(q <= 0).alias("out_of_stock"), F.count_if((q > 0) & (q <= low)).alias("low_stock"),
        exact_sum(q * F.coalesce("cost", "price"), 4).alias("stock_value"))


def top_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_sellers(sales: DataFrame, days: int, n: int, by: str = "quantity") -> DataFrame:
    from larder.operators.demand import recent
    t = recent(sales, days).groupBy("title").agg(
        F.sum("quantity").alias("quantity"), exact_sum("cost", 2).alias("revenue"),
        F.countDistinct("order_id").alias("orders"))
    return top_rows(t, [F.desc(by), F.asc("title")], n)


def sales_history(sales: DataFrame, days: int, limit: int = 200) -> DataFrame:
    from larder.operators.demand import recent
    h = recent(sales, days).groupBy("date", "title").agg(
        F.sum("quantity").alias("quantity"), F.round(exact_sum("cost", 2), 2).alias("revenue"),
        F.countDistinct("order_id").alias("orders"))
    return top_rows(h, [F.desc("date"), F.desc("quantity"), F.asc("title")], limit)


def recent_revenue(orders: DataFrame, key: str, rows: int = 30) -> DataFrame:
    """Sum of the last n orders of each owner; the n rows are cut on the map side."""
    last = top_per_group(orders, [key], [F.desc("date"), F.desc("id")], rows)
    return last.groupBy(key).agg(F.count(F.lit(1)).alias("orders"), exact_sum("total_amount", 2).alias("recent_revenue"))


def recent_summary(daily: DataFrame, days: int = 30, top: int = 15) -> DataFrame:
    """Average of daily totals, total, day count and the best titles of the last n days, as rows."""
    from larder.operators.demand import recent
    r = recent(daily, days)
    per_day = r.groupBy("date").agg(F.sum("quantity_sold").alias("q"))
    figures = per_day.agg(exact_mean("q").alias("avg_daily"), F.sum("q").alias("total"), F.count(F.lit(1)).cast("double").alias("days"))
    rows = figures.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.lit("").alias("item"), F.col(n).alias("value")) for n in ("avg_daily", "total", "days")])).alias("x")).select("x.*")
    best = top_rows(r.groupBy("item_name").agg(F.sum("quantity_sold").alias("value")), [F.desc("value"), F.asc("item_name")], top)
    return rows.unionByName(best.select(F.lit("top").alias("metric"), F.col("item_name").alias("item"), "value"))


def wow_trend(daily: DataFrame, key: str = "item_name", min_prev: float = 5, pct: float = 30) -> DataFrame:
    """Last week against the one before; label up or down beyond +-pct %."""
    ref = daily.agg(F.max("date").alias("d")).scalar()
    d, q = F.col("date"), F.col("quantity_sold")
    two = daily.where(d >= F.date_sub(ref, 14)).groupBy(key).agg(
        F.sum(F.when(d < F.date_sub(ref, 7), q)).alias("prev"),
        F.coalesce(F.sum(F.when(d >= F.date_sub(ref, 7), q)), F.lit(0.0)).alias("curr"))
    change = (F.col("curr") - F.col("prev")) / F.col("prev") * 100
    return two.where(F.col("prev") > min_prev).withColumn("change_pct", change).withColumn(
        "trend", F.when(F.col("change_pct") > pct, "up").when(F.col("change_pct") < -pct, "down").otherwise("flat"))


def value_counts(df: DataFrame, columns: list[str], unknown: str = "Unknown") -> DataFrame:
    """Count per value of several columns in one grouping-set pass."""
    c = df.select(*[F.coalesce(F.col(x).cast("string"), F.lit(unknown)).alias(x) for x in columns])
    long = c.select(F.explode(F.array(*[F.struct(F.lit(x).alias("column"), F.col(x).alias("value")) for x in columns])).alias("x"))
    return long.groupBy("x.column", "x.value").agg(F.count(F.lit(1)).alias("n"))


def numeric_profile(df: DataFrame, metrics: list[str], date_col: str) -> DataFrame:
    """Count, mean, exact median and date range per metric, on the long form."""
    long = df.select(F.to_date(date_col).alias("d"), F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")).select("d", "x.*")
    stats = long.groupBy("metric").agg(
        F.count("value").alias("n"), exact_mean("value").alias("mean"), F.min("d").alias("first_date"), F.max("d").alias("last_date"))
    return stats.join(exact_quantiles(long, "value", {"median": 0.5}, ["metric"]), "metric")


def iqr_bounds(df: DataFrame, value: str, multiplier: float = 3.0) -> DataFrame:
    q = exact_quantiles(df, value, {"q1": 0.25, "q3": 0.75})
    spread = F.col("q3") - F.col("q1")
    return q.select("q1", "q3", (F.col("q1") - spread * multiplier).alias("lower"), (F.col("q3") + spread * multiplier).alias("upper"))


def iqr_filter(df: DataFrame, value: str, multiplier: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """Rows inside the bounds, and the rows outside."""
    b = iqr_bounds(df, value, multiplier)
    pair = b.select(F.struct("lower", "upper").alias("b")).scalar()
    marked = df.withColumn("_b", pair).withColumn("_in", F.col(value).between(F.col("_b.lower"), F.col("_b.upper")))
    return marked.where("_in").drop("_in", "_b"), marked.where(~F.col("_in")).drop("_in", "_b")


def iqr_summary(df: DataFrame, value: str, multiplier: float = 3.0) -> DataFrame:
    """Bounds, counts inside and outside, and the total inside, in one pass over the rows."""
    pair = iqr_bounds(df, value, multiplier).select(F.struct("lower", "upper").alias("b")).scalar()
    marked = df.select(F.col(value).alias("_v"), pair.alias("_b")).withColumn("_in", F.col("_v").between(F.col("_b.lower"), F.col("_b.upper")))
    return marked.agg(
        F.lit(value).alias("metric"), F.first("_b.lower").alias("lower"), F.first("_b.upper").alias("upper"),
        F.count_if("_in").alias("inliers"), F.count_if(~F.col("_in")).alias("outliers"),
        exact_sum(F.when(F.col("_in"), F.col("_v")), 2).alias("inlier_total"))


def feature_correlations(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """Pearson correlation with the target over the rows where both are known, in one pass."""
    pair = lambda c: F.corr(F.when(F.col(c).isNotNull(), F.col(target)), F.when(F.col(target).isNotNull(), F.col(c)))
    one = df.agg(*[pair(c).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("correlation")) for c in columns])).alias("x")).select("x.*")


def sample_rows(df: DataFrame, keys: list[str], share: float, seed: int) -> DataFrame:
    """A share of the rows chosen by a hash of their key: the same rows however the table is partitioned."""
    h = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), *keys)), 1, 8), 16, 10).cast("long")
    return df.where(h % 10000 < round(share * 10000))


def dq_summary(df: DataFrame, key: str, date_col: str, status_col: str, columns: list[str] | None = None) -> DataFrame:
    """Date range, duplicate ids, distinct statuses and NULL count of every column (or of ``columns``)."""
    columns = columns or df.columns
    one = df.agg(
        F.count(F.lit(1)).alias("rows"), (F.count(key) - F.countDistinct(key)).alias("duplicate_ids"),
        F.to_date(F.min(date_col)).alias("first_date"), F.to_date(F.max(date_col)).alias("last_date"),
        F.countDistinct(status_col).alias("statuses"),
        *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns])
    return one


def model_leaderboard(per_series: DataFrame, thresholds: tuple[float, ...] = (1.0, 2.0)) -> DataFrame:
    """Per model: mean and deviation of the series MAE, shares under thresholds, series won."""
    best = per_series.groupBy("place_id", "item_id").agg(F.min_by("model", F.struct("mae", "model")).alias("model"))
    wins = best.groupBy("model").agg(F.count(F.lit(1)).alias("series_won"))
    n = F.count(F.lit(1))
    return per_series.groupBy("model").agg(
        F.round(F.avg("mae"), 6).alias("mean_mae"), F.round(F.stddev_samp("mae"), 6).alias("std_mae"),
        *[(F.count_if(F.col("mae") < t) / n * 100).alias(f"share_under_{int(t)}") for t in thresholds],
        F.min_by(F.concat_ws("/", "place_id", "item_id"), F.struct("mae", "place_id", "item_id")).alias("best_series"),
        F.max_by(F.concat_ws("/", "place_id", "item_id"), F.struct("mae", "place_id", "item_id")).alias("worst_series"),
    ).join(wins, "model", "left").withColumn("series_won", F.coalesce("series_won", F.lit(0)))


RISK = {"high": 0, "medium": 1, "low": 2}  # fixed values


def item_board(fc: DataFrame) -> DataFrame:
    """Forecast rows per item: worst risk, mean, total, safety stock."""
    order = F.create_map(*[F.lit(x) for kv in RISK.items() for x in kv])
    back = F.create_map(*[F.lit(x) for k, v in RISK.items() for x in (v, k)])
    return fc.groupBy("item_name").agg(
        F.min(order[F.col("demand_risk")]).alias("_r"), F.max("is_perishable").alias("is_perishable"),
        exact_mean("predicted_quantity").alias("avg_demand"), exact_sum("predicted_quantity").alias("total_demand"),
        F.max("safety_stock").alias("safety_stock"),
        exact_mean(F.col("upper_bound") - F.col("lower_bound")).alias("avg_spread")).withColumn("risk", back[F.col("_r")])


def board_summary(fc: DataFrame) -> DataFrame:
    items = item_board(fc)
    return items.agg(
        F.count(F.lit(1)).alias("items"), exact_sum("total_demand").alias("total_demand"),
        F.count_if(F.col("risk") == "high").alias("high_risk"), F.count_if(F.col("risk") == "medium").alias("medium_risk"),
        F.count_if(F.col("risk") == "low").alias("low_risk"), F.count_if("is_perishable").alias("perishables"))


def forecast_trend(fc: DataFrame, min_change: float = 5, top: int = 6) -> DataFrame:
    """Second half of the horizon against the first; the strongest movers."""
    from pyspark.sql.window import Window
    w = Window.partitionBy("item_name").orderBy("date")
    n = F.count(F.lit(1)).over(Window.partitionBy("item_name"))
    marked = fc.withColumn("_first", F.row_number().over(w) <= F.floor(n / 2))
    halves = marked.groupBy("item_name").agg(
        exact_mean(F.when(F.col("_first"), F.col("predicted_quantity"))).alias("avg_first"),
        exact_mean(F.when(~F.col("_first"), F.col("predicted_quantity"))).alias("avg_second"))
    change = F.when(F.col("avg_first") > 0, (F.col("avg_second") - F.col("avg_first")) / F.col("avg_first") * 100).otherwise(0.0)
    moved = halves.where(F.col("avg_first").isNotNull()).withColumn("change_pct", F.round(change, 6)).where(F.abs("change_pct") > min_change)
    return top_rows(moved, [F.desc(F.abs("change_pct")), F.asc("item_name")], top)


def forecast_insights(fc: DataFrame, volatility: float = 0.5, top: int = 5) -> DataFrame:
    """Peak and slowest day, the most volatile items and the first day's preparation list, as rows."""
    per_day = fc.groupBy("date").agg(exact_sum("predicted_quantity").alias("q"))
    ends = per_day.agg(F.max_by("date", F.struct("q", F.date_diff(F.lit("2100-01-01"), F.col("date")))).alias("a"), F.max("q").alias("aq"),
                       F.min_by("date", F.struct("q", "date")).alias("b"), F.min("q").alias("bq"))
    days = ends.select(F.explode(F.array(
        F.struct(F.lit("peak_day").alias("kind"), F.col("a").cast("string").alias("name"), F.col("aq").alias("value")),
        F.struct(F.lit("slowest_day").alias("kind"), F.col("b").cast("string").alias("name"), F.col("bq").alias("value")))).alias("x")).select("x.*")
    board = item_board(fc).withColumn("v", F.round(ratio("avg_spread", "avg_demand"), 6))
    vol = top_rows(board.where(F.col("v") > volatility), [F.desc("v"), F.asc("item_name")], top)
    first = fc.agg(F.min("date").alias("d")).scalar()
    prep = fc.where(F.col("date") == first).select(
        F.lit("prep").alias("kind"), F.col("item_name").alias("name"), F.ceil("predicted_quantity").cast("double").alias("value"))
    return days.unionByName(vol.select(F.lit("volatile").alias("kind"), F.col("item_name").alias("name"), F.col("v").alias("value"))).unionByName(prep)


def table_stats(tables: DataFrame, statuses: tuple[str, ...] = ("AVAILABLE", "OCCUPIED", "RESERVED", "DIRTY")) -> DataFrame:
    """Count per status, seats and occupancy in percent."""
    n = F.count(F.lit(1))
    return tables.agg(
        n.alias("total"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in statuses],
        F.coalesce(F.sum("capacity"), F.lit(0)).alias("total_capacity"),
        F.coalesce(F.try_divide(F.count_if(F.col("status") == "OCCUPIED") * 100.0, n), F.lit(0.0)).alias("occupancy_rate"))


def latest_rows(df: DataFrame, ts: str, tie: str, limit: int = 5000) -> DataFrame:
    """The newest rows, as a live feed is read."""
    return df.orderBy(F.desc(ts), F.desc(tie)).limit(limit)
