"""Daily demand cube, date grids and demand roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from larder.functions.exprs import dealt_join, exact_sum, top_per_group

SERIES = ["place_id", "item_id"]


def local_date(ts: str | Column, tz: str | None = None) -> Column:
    """Calendar day of a zoneless UTC timestamp at ``tz``; None keeps the day as stored."""
    c = F.col(ts) if isinstance(ts, str) else ts
    if tz is None:
        return F.to_date(c)
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(tz), c.cast("timestamp_ntz")))


def sales_lines(orders: DataFrame, lines: DataFrame, tz: str | None = None, parts: int | None = None) -> DataFrame:
    """Order lines with place and local date. ``parts`` deals orders and lines to that many tasks; without it AQE
    chooses, and splits a skewed order key, because only a partial aggregate follows the join."""
    o = orders.select(F.col("id").alias("order_id"), "place_id", local_date("created_dt", tz).alias("date"))
    return dealt_join(lines, o, "order_id", parts)


def daily_demand(orders: DataFrame, lines: DataFrame, tz: str | None = None, parts: int | None = None) -> DataFrame:
    """Quantity, revenue and distinct orders per (date, place, item)."""
    return sales_lines(orders, lines, tz, parts).groupBy("date", *SERIES).agg(
        F.sum("quantity").alias("quantity_sold"),
        exact_sum("cost", 2).alias("revenue"),
        F.countDistinct("order_id").alias("order_count"))


def topn_per_store(daily: DataFrame, n: int) -> DataFrame:
    """The n items with the largest total quantity in each place."""
    totals = daily.groupBy(*SERIES).agg(F.sum("quantity_sold").alias("total_quantity"))
    return top_per_group(totals, ["place_id"], [F.desc("total_quantity"), F.asc("item_id")], n)


def fill_grid(grid: DataFrame, daily: DataFrame, zero: list[str]) -> DataFrame:
    joined = grid.join(daily, ["date", *SERIES], "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zero})


def date_grid(daily: DataFrame, top_n: int | None = None) -> DataFrame:
    """All series on every day of the global range; missing days hold 0.

    With ``top_n`` only the n largest series of each place are kept; the cut
    comes first, so the grid is (kept series) x (days). The day range of the
    kept series is a scalar subquery; each series explodes its own days, and
    the left join drops the series that were cut.
    """
    stats = daily.groupBy(*SERIES).agg(
        F.sum("quantity_sold").alias("_q"), F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    if top_n:
        stats = top_per_group(stats, ["place_id"], [F.desc("_q"), F.asc("item_id")], top_n)
    span = stats.agg(F.struct(F.min("_lo").alias("lo"), F.max("_hi").alias("hi")).alias("s")).scalar()
    grid = stats.select(*SERIES, span.alias("_span")).select(
        *SERIES, F.explode(F.sequence("_span.lo", "_span.hi", F.expr("interval 1 day"))).alias("date"))
    return fill_grid(grid, daily, ["quantity_sold", "revenue", "order_count"]).select(
        "date", *SERIES, "quantity_sold", "revenue", "order_count")


def series_reindex(daily: DataFrame, keys: list[str] = SERIES, value: str = "quantity_sold") -> DataFrame:
    """Each series on every day between its own first and last day."""
    span = daily.groupBy(*keys).agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    grid = span.select(*keys, F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("date"))
    return grid.join(daily.select(*keys, "date", value), [*keys, "date"], "left").withColumn(
        value, F.coalesce(F.col(value), F.lit(0.0)))


def future_dates(daily: DataFrame, days: int, keys: list[str] = SERIES) -> DataFrame:
    """The n days after the last day of the data, for each series."""
    last = daily.agg(F.max("date").alias("d")).scalar()
    return daily.select(*keys).distinct().withColumn(
        "date", F.explode(F.sequence(F.date_add(last, 1), F.date_add(last, days), F.expr("interval 1 day"))))


def item_daily_demand(lines: DataFrame, unknown: str = "Unknown Item") -> DataFrame:
    """Demand per item name and day, over all places."""
    return lines.groupBy(F.coalesce("title", F.lit(unknown)).alias("item_name"), "date").agg(
        F.sum("quantity").alias("quantity_sold"))


def period_rollup(df: DataFrame, period: str, values: list[str], fill: bool = True) -> DataFrame:
    """Sums per day, week or month. Weeks carry their Sunday, months their last day."""
    start = F.date_trunc({"D": "day", "W": "week", "M": "month"}[period], "date").cast("date")
    sums = df.groupBy(start.alias("_start")).agg(*[exact_sum(v).alias(v) for v in values])
    if fill:
        step = {"D": "interval 1 day", "W": "interval 7 days", "M": "interval 1 month"}[period]
        spans = sums.agg(F.min("_start").alias("a"), F.max("_start").alias("b")).select(
            F.explode(F.sequence("a", "b", F.expr(step))).alias("_start"))
        sums = spans.join(sums, "_start", "left").withColumns(
            {v: F.coalesce(F.col(v), F.lit(0.0)) for v in values})
    label = {"D": F.col("_start"), "W": F.date_add("_start", 6), "M": F.last_day("_start")}[period]
    return sums.select(label.alias("period"), *values)


def eligible_items(daily: DataFrame, min_demand: float, min_days: int, key: str = "item_name") -> DataFrame:
    return daily.groupBy(key).agg(
        F.sum("quantity_sold").alias("total_demand"), F.countDistinct("date").alias("active_days")
    ).where((F.col("total_demand") >= min_demand) & (F.col("active_days") >= min_days))


def recent(daily: DataFrame, days: int, as_of=None) -> DataFrame:
    """Rows of the last n days before ``as_of`` (default: the last day of the data)."""
    ref = F.lit(as_of).cast("date") if as_of is not None else daily.agg(F.max("date").alias("d")).scalar()
    return daily.where(F.col("date") >= F.date_sub(ref, days))
