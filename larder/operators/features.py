"""Calendar, lag and rolling features over the daily grid."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from larder.functions.exprs import flag, series_window
from larder.operators.demand import SERIES

LAGS = [1, 7, 14, 28]


def time_features(df: DataFrame, date_col: str = "date") -> DataFrame:
    """Calendar columns; weekday 0 is Monday, the month angle starts at January = 0."""
    d = F.col(date_col)
    dow, month = F.weekday(d), F.month(d)
    angle = lambda x, n: x.cast("double") * F.lit(2 * math.pi) / F.lit(float(n))
    return df.withColumns({
        "day_of_week": dow, "day_of_month": F.day(d), "month": month, "quarter": F.quarter(d),
        "week_of_year": F.weekofyear(d), "day_of_year": F.dayofyear(d), "year": F.year(d),
        "is_weekend": flag(dow >= 5), "is_friday": flag(dow == 4), "is_monday": flag(dow == 0),
        "season": F.floor(month % 12 / 3).cast("int"),
        "dow_sin": F.sin(angle(dow, 7)), "dow_cos": F.cos(angle(dow, 7)),
        "month_sin": F.sin(angle(month - 1, 12)), "month_cos": F.cos(angle(month - 1, 12)),
    })


def time_features_v2(df: DataFrame, date_col: str = "date", start_until: int | None = None,
                     end_from: int | None = None) -> DataFrame:
    """Service variant: month start/end flags and an un-shifted month angle.

    Without thresholds the flags mark the true first and last day of the month.
    """
    d = F.col(date_col)
    dow, month = F.weekday(d), F.month(d)
    start = F.day(d) <= start_until if start_until else F.day(d) == 1
    end = F.day(d) >= end_from if end_from else d == F.last_day(d)
    angle = lambda x, n: x.cast("double") * F.lit(2 * math.pi) / F.lit(float(n))
    return df.withColumns({
        "day_of_week": dow, "day_of_month": F.day(d), "week_of_year": F.weekofyear(d), "month": month,
        "quarter": F.quarter(d), "year": F.year(d), "is_weekend": flag(dow >= 5),
        "is_month_start": flag(start), "is_month_end": flag(end),
        "dow_sin": F.sin(angle(dow, 7)), "dow_cos": F.cos(angle(dow, 7)),
        "month_sin": F.sin(angle(month, 12)), "month_cos": F.cos(angle(month, 12)),
    })


def lag_features(df: DataFrame, target: str = "quantity_sold", keys: list[str] = SERIES,
                 lags: list[int] = LAGS, name: str = "demand_lag_{}d") -> DataFrame:
    w = series_window(keys, "date")
    return df.withColumns({name.format(n): F.lag(target, n).over(w) for n in lags})


def rolling(df: DataFrame, target: str, keys: list[str], spec: dict[str, tuple[str, int | None]],
            min_rows: int | None = None) -> DataFrame:
    """Aggregates over the n rows before the current one.

    ``spec`` maps an output name to (mean|std|min|max, n); n None means all rows
    before. With ``min_rows`` a shorter history gives NULL (-1: full window).
    """
    fn = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    cols = {}
    for out, (kind, n) in spec.items():
        w = series_window(keys, "date", None if n is None else -n, -1)
        value = fn[kind](target).over(w)
        need = n if min_rows == -1 else min_rows
        if need:
            value = F.when(F.count(target).over(w) >= need, value)
        cols[out] = value
    return df.withColumns(cols)


def rolling_features(df: DataFrame, target: str = "quantity_sold", keys: list[str] = SERIES) -> DataFrame:
    """Rolling means and deviations, same-weekday values and the lifetime mean, all before the current row."""
    spec = {f"rolling_mean_{n}d": ("mean", n) for n in (7, 14, 30)}
    spec.update({f"rolling_std_{n}d": ("std", n) for n in (7, 14)})
    spec["expanding_mean"] = ("mean", None)
    out = rolling(df, target, keys, spec)
    w = series_window(keys, "date")
    four = [F.lag(target, n).over(w) for n in (7, 14, 21, 28)]
    return out.withColumns({
        "demand_same_weekday_last_week": four[0],
        "demand_same_weekday_avg_4weeks": (four[0] + four[1] + four[2] + four[3]) / 4,
    })


EWM_BLOCK = 128


def decayed(rate: float):
    return lambda total, x: total * rate + x


def ewm_features(df: DataFrame, target: str = "quantity_sold", keys: list[str] = SERIES,
                 spans: tuple[int, ...] = (7, 14, 30)) -> DataFrame:
    """Exponentially weighted mean of all earlier rows, weights (1-a)^k, normalised; null for the first row.

    A series is cut into blocks of ``EWM_BLOCK`` rows. Inside a block the weighted sum is folded forward, so that it is
    exact as long as the recurrence is; what earlier blocks leave is carried through the few block totals, so
    every row counts however far back it lies and the work is linear.
    """
    at = F.row_number().over(series_window(keys, "date")) - 1
    cells = df.withColumn("_n", at).withColumn("_b", F.floor(F.col("_n") / EWM_BLOCK)).withColumn("_p", F.col("_n") % EWM_BLOCK)
    x, p = F.coalesce(F.col(target).cast("double"), F.lit(0.0)), F.col("_p")
    rates = {s: 1 - 2.0 / (s + 1) for s in spans}
    before = Window.partitionBy(*keys, "_b").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_h", F.collect_list(x).over(before)).withColumns(
        {f"_in{s}": F.aggregate("_h", F.lit(0.0), decayed(r)) for s, r in rates.items()}).drop("_h")
    # what a whole block adds at its end, and what its predecessors add at its start
    ends = cells.groupBy(*keys, "_b").agg(*[F.sum(x * F.pow(F.lit(r), EWM_BLOCK - 1 - p)).alias(f"_e{s}") for s, r in rates.items()])
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*keys, "_b", *[
        F.aggregate(F.collect_list(f"_e{s}").over(earlier), F.lit(0.0), decayed(r**EWM_BLOCK)).alias(f"_c{s}") for s, r in rates.items()])
    out = cells.join(carry, [*keys, "_b"])
    weight = lambda r: (1 - F.pow(F.lit(r), F.col("_n"))) / (1 - r)
    return out.select(*[F.col(c) for c in df.columns], *[
        F.when(F.col("_n") > 0, (F.col(f"_in{s}") + F.pow(F.lit(r), p) * F.col(f"_c{s}")) / weight(r)).alias(f"ewm_{s}d") for s, r in rates.items()])


def demand_deltas(df: DataFrame, target: str = "quantity_sold", keys: list[str] = SERIES) -> DataFrame:
    """Change against the day before; the first row keeps its value."""
    w = series_window(keys, "date")
    return df.withColumn("delta", F.col(target) - F.coalesce(F.lag(target, 1).over(w), F.lit(0.0)))


def delta_sequences(df: DataFrame, length: int, horizon: int = 1, keys: list[str] = SERIES) -> DataFrame:
    """Full windows of ``length`` deltas with the delta ``horizon`` days later."""
    seq = F.collect_list("delta").over(series_window(keys, "date", -(length - 1), 0))
    nxt = F.lead("delta", horizon).over(series_window(keys, "date"))
    return df.withColumn("seq", seq).withColumn("target", nxt).where(
        (F.size("seq") == length) & F.col("target").isNotNull())


def pad_sequence(c: str | Column, length: int) -> Column:
    """Last ``length`` values, with zeros on the left if there are fewer."""
    arr = F.col(c) if isinstance(c, str) else c
    missing = F.greatest(F.lit(length) - F.size(arr), F.lit(0))
    tail = F.slice(arr, F.greatest(F.size(arr) - length + 1, F.lit(1)), F.lit(length))
    return F.concat(F.array_repeat(F.lit(0.0), missing), tail)


def latest_per_series(df: DataFrame, columns: list[str], keys: list[str] = SERIES) -> DataFrame:
    """Last non-null value of each column per series."""
    return df.groupBy(*keys).agg(
        F.max("date").alias("date"),
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("date"))).alias(c) for c in columns])
