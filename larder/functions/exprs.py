"""Column helpers shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.window import Window, WindowSpec


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def exact_sum(c: str | Column, scale: int = 6) -> Column:
    """Sum in decimals, so the result does not depend on task order."""
    return F.sum(col(c).cast(f"decimal(28,{scale})")).cast("double")


def exact_mean(c: str | Column, scale: int = 6) -> Column:
    return F.try_divide(exact_sum(c, scale), F.count(col(c)))


def ratio(a: str | Column, b: str | Column) -> Column:
    """Division that yields NULL for a zero divisor."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def rnd(c: str | Column, digits: int = 6) -> Column:
    """Half-away rounding, as SQL ROUND."""
    return F.round(col(c).cast("double"), digits)


def rnd_even(c: str | Column, digits: int = 0) -> Column:
    """Half-even rounding, as Python and NumPy round."""
    return F.bround(col(c).cast("double"), digits)


def flag(cond: Column) -> Column:
    """0/1 integer; an unknown condition counts as 0."""
    return F.when(cond, 1).otherwise(0)


def finite(c: str | Column) -> Column:
    """NaN, infinities and NULL become 0."""
    x = col(c).cast("double")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(x)


def clipped(c: str | Column, low: float = 0.0) -> Column:
    x = col(c)
    return F.when(x < low, F.lit(low)).otherwise(x)


def over_part(a: Column, b: Column) -> Column:
    """max(a - b, 0) with NULL kept."""
    d = a - b
    return F.when(d > 0, d).when(d.isNull(), F.lit(None).cast("double")).otherwise(F.lit(0.0))


def series_window(keys: list[str], order: str, start: int | None = None, end: int | None = None) -> WindowSpec:
    """Window over one series in date order; a series is bounded by the calendar."""
    w = Window.partitionBy(*keys).orderBy(order)
    if start is None and end is None:
        return w
    return w.rowsBetween(Window.unboundedPreceding if start is None else start, end)


def first_row_per_key(df, keys: list[str], order: list[Column]):
    """Keep one whole row per key, the first in ``order``.

    A struct minimum is merged on the map side before the shuffle, so a hot
    key never gathers its rows in one task, unlike row_number().
    ``order`` must be ascending expressions; all columns break the last ties.
    """
    rest = [c for c in df.columns if c not in keys]
    orders = [o.alias(f"_o{i}") for i, o in enumerate(order)]
    return (
        df.groupBy(*keys)
        .agg(F.min(F.struct(*orders, *rest)).alias("_row"))
        .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
        .select(*df.columns)
    )


def latest_row_per_key(df, keys: list[str], order: list[Column]):
    """Keep one whole row per key, the last in ``order`` (partial max, no window)."""
    rest = [c for c in df.columns if c not in keys]
    orders = [o.alias(f"_o{i}") for i, o in enumerate(order)]
    return (
        df.groupBy(*keys)
        .agg(F.max(F.struct(*orders, *rest)).alias("_row"))
        .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
        .select(*df.columns)
    )


TASK_ROWS = 500_000


def task_count(df) -> int | None:
    """Tasks to deal the rows to, so that none gets more than TASK_ROWS on average; None for few rows, which Spark deals best."""
    n = -(-df.count() // TASK_ROWS)
    return n if n > df.sparkSession.sparkContext.defaultParallelism else None


def dealt_join(left, right, key: str, parts: int | None):
    """Inner join of two sides dealt by the key to ``parts`` tasks; a grouping that contains the key needs no further shuffle."""
    if parts:
        left, right = left.repartition(parts, key), right.repartition(parts, key)
    return left.join(right, key)


def top_per_group(df, keys: list[str], order: list[Column], n: int, rank_col: str = "rank"):
    """First n rows of each group; Spark limits each group on the map side."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)
