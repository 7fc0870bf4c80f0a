"""Cleaning of orders, order lines and items; filters; schema and quality checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from larder.functions.exprs import clipped, finite, first_row_per_key


def dedup_first(df: DataFrame, key: str | list[str], order: list[Column] | None = None) -> DataFrame:
    """Keep the first row per key in a total order."""
    keys = [key] if isinstance(key, str) else key
    return first_row_per_key(df, keys, order or [])


def clean_orders(df: DataFrame, demo_col: str | None = None) -> DataFrame:
    """Closed, non-demo orders with a place, one row per id. Unknown demo flag is kept."""
    out = df.where(F.col("status") == "Closed")
    if demo_col:
        out = out.where(F.col(demo_col).isNull() | (F.col(demo_col) != 1))
    return dedup_first(out, "id").where(F.col("place_id").isNotNull())


def clean_order_items(df: DataFrame, key: list[str] | None = None) -> DataFrame:
    out = df.where(F.col("item_id").isNotNull())
    if key:
        out = dedup_first(out, key)
    return out.where(F.col("quantity") > 0)


def clean_items(df: DataFrame) -> DataFrame:
    """Items neither deleted nor demo, one row per id."""
    out = df
    for c in ("deleted", "demo_mode"):
        if c in df.columns:
            out = out.where(F.col(c).isNull() | (F.col(c) != 1))
    return dedup_first(out, "id")


def clean_campaigns(df: DataFrame, key: str = "campaign_id") -> DataFrame:
    return dedup_first(df, key).dropna(subset=["start_date", "end_date"])


def clean_all(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Clean each known table with its own rule, others by id."""
    rules = {"fct_orders": clean_orders, "fct_order_items": clean_order_items,
             "dim_items": clean_items, "fct_campaigns": clean_campaigns}
    out = {}
    for name, df in tables.items():
        if name in rules:
            out[name] = rules[name](df)
        else:
            out[name] = dedup_first(df, "id") if "id" in df.columns else df
    return out


def main_stores(orders: DataFrame, lines: DataFrame, min_orders: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Orders of places with enough orders, and the lines of those orders."""
    big = orders.groupBy("place_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_orders)
    kept = orders.join(big, "place_id", "left_semi")
    return kept, lines.join(kept, lines.order_id == kept.id, "left_semi")


def filter_by_date_range(df: DataFrame, start, end, date_col: str = "date") -> DataFrame:
    return df.where(F.col(date_col).between(F.lit(start), F.lit(end)))


def apply_filters(df: DataFrame, places=None, items=None, start=None, end=None) -> DataFrame:
    """Conjunction of the given filters; an empty list filters nothing."""
    if places:
        df = df.where(F.col("place_id").isin(list(places)))
    if items:
        df = df.where(F.col("item_id").isin(list(items)))
    if start is not None:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col("date") <= F.lit(end).cast("date"))
    return df


def sanitize(df: DataFrame, values: list[str], prices: list[str] = ()) -> DataFrame:
    """Non-finite values become 0 and prices do not go below 0."""
    out = {c: finite(c) for c in values}
    out.update({c: clipped(finite(c)) for c in prices})
    return df.withColumns(out)


def search_any(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Case-insensitive contains over several columns, any of them."""
    needle = F.lower(F.lit(text))
    hits = [F.coalesce(F.lower(F.col(c)).contains(needle), F.lit(False)) for c in columns]
    return df.where(reduce(lambda a, b: a | b, hits))


def filter_active(df: DataFrame, ended_col: str) -> DataFrame:
    return df.where(F.col(ended_col).isNull())


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


def has_tag(df: DataFrame, tags_col: str, tag: str) -> DataFrame:
    return df.where(F.array_contains(tags_col, tag))


def listing(df: DataFrame, equals: dict | None = None, deleted_col: str | None = None,
            order: list[Column] = ()) -> DataFrame:
    """Soft-delete filter, equality filters and a multi-key sort."""
    if deleted_col:
        df = df.where(F.col(deleted_col).isNull())
    for c, v in (equals or {}).items():
        if v is not None:
            df = df.where(F.col(c) == F.lit(v))
    return df.orderBy(*order) if order else df


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page in a total order; a top-k plan, not a full sort."""
    return df.orderBy(*order).offset(offset).limit(limit)


def page_with_total(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page plus the exact count of all rows, counted apart instead of by a global window."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return page(df, order, limit, offset).withColumn("total_count", total)


def coerce_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast to the declared types; values that do not parse and 'nan' text become NULL."""
    declared = {f.name: f.dataType.simpleString() for f in schema.fields}
    cols = []
    for c in df.columns:
        if c in declared:
            cols.append(F.expr(f"try_cast(nullif(cast(`{c}` as string), 'nan') as {declared[c]})").alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


def dq_report(df: DataFrame, expected: list[str], id_cols: list[str]) -> DataFrame:
    """One row: row count, missing columns, share of NULL per id column. Raises on no rows at use."""
    missing = [c for c in expected if c not in df.columns]
    present = [c for c in id_cols if c in df.columns]
    n = F.count(F.lit(1))
    checked = df.agg(
        n.alias("row_count"),
        *[F.try_divide(F.count_if(F.col(c).isNull()) * 100.0, n).alias(f"{c}_null_pct") for c in present])
    guard = F.when(F.col("row_count") > 0, F.col("row_count")).otherwise(F.raise_error(F.lit("table is empty")))
    return checked.withColumn("row_count", guard.cast("long")).withColumn(
        "missing_columns", F.lit(",".join(missing)))


def valid_email(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")
