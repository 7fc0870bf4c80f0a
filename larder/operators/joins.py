"""Named joins: orders with lines, stock status, bill of materials, nested reads, set members."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

NEST_ROWS = 1000


def orders_with_items(orders: DataFrame, lines: DataFrame) -> DataFrame:
    return orders.join(lines, orders.id == lines.order_id, "left").drop("order_id")


def inventory_status(items: DataFrame, skus: DataFrame, categories: DataFrame) -> DataFrame:
    """Items with their stock unit and its category, both optional."""
    s = skus.select(F.col("id").alias("sku_id"), "item_id", "stock_category_id", "quantity",
                    F.col("low_stock_threshold").alias("threshold"), "unit")
    c = categories.select(F.col("id").alias("stock_category_id"), F.col("title").alias("category"))
    i = items.select("id", "title")
    return i.join(s, i.id == s.item_id, "left").join(c, "stock_category_id", "left").select(
        "id", "title", "sku_id", "quantity", "threshold", "unit", "category")


def menu_ingredients(bom: DataFrame, skus: DataFrame, items: DataFrame) -> DataFrame:
    """Each bill-of-materials edge with parent, child and the item the parent is sold as."""
    parent = skus.select(F.col("id").alias("parent_sku_id"), F.col("title").alias("parent_title"), "item_id")
    child = skus.select(F.col("id").alias("sku_id"), F.col("title").alias("ingredient"), "unit")
    item = items.select(F.col("id").alias("item_id"), F.col("title").alias("menu_item"))
    return bom.join(parent, "parent_sku_id").join(child, "sku_id").join(item, "item_id", "left").select(
        "parent_sku_id", "sku_id", "parent_title", "menu_item", "ingredient", "quantity", "unit")


def bom_lookup(menu: DataFrame, text: str) -> DataFrame:
    name = F.coalesce("menu_item", "parent_title")
    return menu.withColumn("menu_item", name).where(F.lower(name).contains(text.lower()))


def enrich_dims(df: DataFrame, dims: list[tuple[DataFrame, str]]) -> DataFrame:
    """Left join of renamed dimensions, one row per key."""
    from larder.functions.exprs import first_row_per_key
    for dim, key in dims:
        df = df.join(first_row_per_key(dim, [key], []), key, "left")
    return df


def most_ordered(sales: DataFrame) -> DataFrame:
    return sales.groupBy("place_id", "item_id").agg(F.countDistinct("order_id").alias("order_count"))


def places_by_orders(most: DataFrame, places: DataFrame) -> DataFrame:
    totals = most.groupBy("place_id").agg(F.sum("order_count").alias("total_orders"))
    return places.join(totals, "place_id").orderBy(F.desc("total_orders"), "place_id")


def products_for_place(most: DataFrame, items: DataFrame, place_id, limit: int = 200) -> DataFrame:
    """Most ordered items of a place that are active or unknown to the menu."""
    return most.where(F.col("place_id") == place_id).join(items, "item_id", "left").where(
        (F.col("status") == "Active") | F.col("status").isNull()).orderBy(
        F.desc("order_count"), "item_id").limit(limit)


def top_title_semi(sales: DataFrame, n: int, place_id=None) -> DataFrame:
    """Sales of the n best-selling titles; the top-n is found first and semi-joined."""
    scope = sales if place_id is None else sales.where(F.col("place_id") == place_id)
    top = scope.groupBy("title").agg(F.sum("quantity").alias("_q")).orderBy(F.desc("_q"), "title").limit(n)
    return scope.join(top, "title", "left_semi")


def merge(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    return left.join(right, on, {"outer": "full"}.get(how, how))


def nest_children(children: DataFrame, key: str, fields: list[str], out: str = "items",
                  rows: int = NEST_ROWS) -> DataFrame:
    """Sorted arrays of children per parent; equal children are one entry with ``copies``.

    ``chunk`` k holds the entries at sorted positions k * ``rows`` to (k + 1) * ``rows`` - 1 of its parent, so chunks put
    together are in order. No array and no task grows with a hot parent: larger parents are ranked by range partitions.
    """
    from larder.functions.ranks import sorted_positions
    entries = children.groupBy(key, *fields).agg(F.count(F.lit(1)).alias("copies"))
    big = entries.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows).select(F.col(key).alias("_key"))
    is_big = F.col(key).eqNullSafe(F.col("_key"))
    small = entries.join(big, is_big, "left_anti").withColumn("chunk", F.lit(0))
    large = sorted_positions(entries.join(big, is_big, "left_semi"), key, fields, "_at").withColumn(
        "chunk", F.floor(F.col("_at") / rows).cast("int")).drop("_at")
    body = F.struct(*fields, "copies")
    return small.unionByName(large).groupBy(key, "chunk").agg(F.sort_array(F.collect_list(body)).alias(out))


def child_counts(parents: DataFrame, key: str, children: dict[str, DataFrame]) -> DataFrame:
    """Number of rows of each child table per parent, 0 where there are none."""
    for name, df in children.items():
        n = df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
        parents = parents.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return parents


def members_of(df: DataFrame, parents: DataFrame, on: list[str]) -> DataFrame:
    return df.join(parents, on, "left_semi")


def not_in(df: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    return df.join(known, on, "left_anti")


def calendar_join(days: DataFrame, weather: DataFrame, holidays: DataFrame) -> DataFrame:
    """Weather by date (unknown days are not rainy) and holiday flags for the day, its eve and its morrow."""
    w = weather.select("date", "temperature_max", "temperature_min", "precipitation_mm",
                       F.when(F.col("precipitation_mm") > 1.0, 1).otherwise(0).alias("is_rainy"))
    out = days.join(w, "date", "left").withColumn("is_rainy", F.coalesce("is_rainy", F.lit(0)))
    return holiday_flags(out, holidays)


def holiday_flags(days: DataFrame, holidays: DataFrame) -> DataFrame:
    h = holidays.groupBy("date").agg(F.max("holiday_name").alias("holiday_name"))
    eve = h.select(F.date_sub("date", 1).alias("date"), F.lit(1).alias("is_day_before_holiday"))
    morrow = h.select(F.date_add("date", 1).alias("date"), F.lit(1).alias("is_day_after_holiday"))
    out = days.join(h, "date", "left").join(eve, "date", "left").join(morrow, "date", "left")
    return out.withColumns({
        "is_holiday": F.col("holiday_name").isNotNull().cast("int"),
        "is_day_before_holiday": F.coalesce("is_day_before_holiday", F.lit(0)),
        "is_day_after_holiday": F.coalesce("is_day_after_holiday", F.lit(0)),
        "holiday_name": F.coalesce("holiday_name", F.lit(""))})


def union_catalog(first: DataFrame, second: DataFrame) -> DataFrame:
    """Union by id where the first table wins."""
    from larder.functions.exprs import first_row_per_key
    both = first.withColumn("_src", F.lit(0)).unionByName(second.withColumn("_src", F.lit(1)))
    return first_row_per_key(both, ["id"], [F.col("_src")]).drop("_src")


def upsert(base: DataFrame, updates: DataFrame, on: list[str], order_by: str | None = None) -> DataFrame:
    """Rows of ``updates`` replace those of ``base`` with the same key.

    Of several updates of a key the largest ``order_by`` stays; without one, the row that is largest column by column.
    """
    rest = [c for c in updates.columns if c not in on]
    last = F.struct(*sorted(rest, key=lambda c: c != order_by))
    latest = updates.groupBy(*on).agg(F.max(last).alias("_last")).select(*on, *[F.col(f"_last.{c}").alias(c) for c in rest]) if rest else updates.distinct()
    return base.join(latest, on, "left_anti").unionByName(latest)


def replace_children(children: DataFrame, new: DataFrame, parent: str, items: str, child: str) -> DataFrame:
    """All children of the parents in ``new`` are replaced by its exploded list, in list order."""
    kept = children.join(new, parent, "left_anti")
    fresh = new.select(parent, F.posexplode(items).alias("sort_order", child))
    return kept.unionByName(fresh.select(*kept.columns))
