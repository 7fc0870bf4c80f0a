"""Row-level formats and flags: currency text, tiers, perishables, carts, labels, recipe text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from larder.functions.exprs import col, exact_sum
from larder.functions.ranks import sorted_index
from larder.operators.joins import nest_children

# fixed values: the three word lists that mark an item as perishable
PERISHABLE_WORDS = {
    "waste": ["salad", "juice", "shake", "fresh", "smoothie", "sandwich", "bowl", "wrap"],
    "forecast": ["salad", "juice", "shake", "fresh", "smoothie", "sandwich", "bowl", "wrap", "sushi", "bread"],
    "history": ["salad", "juice", "fresh", "smoothie", "sandwich", "bowl", "wrap", "acai", "egg"],
}


def percentage_change(old, new) -> Column:
    """Change in percent; NULL for a zero base."""
    return F.try_divide((col(new) - col(old)) * 100, col(old))


def performance_tier(value, low: float = 50, medium: float = 70, high: float = 90) -> Column:
    v = col(value)
    return F.when(v < low, "poor").when(v < medium, "fair").when(v < high, "good").otherwise("excellent")


def currency(value, unit: str = "DKK") -> Column:
    return F.concat(F.lit(f"{unit} "), F.format_number(col(value), 2))


def short_dkk(value) -> Column:
    v = col(value)
    return (F.when(F.abs(v) >= 1e6, F.concat(F.format_number(v / 1e6, 1), F.lit("M DKK")))
            .when(F.abs(v) >= 1e3, F.concat(F.format_number(v / 1e3, 0), F.lit("K DKK")))
            .otherwise(F.concat(F.format_number(v, 0), F.lit(" DKK"))))


def cart_totals(lines: DataFrame) -> DataFrame:
    """Cents per order: subtotal, 5 % tax rounded half up, total, item count."""
    s = lines.groupBy("order_id").agg(F.sum(F.col("price_cents") * F.col("quantity")).cast("long").alias("subtotal"),
                                      F.sum("quantity").cast("long").alias("item_count"))
    tax = F.floor((F.col("subtotal") + 10) / 20).cast("long")
    return s.withColumn("tax", tax).withColumn("total", F.col("subtotal") + F.col("tax"))


def label_encode(df: DataFrame, fitted: DataFrame, column: str, out: str) -> DataFrame:
    """Position of the value among the sorted values seen in fitting; unseen values give -1."""
    labels = sorted_index(fitted.select(F.col(column).cast("string").alias("_label")), "_label", out)
    return df.join(labels, F.col(column).cast("string") == F.col("_label"), "left").drop("_label").withColumn(
        out, F.coalesce(out, F.lit(-1)))


def recipe_text(edges: DataFrame) -> DataFrame:
    """'name: ingredient quantityunit, ...' per recipe; very long recipes come in chunks."""
    n = nest_children(edges, "recipe", ["ingredient", "quantity", "unit"], "parts")
    part = F.transform("parts", lambda p: F.concat(p["ingredient"], F.lit(" "), p["quantity"].cast("string"), p["unit"]))
    return n.select("recipe", "chunk", F.concat("recipe", F.lit(": "), F.array_join(part, ", ")).alias("text"))
