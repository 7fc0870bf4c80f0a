"""Vector search and context text over small batches of query vectors."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from larder.functions.exprs import top_per_group

MAX_QUERIES = 1000  # query vectors carried to every row in one pass


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def squared_l2(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(d, F.lit(0.0), lambda s, v: s + v)


def _batches(queries: DataFrame, batches: int | None) -> list[Column]:
    """The queries as arrays for scalar subqueries, of about half MAX_QUERIES each unless told otherwise."""
    if batches is None:
        batches = max(1, -(-queries.count() * 2 // MAX_QUERIES))
    out = []
    for b in range(batches):
        part = queries if batches == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(batches)) == b)
        arr = F.collect_list(F.struct(*queries.columns))
        checked = F.when(F.count(F.lit(1)) <= MAX_QUERIES, arr).otherwise(
            F.raise_error(F.lit(f"more than {MAX_QUERIES} query vectors: use more batches")))
        out.append(part.agg(F.struct(checked.alias("a")).alias("q")).scalar())
    return out


def search(corpus: DataFrame, queries: DataFrame, k: int, score: str = "cosine", threshold: float | None = None,
           filter_col: str | None = None, batches: int | None = None) -> DataFrame:
    """Best k rows per query. ``queries``: query_id, vector and, with ``filter_col``, wanted.

    Each corpus row scores the small query array where it lies; only hits leave
    the row, and each task keeps its best k per query before the shuffle. Any
    number of queries is served by more batches.
    """
    fn = cosine if score == "cosine" else squared_l2
    found = None
    for arr in _batches(queries, batches):
        rows = corpus.withColumn("_all", arr["a"])
        hits = F.transform("_all", lambda q: F.struct(
            q["query_id"].alias("query_id"),
            F.when(F.lit(True) if filter_col is None else F.col(filter_col) == q["wanted"],
                   F.round(fn(F.col("embedding"), q["vector"]), 6)).alias("score")))
        hits = F.filter(hits, lambda h: h["score"].isNotNull() & (F.lit(True) if threshold is None else h["score"] >= threshold))
        one = rows.select("vec_id", F.explode(hits).alias("h")).select("h.query_id", "vec_id", "h.score")
        found = one if found is None else found.unionByName(one)
    best = F.desc("score") if score == "cosine" else F.asc("score")
    return top_per_group(found, ["query_id"], [best, F.asc("vec_id")], k)


def centroids(corpus: DataFrame, key: str) -> DataFrame:
    """Mean vector per key, one row per key."""
    parts = corpus.select(key, F.posexplode("embedding").alias("pos", "v")).groupBy(key, "pos").agg(
        F.round(F.sum(F.col("v").cast("decimal(28,12)")).cast("double") / F.count(F.lit(1)), 9).alias("m"))
    return parts.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("vector"))


def context_text(ranked: DataFrame, rules: int = 3, insights: int = 5, cut: int = 200) -> DataFrame:
    """Text per query: the first rules in full, then the first insights cut to ``cut`` characters.

    ``ranked``: query_id, kind (rule|insight), rank, label, text; at most
    ``rules`` + ``insights`` rows per query are gathered.
    """
    top = ranked.where(((F.col("kind") == "rule") & (F.col("rank") <= rules)) | ((F.col("kind") == "insight") & (F.col("rank") <= insights)))
    line = F.when(F.col("kind") == "rule", F.concat(F.lit("- "), "text")).otherwise(
        F.concat(F.lit("- ["), "label", F.lit("] "), F.substring("text", 1, cut), F.lit("...")))
    lines = top.groupBy("query_id", "kind").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))), lambda s: s["line"]), "\n").alias("body"))
    body = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("body")))
    return lines.groupBy("query_id").agg(F.concat_ws(
        "\n", F.when(body("rule").isNotNull(), F.concat(F.lit("**Relevant Business Rules:**\n"), body("rule"))),
        F.when(body("insight").isNotNull(), F.concat(F.lit("\n**Recent Related Insights:**\n"), body("insight")))).alias("context"))


# fixed values: the rules a new installation starts with, and their data
DEFAULT_RULES = [
    ("low_stock_threshold", "Item is considered low stock when quantity falls below threshold",
     {"default_days_of_supply": 3, "alert_level": "warning", "action": "reorder"}),
    ("expiry_alert_windows", "Alert windows for expiring inventory",
     {"critical_days": 2, "warning_days": 5, "caution_days": 7,
      "actions": {"critical": "immediate_promotion_or_use", "warning": "plan_promotion", "caution": "monitor"}}),
    ("waste_thresholds", "Acceptable waste levels by category",
     {"produce": 0.08, "dairy": 0.05, "meat": 0.03, "prepared_food": 0.10, "default": 0.05}),
    ("promotion_rules", "Rules for automatic promotion suggestions",
     {"min_margin_after_discount": 0.10, "max_discount_percentage": 0.50, "bundle_discount_limit": 0.30}),
    ("forecast_accuracy", "Acceptable forecast deviation thresholds",
     {"excellent": 0.10, "good": 0.20, "acceptable": 0.30, "needs_review": 0.50}),
]
RULE = "rule_name string, description string, rule_data string"


def default_rules(spark) -> DataFrame:
    """The rules with their data as JSON text."""
    return spark.createDataFrame([(n, d, json.dumps(x)) for n, d, x in DEFAULT_RULES], RULE)


def upsert_rules(rules: DataFrame, new: DataFrame) -> DataFrame:
    """Rules by name; a new one replaces the one of its name, text and data together."""
    from larder.operators.joins import upsert
    return upsert(rules, new, ["rule_name"])
