"""Similar-item statistics and demand estimates for products without history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from larder.functions.exprs import exact_mean, exact_sum, rnd


def title_days(sales: DataFrame) -> DataFrame:
    return sales.groupBy(F.col("title").alias("item"), "date").agg(F.sum("quantity").alias("qty"))


def item_stats(days: DataFrame, min_days: int = 5) -> DataFrame:
    """Mean, deviation, quartiles, active days and last day per item; a title has one row per day."""
    q = F.percentile("qty", F.array(F.lit(0.25), F.lit(0.75)))
    return days.groupBy("item").agg(
        exact_mean("qty").alias("avg_daily"), F.stddev_samp("qty").alias("std_daily"), q.alias("_q"),
        F.count(F.lit(1)).alias("active_days"), F.max("date").alias("last_sale")
    ).where(F.col("active_days") >= min_days).select(
        "item", "avg_daily", "std_daily", F.col("_q")[0].alias("p25"), F.col("_q")[1].alias("p75"), "active_days", "last_sale")


def keywords(name: str | Column, category: str | Column | None = None, limit: int = 5) -> Column:
    """Lower-case words of more than two letters and the category, the first five of them."""
    n = F.col(name) if isinstance(name, str) else name
    words = F.filter(F.split(F.lower(n), " "), lambda w: F.length(w) > 2)
    if category is not None:
        c = F.col(category) if isinstance(category, str) else category
        words = F.concat(words, F.when(c.isNotNull(), F.array(F.lower(c))).otherwise(F.array().cast("array<string>")))
    return F.slice(words, 1, limit)


def match_titles(words: DataFrame, titles: DataFrame, title: str = "item") -> DataFrame:
    """Pairs (word, title) where the lower-case title contains the word.

    A word can only be inside a title that has the word's first three characters
    somewhere, so the pairs meet in an equi-join and the containment is checked after. Titles are dealt anew, for a small
    file of them is one task, and give each gram once, at its first place, of the lengths that words begin with.
    """
    w = words.select("word", F.substring("word", 1, 3).alias("_g")).where(F.length("word") > 0).distinct()
    sizes = w.agg(F.collect_set(F.length("_g")).alias("n")).scalar()
    t = titles.select(title, F.lower(title).alias("_l")).repartition(title).select(title, "_l", F.explode(sizes).alias("_n")).where(
        "length(_l) >= _n").select(title, "_l", "_n", F.explode(F.sequence(F.lit(1), F.length("_l") - F.col("_n") + 1)).alias("_i"))
    t = t.select(title, "_l", "_i", F.substring("_l", F.col("_i"), F.col("_n")).alias("_g")).where(F.position(F.col("_g"), F.col("_l")) == F.col("_i"))
    return w.join(t, "_g").where(F.col("_l").contains(F.col("word"))).select("word", title)


DAY_FACTORS = {5: 0.8, 6: 0.8, 4: 1.1}  # fixed values: weekend and Friday, weekday 0 is Monday


def _set_estimates(sets: DataFrame, keys: str, hits: DataFrame, key: str, tier: int, limit: int) -> DataFrame:
    """For each set of keys the weighted mean and count of the best ``limit`` items of all its keys; ``hits``: key, item, avg_daily."""
    a = F.col("avg_daily")
    of_key = hits.groupBy(key).agg(F.collect_list(F.struct(a.isNull().alias("unknown"), (-a).alias("order"), "item", "avg_daily")).alias("_h"))
    # a left join: the sets are never the side that is sent to every task
    all_of = sets.select(keys, F.explode(keys).alias(key)).join(of_key, key, "left").groupBy(keys).agg(F.flatten(F.collect_list("_h")).alias("_h"))
    best = all_of.select(keys, F.explode(F.slice(F.array_sort(F.array_distinct("_h")), 1, limit)).alias("_h")).select(keys, "_h.avg_daily")
    return best.groupBy(keys).agg(F.struct(
        F.lit(tier).alias("tier"), F.try_divide(exact_sum(a * a, 9), exact_sum(a, 9)).alias("weighted"), F.count(F.lit(1)).alias("similar")).alias(f"_t{tier}"))


def cold_start(new_products: DataFrame, stats: DataFrame, categories: DataFrame, first_day: Column, days: int = 7,
               limit: int = 20, factor: float = 0.7) -> DataFrame:
    """Demand estimate for new products from items that share a word, else the category, else all items.

    ``new_products``: id, words (array), category. ``stats`` has one row per menu
    title and ``categories`` maps titles (item) to categories.
    """
    from larder.functions.exprs import top_per_group
    known = stats.select("item", "avg_daily")
    best_first = [F.desc("avg_daily"), F.asc("item")]
    # the best 20 of a product lie within the best 20 of its words, so each word is cut first
    words = new_products.select(F.explode("words").alias("word")).distinct()
    hits = match_titles(words, known).join(known, "item")
    hits = top_per_group(hits, ["word"], best_first, limit).drop("rank")
    in_cat = categories.distinct().join(known, "item")
    in_cat = top_per_group(in_cat, ["category"], best_first, limit).drop("rank")
    # products of the same words, or of one category, share an estimate: each is made once, however many they are
    products = new_products.where("id IS NOT NULL").groupBy("id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("words")))).alias("_words"), F.array_sort(F.collect_set("category")).alias("_cats"))
    by_word = _set_estimates(products.select("_words").distinct(), "_words", hits, "word", 1, limit)
    by_cat = _set_estimates(products.select("_cats").distinct(), "_cats", in_cat, "category", 2, limit)
    best = products.join(by_word, "_words", "left").join(by_cat, "_cats", "left").select("id", F.coalesce("_t1", "_t2").alias("t"))
    everything = stats.agg(exact_mean("avg_daily", 9).alias("m")).scalar()
    est = new_products.join(best, "id", "left").select(
        "id", F.coalesce(F.col("t.weighted"), everything).alias("_w"),
        F.coalesce("t.similar", F.lit(1)).alias("similar_items"),
        F.when(F.col("t.tier") == 1, "keyword_match").when(F.col("t.tier") == 2, "category_match")
        .otherwise("global_median").alias("method"))
    future = est.withColumn("_e", F.col("_w") * factor).withColumn("date", F.explode(
        F.sequence(first_day, F.date_add(first_day, days - 1), F.expr("interval 1 day"))))
    dow = F.weekday("date")
    f = F.when(dow >= 5, 0.8).when(dow == 4, 1.1).otherwise(1.0)
    p = F.col("_e") * f
    return future.select("id", "method", "similar_items", rnd("_e", 4).alias("estimated_daily_demand"), "date",
                         rnd(p, 4).alias("predicted_quantity"), rnd(p * 0.6, 4).alias("lower_bound"), rnd(p * 1.5, 4).alias("upper_bound"))
