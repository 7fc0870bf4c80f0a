"""Exact linear-interpolated quantiles that never gather a whole group.

``percentile`` keeps every distinct value of a group in one task. Here a
mergeable sketch first gives a narrow value range around each wanted rank; the
rows below and above it shrink to one counted row each on the map side, and only
the values inside the range are ranked. The ranges of the largest groups travel
to the rows, so no group's rows meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

ACCURACY = 100_000
LARGE_GROUPS = 64


def exact_quantiles(df: DataFrame, value: str, qs: dict[str, float], keys: list[str] | None = None,
                    accuracy: int = ACCURACY) -> DataFrame:
    """One row per group with one column per named quantile of ``value``.

    The sketch's rank error is at most n / accuracy; the range is twice as wide on
    each side, so the wanted ranks lie inside it or next to it.
    """
    keys = list(keys or [])
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    slack = 2.0 / accuracy
    ends = [p for q in qs.values() for p in (max(0.0, q - slack), min(1.0, q + slack))]
    sketch = F.percentile_approx("_v", ends, accuracy)
    facts = F.struct(sketch.alias("ends"), F.count(F.lit(1)).alias("n"))
    if keys:
        # any other group has less than 1 / LARGE_GROUPS of the rows
        rows = rows.where(F.forall(F.array(*[F.col(k).isNotNull() for k in keys]), lambda known: known))
        each = rows.groupBy(*keys).agg(facts.alias("_s"))
        entry = F.struct(F.struct(*keys).alias("key"), F.col("_s").alias("value"))
        large = each.orderBy(F.desc("_s.n"), *keys).limit(LARGE_GROUPS).agg(F.map_from_entries(F.collect_list(entry)).alias("m")).scalar()
        sent = rows.withColumn("_s", F.try_element_at(large, F.struct(*keys)))
        rest = sent.where("_s IS NULL").drop("_s").join(each, keys)
        ranged = sent.where("_s IS NOT NULL").unionByName(rest)
    else:
        # one row for the whole table: a scalar subquery, not a join without a key
        ranged = rows.withColumn("_s", rows.agg(facts.alias("s")).scalar())
    wanted = F.array(*[
        F.struct(F.lit(name).alias("name"), F.col("_s.ends")[2 * i].alias("lo"), F.col("_s.ends")[2 * i + 1].alias("hi"),
                 (F.lit(q) * (F.col("_s.n") - 1)).alias("pos")) for i, (name, q) in enumerate(qs.items())])
    side = F.when(F.col("_v") < F.col("_w.lo"), 0).when(F.col("_v") > F.col("_w.hi"), 2).otherwise(1)
    gk = [*keys, "_name"]
    counted = (
        ranged.select(*keys, "_v", F.explode(wanted).alias("_w"))
        .select(*keys, F.col("_w.name").alias("_name"), F.col("_w.pos").alias("_pos"), side.alias("_side"), "_v")
        .groupBy(*gk, "_pos", "_side", F.when(F.col("_side") == 1, F.col("_v")).alias("_inside"))
        .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    )
    upto = Window.partitionBy(*gk).orderBy("_side", "_inside").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counted.withColumn("_start", F.coalesce(F.sum("_c").over(upto), F.lit(0))).withColumn(
        "_rank", F.explode(F.array_distinct(F.array(F.floor("_pos"), F.ceil("_pos"))))).where(
        (F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_start") + F.col("_c")))
    at = (F.when(F.col("_min") == F.col("_max"), F.col("_min"))
          .when(F.col("_rank") == F.col("_start"), F.col("_min"))
          .when(F.col("_rank") == F.col("_start") + F.col("_c") - 1, F.col("_max"))
          .otherwise(F.raise_error(F.lit("quantile range missed its rank")).cast("double")))
    found = ranked.withColumn("_x", at)
    cols = []
    for n in qs:
        mine = lambda c: F.when(F.col("_name") == n, F.col(c))
        low, high, pos = F.min(mine("_x")), F.max(mine("_x")), F.max(mine("_pos"))
        cols.append((low + (high - low) * (pos - F.floor(pos))).alias(n))
    return found.groupBy(*keys).agg(*cols).select(*keys, *qs)
