"""Dense position of distinct values in sorted order, without a one-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from larder.session import materialise


def sorted_index(values: DataFrame, column: str, out: str) -> DataFrame:
    """Distinct non-null values of ``column`` with their 0-based sorted position.

    Values are range-partitioned; each partition is ranked alone and shifted by
    the sizes of the partitions before it (one row per partition). The ranges
    are written once, since two runs of the range sampling could differ.
    """
    distinct = values.select(column).where(F.col(column).isNotNull()).distinct()
    ranged = materialise(
        distinct.repartitionByRange(column).select(column, F.spark_partition_id().alias("_p")))
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: the list of sizes is small by construction
    shift = sizes.select("_p", F.coalesce(
        F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_shift"))
    local = F.row_number().over(Window.partitionBy("_p").orderBy(column)) - 1
    return ranged.withColumn("_i", local).join(F.broadcast(shift), "_p").select(
        column, (F.col("_i") + F.col("_shift")).cast("long").alias(out))


def sorted_positions(df: DataFrame, key: str, columns: list[str], out: str) -> DataFrame:
    """Rows with their 0-based position among those of their key, sorted by ``columns``, which differ in each row of a key.

    A key may span many ranges: positions are counted within each range and shifted by the key's rows in the ranges before.
    """
    ranged = materialise(df.repartitionByRange(key, *columns).withColumn("_p", F.spark_partition_id()))
    before = Window.partitionBy(key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    # one row per key and range
    shift = ranged.groupBy(key, "_p").agg(F.count(F.lit(1)).alias("_n")).select(
        F.col(key).alias("_key"), F.col("_p").alias("_range"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    local = F.row_number().over(Window.partitionBy(key, "_p").orderBy(*columns)) - 1
    return ranged.withColumn("_i", local).join(shift, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_p") == F.col("_range"))).withColumn(
        out, F.col("_i") + F.col("_shift")).drop("_i", "_p", "_key", "_range", "_shift")
