"""Contiguous shards of equal byte size from global prefix sums.

Rows are range-partitioned by id and written once. Each range partition gives
one total; running totals over the partitions (one row each) shift the prefix
sums taken inside each partition, so no task sees more than its own range.
Cuts lie at equal multiples of the total: a row goes to the shard in which its
middle byte falls, so a shard misses its target by less than one row at each end.

Null ids sort first, a null text has no bytes, repeated rows are rows of their
own (ties on the id are ordered by text hash, then by input position), an empty table gives an empty
result. Input columns named like the operator's output are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from larder.llm.common import written

ADDED = ["size", "text_crc32", "shard", "slot"]


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def byte_shards(df: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", row_bytes: int = 16,
                keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default) with size, text_crc32, shard and slot; shard sizes are near equal.

    size: UTF-8 bytes of the text plus ``row_bytes``; slot: gapless position inside the shard, from 0.
    """
    if n_shards < 1 or row_bytes < 1:
        raise ValueError("n_shards and row_bytes must be positive")
    keep = [c for c in (df.columns if keep is None else keep) if c not in ADDED]
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("r"), F.col(f"`{id_col}`").alias("id"),
        (text_bytes(F.col(f"`{text_col}`")) + row_bytes).alias("size"),
        F.crc32(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("at"))
    order = ["id", "text_crc32", "at"]
    # written once: the bounds come from a sample, and a second run could draw others
    ranged = written(rows.repartitionByRange(*order).withColumn("p", F.spark_partition_id()), "shard-ranges")
    totals = ranged.groupBy("p").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    # one row per range partition; the only window without a key
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select(
        "p", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("b0"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("r0"),
        F.sum("bytes").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("p").orderBy(*order)
    b = F.col("b0") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    middle = (2 * b + F.col("size")).cast("decimal(38,0)") * n_shards
    placed = ranged.join(F.broadcast(shift), "p").withColumn(
        "shard", F.least(F.floor(middle / (2 * F.col("total"))).cast("int"), F.lit(n_shards - 1))).withColumn(
        "n", F.col("r0") + F.row_number().over(inside) - 1)
    first = placed.groupBy("shard").agg(F.min("n").alias("n0"))  # n_shards rows
    return placed.join(F.broadcast(first), "shard").select(
        *[F.col(f"r.`{c}`").alias(c) for c in keep], "size", "text_crc32", "shard", (F.col("n") - F.col("n0")).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order inside each file."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
