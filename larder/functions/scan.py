"""Prefix scans over keyed, time-ordered rows without one task per key.

Rows of a key are cut into segments of about ``target`` rows. Segment sums are
scanned per key (few rows), each segment is scanned alone, and both are added.
A key with a third of all rows is thereby spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

TARGET_ROWS = 100_000


def with_segments(df: DataFrame, keys: list[str], ts: str, slot: str = "MINUTE",
                  target: int = TARGET_ROWS) -> DataFrame:
    """Add ``_seg``: one segment for an ordinary key; a key with more than ``target``
    rows is cut into consecutive runs of time slots of about ``target`` rows each."""
    slotted = df.withColumn("_slot", F.date_trunc(slot, ts))
    sizes = slotted.groupBy(*keys, "_slot").agg(F.count(F.lit(1)).alias("_rows"))
    hot = sizes.groupBy(*keys).agg(F.sum("_rows").alias("_all")).where(F.col("_all") > target).select(*keys)
    # slots are packed inside a day and the day is part of the segment, so the
    # window below holds at most one day of slots
    day = F.to_date("_slot")
    w = Window.partitionBy(*keys, day).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    packed = sizes.join(hot, keys, "left_semi").withColumn(
        "_part", F.floor(F.coalesce(F.sum("_rows").over(w), F.lit(0)) / target)).select(
        *keys, "_slot", F.struct(day.alias("day"), F.col("_part").alias("part")).alias("_cut"))
    whole = F.struct(F.lit("1970-01-01").cast("date").alias("day"), F.lit(0).cast("long").alias("part"))
    return slotted.join(packed, [*keys, "_slot"], "left").withColumn(
        "_seg", F.coalesce("_cut", whole)).drop("_slot", "_cut")


def running_sum(df: DataFrame, keys: list[str], ts: str, tie: str, value: str | Column, out: str,
                target: int = TARGET_ROWS) -> DataFrame:
    """Inclusive running sum of ``value`` per key in (ts, tie) order."""
    v = F.col(value) if isinstance(value, str) else value
    seg = with_segments(df.withColumn("_v", v), keys, ts, target=target)
    sums = seg.groupBy(*keys, "_seg").agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(*keys, "_seg", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_carry"))
    inside = Window.partitionBy(*keys, "_seg").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    return (
        seg.withColumn("_in", F.sum("_v").over(inside))
        .join(carry, [*keys, "_seg"])
        .withColumn(out, F.col("_carry") + F.col("_in"))
        .drop("_v", "_seg", "_in", "_carry")
    )


def running_min(df: DataFrame, keys: list[str], ts: str, tie: str, value: str, out: str,
                target: int = TARGET_ROWS) -> DataFrame:
    """Inclusive running minimum of ``value`` per key in (ts, tie) order."""
    seg = with_segments(df, keys, ts, target=target)
    mins = seg.groupBy(*keys, "_seg").agg(F.min(value).alias("_m"))
    before = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    carry = mins.select(*keys, "_seg", F.min("_m").over(before).alias("_carry"))
    inside = Window.partitionBy(*keys, "_seg").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    return (
        seg.withColumn("_in", F.min(value).over(inside))
        .join(carry, [*keys, "_seg"])
        .withColumn(out, F.least("_carry", "_in"))
        .drop("_seg", "_in", "_carry")
    )
