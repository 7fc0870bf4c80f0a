"""Promotion calendar: campaign days, daily calendar, recency."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window


def promo_days(campaigns: DataFrame) -> DataFrame:
    """One row per campaign and active day, both ends included; inverted or open intervals give none."""
    good = campaigns.where(F.col("start_date").isNotNull() & (F.col("end_date") >= F.col("start_date")))
    return good.select(
        F.explode(F.sequence("start_date", "end_date", F.expr("interval 1 day"))).alias("date"),
        "place_id", "campaign_id", F.coalesce("discount", F.lit(0.0)).alias("discount"),
        F.coalesce("type", F.lit("unknown")).alias("type"))


def promo_calendar(days: DataFrame) -> DataFrame:
    """Campaign count, largest discount and first type per place and day."""
    return days.where(F.col("place_id").isNotNull()).groupBy("date", "place_id").agg(
        F.count(F.lit(1)).alias("campaign_count"), F.max("discount").alias("discount_percentage"),
        F.min_by("type", "campaign_id").alias("promotion_type")).withColumn("is_promotion_active", F.lit(1))


def promo_recency(place_days: DataFrame) -> DataFrame:
    """Days since the last and until the next promotion day of the place, both strict; -1 if none.

    Needs one row per place and day with ``is_promotion_active``; a place has one
    row per calendar day, so the window is bounded by the calendar.
    """
    w = Window.partitionBy("place_id").orderBy("date")
    hit = F.when(F.col("is_promotion_active") == 1, F.col("date"))
    last = F.last(hit, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    nxt = F.first(hit, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return place_days.withColumns({
        "days_since_last_promotion": F.coalesce(F.datediff("date", last), F.lit(-1)),
        "days_until_next_promotion": F.coalesce(F.datediff(nxt, "date"), F.lit(-1))})


def add_promotion_features(df: DataFrame, calendar: DataFrame) -> DataFrame:
    """Calendar columns by left join with their fills, and recency per place-day."""
    days = df.select("date", "place_id").distinct().join(calendar, ["date", "place_id"], "left").withColumns({
        "is_promotion_active": F.coalesce("is_promotion_active", F.lit(0)),
        "discount_percentage": F.coalesce("discount_percentage", F.lit(0.0)),
        "promotion_type": F.coalesce("promotion_type", F.lit("")),
        "campaign_count": F.coalesce("campaign_count", F.lit(0))})
    return df.join(promo_recency(days), ["date", "place_id"], "left")
