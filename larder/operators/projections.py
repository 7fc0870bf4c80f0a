"""Column summaries of the catalog and of campaigns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

CATALOG = ["id", "title", "price", "status", "type"]
CAMPAIGN = ["id", "title", "status", "type", "start_date_time_dt", "end_date_time_dt", "place_id"]


def catalog_summary(items: DataFrame) -> DataFrame:
    """The catalog columns a table has, in their fixed order."""
    return items.select(*[c for c in CATALOG if c in items.columns])


def campaign_summary(campaigns: DataFrame) -> DataFrame:
    """Campaign columns with both ends as timestamps: the parsed column where there is one, else the raw one; null where neither parses."""
    for end in ("start_date_time", "end_date_time"):
        raw = [F.try_to_timestamp(F.col(c).cast("string")) for c in (f"{end}_dt", end) if c in campaigns.columns]
        if raw:
            campaigns = campaigns.withColumn(f"{end}_dt", raw[0])
    return campaigns.select(*[c for c in CAMPAIGN if c in campaigns.columns])
