"""Frames that many registered queries start from."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from larder.operators import baselines, demand, features
from larder.session import scratch_path
from larder.sources import bindings

_MADE: dict[tuple, DataFrame] = {}


def per_session(fn):
    """Build a lazy frame once per application and argument list; queries share its plan."""

    def wrap(spark, *args, **kw):
        key = (fn.__module__, fn.__name__, spark.sparkContext.applicationId, args, tuple(sorted(kw.items())))
        if key not in _MADE:
            _MADE[key] = fn(spark, *args, **kw)
        return _MADE[key]

    return wrap


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: a short plan that outlives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@per_session
def orders(spark, sf, grain="region") -> DataFrame:
    """Cleaned closed orders. Order keys are unique in the source, so no dedup shuffle is spent here."""
    return bindings.fct_orders(spark, sf, grain).where(F.col("status") == "Closed")


@per_session
def lines(spark, sf, grain="region") -> DataFrame:
    return bindings.fct_order_items(spark, sf, grain)


@per_session
def sales(spark, sf, grain="region") -> DataFrame:
    return demand.sales_lines(orders(spark, sf, grain), lines(spark, sf, grain), parts=bindings.line_tasks(spark, sf))


@per_session
def daily(spark, sf, grain="region") -> DataFrame:
    """The demand cube, kept in the session: far smaller than the order lines it sums, and read
    several times by each grid. Lost blocks are recomputed from their lineage."""
    tasks = bindings.line_tasks(spark, sf)
    return demand.daily_demand(orders(spark, sf, grain), lines(spark, sf, grain), parts=tasks).persist(StorageLevel.MEMORY_AND_DISK)


@per_session
def grid(spark, sf, grain="region", top_n=None) -> DataFrame:
    """Every series on every day; only ``top_n`` leaves series out."""
    return demand.date_grid(daily(spark, sf, grain), top_n)


def enriched(df: DataFrame, spark, sf, grain="region") -> DataFrame:
    """Item and place attributes by left join; Spark broadcasts them when they are small."""
    items = bindings.dim_items(spark, sf, grain).select(
        F.col("id").alias("item_id"), F.col("title").alias("item_name"),
        F.col("price").alias("item_price"), F.col("type").alias("item_type"))
    places = bindings.dim_places(spark, sf, grain).select(
        F.col("id").alias("place_id"), F.col("title").alias("store_name"))
    return df.join(items, "item_id", "left").join(places, "place_id", "left")


@per_session
def features_frame(spark, sf, grain="region") -> DataFrame:
    return features.rolling_features(features.lag_features(grid(spark, sf, grain)))


@per_session
def predictions(spark, sf, grain="region") -> DataFrame:
    """Grid with the baseline forecasts as columns, item and place attributes; kept in the
    session, because every metric, waste and promotion query reads it."""
    f = features_frame(spark, sf, grain)
    f = baselines.naive_last_week(f)
    f = baselines.moving_average(f, 7, "predicted")
    f = baselines.moving_average(f, 28, "ma28")
    f = baselines.buffered(f, "predicted")
    return enriched(f, spark, sf, grain).withColumn("day_of_week", F.weekday("date")).persist(StorageLevel.MEMORY_AND_DISK)


def campaign_days(spark, sf) -> DataFrame:
    from larder.operators import promo
    return promo.promo_days(bindings.campaigns(spark, sf))
