"""Structured Streaming forms: live figures, daily demand and the stock ledger."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larder.session import scratch_path


def file_stream(spark: SparkSession, folder: str, pattern: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.format("parquet").load(folder)


def day_summary(events: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Counts, completed, open and revenue per day. In update or append mode state older than the
    lateness is dropped; complete mode keeps a row per day, which is what the result holds anyway."""
    t, v = F.col("event_type"), F.col("value").cast("decimal(28,6)")
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness).groupBy(
        F.window("ts", "1 day")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(t == "purchase").alias("completed"),
        F.count_if(t.isin("click", "view")).alias("open"),
        F.sum(F.when(t == "purchase", v)).cast("double").alias("revenue")).select(
        F.to_date("window.start").alias("date"), "total", "completed", "open", "revenue")


def day_demand(lines: DataFrame, orders: DataFrame, lateness: str = "3650 days") -> DataFrame:
    """Quantity per order day and item from a line stream joined to the order table.

    Streams cannot count distinct orders exactly; the count is an approximation.
    """
    j = lines.join(orders, "order_id").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return j.groupBy(F.window("ts", "1 day"), "item_id").agg(
        F.sum("quantity").alias("quantity_sold"), F.approx_count_distinct("order_id").alias("order_count_approx")).select(
        F.to_date("window.start").alias("date"), "item_id", "quantity_sold", "order_count_approx")


def drain(spark: SparkSession, stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there and return the sink table.

    Each batch is written under its own id, so a repeated batch replaces itself.
    Complete mode leaves the last batch as the result, append mode all of them.
    """
    out, state = scratch_path(spark, "stream"), scratch_path(spark, "stream-state")

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch:08d}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    table = spark.read.parquet(out)
    if mode == "complete":
        last = table.agg(F.max("batch").alias("b")).scalar()
        table = table.where(F.col("batch") == last)
    return table.drop("batch")


LEDGER_OUT = "ingredient_id long, location_id long, event_id long, quantity double, quantity_before double, quantity_after double, accepted boolean"


def _apply(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    balance = state.get[0] if state.exists else 0.0
    # files of one trigger reach the key in shuffle order, so its steps are put into event order first
    pdf = pd.concat(batches).sort_values(["ts", "event_id"], kind="stable")
    before, after, ok = [], [], []
    for x in pdf["quantity"].to_numpy(dtype=float):
        before.append(balance)
        good = balance + x >= 0
        balance = balance + x if good else balance
        after.append(balance)
        ok.append(good)
    yield pdf[["ingredient_id", "location_id", "event_id", "quantity"]].assign(
        quantity_before=before, quantity_after=after, accepted=ok)
    state.update((balance,))


def stock_stream(adjustments: DataFrame) -> DataFrame:
    """Running stock per ingredient and location; steps below 0 are rejected.

    Steps of one trigger are taken by (ts, event_id), triggers in the order they arrive, as the row lock orders them.
    """
    rows = adjustments.select("ingredient_id", "location_id", "event_id", "ts", "quantity")
    return rows.groupBy("ingredient_id", "location_id").applyInPandasWithState(
        _apply, LEDGER_OUT, "balance double", "append", GroupStateTimeout.NoTimeout)
