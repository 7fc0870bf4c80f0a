"""Streams whose result does not depend on how events fall into triggers: steps wait for the watermark and are taken in event order.

The state of a key is kept by Spark's RocksDB state store. Events that are later than the watermark allows are dropped by Spark, so a
stream gives the batch result as long as its lateness covers the disorder of its files.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StructField, StructType

from larder.operators.ledger import UNIT, rejecting_ledger
from larder.session import scratch_path

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _rocks(spark: SparkSession):
    """Timers and typed state need this store."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _millis(micros: int) -> int:
    return micros // 1000


# ---- stock ledger ---------------------------------------------------------------------

LEDGER = ["ingredient_id", "location_id"]
LEDGER_OUT = "ingredient_id long, location_id long, event_id long, quantity double, quantity_before double, quantity_after double, accepted boolean"
_STEP = "at long, event_id long, units long"


class Ledger(StatefulProcessor):
    """Balance of a key; its steps wait in the state until the watermark has passed them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.balance = handle.getValueState("balance", "units long")
        self.waiting = handle.getListState("waiting", _STEP)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        steps = [(r["at"], r["event_id"], r["units"]) for r in rows]
        self.waiting.appendList(steps)
        self.handle.registerTimer(_millis(min(s[0] for s in steps)))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = timerValues.getCurrentWatermarkInMs()
        steps = sorted(tuple(s) for s in self.waiting.get())
        due = [s for s in steps if _millis(s[0]) < until]
        rest = steps[len(due):]
        balance = self.balance.get()[0] if self.balance.exists() else 0
        for _, event, x in due:
            good = x is not None and balance + x >= 0
            after = balance + x if good else balance
            yield Row(ingredient_id=key[0], location_id=key[1], event_id=event, quantity=None if x is None else x / UNIT,
                      quantity_before=balance / UNIT, quantity_after=after / UNIT, accepted=good)
            balance = after
        self.balance.update((balance,))
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(_millis(rest[0][0]))
        else:
            self.waiting.clear()

    def close(self) -> None:
        pass


def ledger_stream(adjustments: DataFrame, lateness: str) -> DataFrame:
    """Running stock per ingredient and location in the order of (ts, event_id), whatever file or trigger a step comes with.

    A step that would go below 0, or that has no finite quantity, is rejected. A step is written once the watermark, ``lateness``
    behind the latest event, has passed it.
    """
    q = F.col("quantity").cast("double")
    finite = ~F.isnan(q) & (F.abs(q) < float("inf"))
    rows = adjustments.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness).select(
        *LEDGER, "ts", "event_id", F.unix_micros("ts").alias("at"), F.when(finite, F.round(q * UNIT)).cast("long").alias("units"))
    return rows.groupBy(*LEDGER).transformWithState(Ledger(), LEDGER_OUT, "Append", "EventTime")


def run_ledger(spark: SparkSession, adjustments: DataFrame, lateness: str) -> DataFrame:
    """The ledger of all there is: what the stream has released, and the steps still waiting for the watermark, taken after it."""
    with _rocks(spark):
        released, state = drain(spark, ledger_stream(adjustments, lateness))
        read = spark.read.format("statestore")
        key = [F.col(f"key.{c}").alias(c) for c in LEDGER]
        waiting = read.option("stateVarName", "waiting").load(state).select(*key, F.col("list_element.*"))
        balance = read.option("stateVarName", "balance").load(state).select(*key, F.col("value.units").alias("units"))
        # the balance reached so far enters as a step before all others
        opening = balance.select(*LEDGER, F.lit(-(1 << 62)).cast("long").alias("at"), F.lit(-1).cast("long").alias("event_id"), "units", F.lit(True).alias("opening"))
        steps = opening.unionByName(waiting.select(*LEDGER, "at", "event_id", "units", F.lit(False).alias("opening")))
        steps = steps.withColumn("quantity", F.col("units") / UNIT)
        closed = rejecting_ledger(steps, LEDGER, "at", "event_id", "quantity").where("NOT opening")
    names = released.drop("batch").columns
    return released.select(*names).unionByName(closed.select(*names))


# ---- open orders ------------------------------------------------------------------------

BOARD_OUT = "order_id long, status string, last_change timestamp, tier string, seq long, gone boolean"
TIERS = {"normal": 0, "amber": 2, "red": 5}  # minutes since the last change


class Board(StatefulProcessor):
    """Latest status of an order; a row for every change of its status or tier, and one when it leaves the board."""

    def __init__(self, shown: list[str]):
        self.shown = shown

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, event_id long, status string, seq long")

    def _row(self, key, last, tier: str, gone: bool) -> Row:
        at = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=last[0])
        return Row(order_id=key[0], status=last[2], last_change=at, tier=tier, seq=last[3], gone=gone)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        newest = max(((r["at"], r["event_id"], r["status"]) for r in rows), key=lambda r: r[:2])
        old = tuple(self.last.get()) if self.last.exists() else None
        if old is not None and newest[:2] <= old[:2]:
            return
        last = (*newest, old[3] + 1 if old else 0)
        self.last.update(last)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        shown = last[2] in self.shown
        if shown:
            for minutes in list(TIERS.values())[1:]:
                self.handle.registerTimer(_millis(last[0]) + minutes * 60_000 - 1)  # due when the watermark is past it
        if shown or old is not None:
            yield self._row(key, last, "normal", not shown)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last = tuple(self.last.get())
        minutes = (expiredTimerInfo.getExpiryTimeInMs() + 1 - _millis(last[0])) // 60_000
        tier = {m: t for t, m in TIERS.items()}.get(minutes)
        if tier is None:
            return
        last = (*last[:3], last[3] + 1)
        self.last.update(last)
        yield self._row(key, last, tier, False)

    def close(self) -> None:
        pass


def board_stream(status_events: DataFrame, shown: list[str], lateness: str) -> DataFrame:
    """Changes of the board of open orders: (order_id, status, last_change, tier, seq, gone).

    An event older than the order's latest changes nothing. Tiers turn by event time, when the watermark reaches two and five minutes
    after the last change; an order whose status is not in ``shown`` leaves the board.
    """
    rows = status_events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness).select(
        "order_id", "ts", "event_id", F.unix_micros("ts").alias("at"), "status")
    return rows.groupBy("order_id").transformWithState(Board(shown), BOARD_OUT, "Update", "EventTime")


def run_board(spark: SparkSession, status_events: DataFrame, shown: list[str], lateness: str) -> DataFrame:
    """The board after all there is: the last change of each order that has not left."""
    with _rocks(spark):
        changes, _ = drain(spark, board_stream(status_events, shown, lateness), "update")
    last = changes.groupBy("order_id").agg(F.max_by(F.struct("status", "last_change", "tier", "gone"), "seq").alias("x"))
    return last.where("NOT x.gone").select("order_id", "x.status", "x.last_change", "x.tier")


# ---- daily demand -----------------------------------------------------------------------

def demand_stream(lines: DataFrame, orders: DataFrame, lateness: str) -> DataFrame:
    """Quantity so far per order day, item and order, of every order a trigger adds to."""
    j = lines.join(orders, "order_id").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return j.groupBy(F.window("ts", "1 day"), "item_id", "order_id").agg(F.sum("quantity").alias("quantity")).select(
        F.to_date("window.start").alias("date"), "item_id", "order_id", "quantity")


def run_demand(spark: SparkSession, lines: DataFrame, orders: DataFrame, lateness: str) -> DataFrame:
    """Demand and exact number of orders per day and item: the newest quantity of each order, summed."""
    made, _ = drain(spark, demand_stream(lines, orders, lateness), "update")
    newest = made.groupBy("date", "item_id", "order_id").agg(F.max_by("quantity", "batch").alias("quantity"))
    return newest.groupBy("date", "item_id").agg(F.sum("quantity").alias("quantity_sold"), F.count(F.lit(1)).alias("order_count"))


# ---- sink -------------------------------------------------------------------------------

def drain(spark: SparkSession, stream: DataFrame, mode: str = "append") -> tuple[DataFrame, str]:
    """Run a stream over all that is there: (its rows with the ``batch`` that wrote them, the folder of its state). Each batch is
    written under its own id, so a repeated one replaces itself."""
    out, state = scratch_path(spark, "stream"), scratch_path(spark, "stream-state")
    schema = StructType([*stream.schema.fields, StructField("batch", IntegerType())])

    def write(df: DataFrame, no: int) -> None:
        df.withColumn("batch", F.lit(no)).write.mode("overwrite").parquet(f"{out}/no-{no:08d}")

    spark.createDataFrame([], schema).write.parquet(f"{out}/none")  # a stream without batches has no rows
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(out), state
