"""Balances from append-only event logs: floored, rejecting and plain ledgers.

Ranges of (key, time) keep a hot key spread over many tasks; floored balances scan segments (see functions.scan).
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from larder.functions.scan import TARGET_ROWS, running_min, running_sum, with_segments
from larder.session import materialise


def floored_ledger(events: DataFrame, keys: list[str], ts: str, tie: str, delta: str,
                   target: int = TARGET_ROWS) -> DataFrame:
    """Balance that never falls below 0: each step is max(0, balance + delta).

    Closed form: running sum minus its running minimum below 0, so two prefix scans do.
    """
    s = running_sum(events, keys, ts, tie, F.col(delta).cast("decimal(28,6)"), "_s", target)
    s = s.withColumn("_prev", F.col("_s") - F.col(delta).cast("decimal(28,6)"))
    m = running_min(s, keys, ts, tie, "_prev", "_m", target)
    before = F.col("_prev") - F.least(F.col("_m"), F.lit(0))
    return m.withColumn("quantity_before", before.cast("double")).withColumn(
        "quantity_after", F.greatest(before + F.col(delta).cast("decimal(28,6)"), F.lit(0)).cast("double")).drop("_s", "_prev", "_m")


# A step x turns balance b into b + x where that is at least 0, else it is rejected. Over a stretch of steps the exit is
# a piecewise map of the entry: from each threshold on, entry plus an offset. Such maps chain, so the stretches of a key in
# different partitions are folded side by side as soon as their entries are known. Amounts are whole UNITs, sums exact.
UNIT = 1_000_000


def _runs(batch: pa.RecordBatch, keys: list[str], delta: str) -> Iterator[tuple[tuple, list[int | None]]]:
    """(key, its steps) of the runs of equal keys in a batch; None is a step without an amount, which is rejected."""
    x = batch.column(delta).to_numpy(zero_copy_only=False).astype(float)
    bad = ~np.isfinite(x)
    units = np.round(np.where(bad, 0.0, x) * UNIT).astype(np.int64).tolist()
    for i in np.flatnonzero(bad):
        units[i] = None
    names, start = list(zip(*[batch.column(k).to_pylist() for k in keys])), 0
    for i in range(1, len(names) + 1):
        if i == len(names) or names[i] != names[start]:
            yield names[start], units[start:i]
            start = i


def exit_map(thresholds: np.ndarray, offsets: np.ndarray, most: int, units: list[int | None]) -> tuple[np.ndarray, np.ndarray]:
    """The map of entries from 0 to ``most`` after further steps: thresholds (the first is 0) and the offset from each on."""
    t, c = thresholds, offsets
    for x in units:
        if x is None or x >= 0:
            c = c + (x or 0)
            continue
        able = -x - c  # entries from here on can bear the step
        end = np.append(t[1:], most + 1)
        cut = (able > t) & (able < end)
        after = np.where(able <= t, c + x, c)
        if cut.any():
            at = np.flatnonzero(cut) + 1
            t, c = np.insert(t, at, able[cut]), np.insert(after, at, (c + x)[cut])
        else:
            c = after
        if len(t) > 1:
            new = np.append(True, c[1:] != c[:-1])
            t, c = t[new], c[new]
    return t, c


def _reach(keys: list[str], delta: str):
    """Of each partition's first and last key: a and m such that entries up to u lead to balances up to max(u + a, m) at most."""
    def run(batches):
        part, ends, kinds = 0, [], None
        for batch in batches:
            part = batch.column("_part")[0].as_py() if batch.num_rows else part
            kinds = [batch.schema.field(k).type for k in keys]
            for key, units in _runs(batch, keys, delta):
                if not ends or ends[-1][0] != key:
                    ends = [*ends[:1], [key, 0, 0]]
                a, m = ends[-1][1:]
                for x in units:
                    if x is not None:
                        a, m = a + x, max(m + x, -x, 0)
                ends[-1][1:] = a, m
        if ends:
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(ends), pa.int32()), *[pa.array([e[0][i] for e in ends], t) for i, t in enumerate(kinds)],
                 pa.array([e[1] for e in ends], pa.int64()), pa.array([e[2] for e in ends], pa.int64())], names=["part", *keys, "a", "m"])

    return run


def _maps(keys: list[str], delta: str, most: Broadcast):
    """The exit map of each partition's last key, where that key goes on in the next partition; ``most`` bounds its entry."""
    def run(batches):
        part, t, c = None, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
        for batch in batches:
            part = batch.column("_part")[0].as_py() if batch.num_rows else part
            if part in most.value:
                highest, whose = most.value[part]
                for name, units in _runs(batch, keys, delta):
                    if name == whose:
                        t, c = exit_map(t, c, highest, units)
        if part in most.value:
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(t), pa.int32()), pa.array(t), pa.array(c)], names=["part", "threshold", "offset"])

    return run


def _fold(keys: list[str], delta: str, entries: Broadcast):
    """Balance before and after each step. The first key of a partition enters with the balance it had in the one before."""
    def run(batches):
        last, balance = None, 0
        for batch in batches:
            part = batch.column("_part")[0].as_py() if batch.num_rows else 0
            before, after, ok = [], [], []
            for key, units in _runs(batch, keys, delta):
                if last != (key,):
                    balance = entries.value.get(part, 0) if last is None else 0
                    last = (key,)
                for x in units:
                    before.append(balance)
                    good = x is not None and balance + x >= 0
                    if good:
                        balance += x
                    after.append(balance)
                    ok.append(good)
            out = batch.drop_columns(["_part"])
            for name, col in (("quantity_before", np.array(before) / UNIT), ("quantity_after", np.array(after) / UNIT), ("accepted", np.array(ok, dtype=bool))):
                out = out.append_column(name, pa.array(col))
            yield out

    return run


def rejecting_ledger(events: DataFrame, keys: list[str], ts: str, tie: str, delta: str, target: int | None = None) -> DataFrame:
    """Balance where a step that would go below 0 is rejected and changes nothing; a step without a finite amount is rejected.

    Rows are dealt by ranges of (key, ts, tie), about ``target`` to a partition if given, so a key may span many of them. Only
    a partition's first and last key can go on in another: of those, each partition reports how high its balances can get
    and then the map from entry to exit balance, a few numbers a partition, which chained give every entry. Then all
    partitions are folded at once. Three passes over the dealt rows at any size. Amounts count to six decimals.
    """
    spark = events.sparkSession
    df = events.withColumn(delta, F.col(delta).cast("double"))
    order = [*keys, ts, tie]
    parts = [max(1, -(-df.count() // target))] if target else []
    # the number of its partition goes with each row: tasks that sample a range may count partitions anew
    rows = materialise(df.repartitionByRange(*parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_part")
    named = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    narrow = rows.select(*keys, delta, "_part")
    ends: dict[int, list] = {}
    for r in narrow.mapInArrow(_reach(keys, delta), f"part int, {named}, a long, m long").collect():  # two rows a partition
        ends.setdefault(r["part"], []).append((tuple(r[k] for k in keys), r["a"], r["m"]))
    most: dict[int, tuple[int, tuple]] = {}  # partition: highest entry of its last key, which goes on in the next
    goes_on, high, open_key = [], 0, None
    filled = sorted(ends)
    for p, q in zip(filled, filled[1:]):
        key, a, m = ends[p][-1]
        if ends[q][0][0] != key:
            open_key = None
            continue
        high = high if open_key == (key,) and len(ends[p]) == 1 else 0
        most[p] = high, key
        goes_on.append((p, q))
        high, open_key = max(high + a, m, 0), (key,)
    entries: dict[int, int] = {}
    if most:
        shared = spark.sparkContext.broadcast(most)
        found: dict[int, list] = {}
        for r in narrow.mapInArrow(_maps(keys, delta, shared), "part int, threshold long, offset long").toLocalIterator():  # a partition at a time
            found.setdefault(r["part"], []).append((r["threshold"], r["offset"]))
        for p, q in goes_on:
            entry = entries.get(p, 0) if len(ends[p]) == 1 else 0
            t = [x for x, _ in found[p]]
            entries[q] = entry + found[p][bisect_right(t, entry) - 1][1]
    shared = spark.sparkContext.broadcast(entries)
    return rows.mapInArrow(_fold(keys, delta, shared), f"{fields}, quantity_before double, quantity_after double, accepted boolean")


def stock_ledger(events: DataFrame, keys: list[str], target: int | None = None) -> DataFrame:
    """Audit rows of stock adjustments with cost; insufficient stock rejects the adjustment."""
    out = rejecting_ledger(events, keys, "ts", "event_id", "quantity", target)
    return out.withColumn("total_cost", F.when(F.col("accepted") & F.col("unit_cost").isNotNull(),
                                               F.col("unit_cost") * F.abs("quantity")))


def stock_levels(ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Closing stock and the last accepted receipt and count per key."""
    ok = F.col("accepted")
    return ledger.groupBy(*keys).agg(
        F.max_by("quantity_after", F.struct("ts", "event_id")).alias("quantity"),
        F.max(F.when(ok & (F.col("adjustment_type") == "RECEIVE"), F.col("ts"))).alias("last_restocked_at"),
        F.max(F.when(ok & (F.col("adjustment_type") == "COUNT"), F.col("ts"))).alias("last_counted_at"),
        F.count_if(~ok).alias("rejected"))


def earned(points: Column, multiplier: Column) -> Column:
    """Whole points after the tier multiplier; no tier counts once."""
    return F.floor(points * F.coalesce(multiplier, F.lit(1.0)))


def points_ledger(events: DataFrame, members: DataFrame, tiers: DataFrame, target: int | None = None) -> DataFrame:
    """Earn with the tier multiplier, redeem only from enough balance."""
    m = members.join(tiers, "tier_id", "left").select("member_id", "points_multiplier")
    j = events.join(m, "member_id")
    signed = F.when(F.col("type") == "earn", earned(F.col("points"), F.col("points_multiplier"))).otherwise(-F.col("points"))
    return rejecting_ledger(j.withColumn("change", signed).drop("points_multiplier"), ["member_id"], "ts", "event_id", "change", target)


def member_totals(ledger: DataFrame) -> DataFrame:
    ok, x = F.col("accepted"), F.col("change")
    return ledger.groupBy("member_id").agg(
        F.max_by("quantity_after", F.struct("ts", "event_id")).alias("points"),
        F.sum(F.when(ok & (x > 0), x).otherwise(0.0)).alias("total_earned"),
        F.sum(F.when(ok & (x < 0), -x).otherwise(0.0)).alias("total_redeemed"), F.count_if(~ok).alias("rejected"))


def history(ledger: DataFrame, key: str, value, limit: int, offset: int = 0) -> DataFrame:
    """One page of a member's entries, newest first."""
    return ledger.where(F.col(key) == value).orderBy(F.desc("ts"), F.desc("event_id")).offset(offset).limit(limit)


def adjustment_history(ledger: DataFrame, ingredients: DataFrame, users: DataFrame, ingredient=None, location=None, kind: str | None = None,
                       limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of adjustments, newest first, with the names of ingredient and user and the ``total`` of all that the filters keep.

    ``ingredients``: ingredient_id, ingredient_name; ``users``: adjusted_by, adjusted_by_name; an unknown name is null.
    """
    for c, v in (("ingredient_id", ingredient), ("location_id", location), ("adjustment_type", kind)):
        ledger = ledger if v is None else ledger.where(F.col(c) == v)
    total = ledger.agg(F.count(F.lit(1)).alias("n")).scalar()
    page = ledger.orderBy(F.desc("ts"), F.desc("event_id")).offset(offset).limit(limit)  # names are looked up for the page alone
    return page.join(ingredients, "ingredient_id", "left").join(users, "adjusted_by", "left").withColumn("total", total)


def open_orders(status_events: DataFrame, as_of: Column, open_status: list[str]) -> DataFrame:
    """Latest status per order, open ones only, with timer columns."""
    last = status_events.groupBy("order_id").agg(
        F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("last_change"))
    return timers(last.where(F.col("status").isin(*open_status)), "last_change", as_of)


def timers(df: DataFrame, started: str, as_of: Column) -> DataFrame:
    """Elapsed minutes, colour tier and m:ss text since ``started``."""
    micros = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col(started).cast("timestamp"))
    df = df.withColumn("elapsed_minutes", micros / 60000000)
    whole = F.floor("elapsed_minutes")
    sec = F.round((F.col("elapsed_minutes") - whole) * 60).cast("int")
    return df.withColumns({
        "tier": F.when(F.col("elapsed_minutes") >= 5, "red").when(F.col("elapsed_minutes") >= 2, "amber").otherwise("normal"),
        "timer": F.concat(whole.cast("string"), F.lit(":"), F.lpad(sec.cast("string"), 2, "0"))})
