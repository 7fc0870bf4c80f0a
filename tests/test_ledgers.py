"""The rejecting ledger over many partitions, and the streams that give its result for any files and triggers."""

import datetime as dt
import random
from bisect import bisect_right
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.operators import ledger
from larder.streaming import live, timed

T0 = dt.datetime(2024, 1, 1)
KIND = "ts timestamp, event_id long, k string, x double, note string"


def plain(rows):
    out, balance = {}, defaultdict(float)
    for ts, e, k, x, _ in sorted(rows, key=lambda r: (r[0], r[1])):
        before = balance[k]
        ok = x is not None and np.isfinite(x) and before + x >= 0
        balance[k] = before + x if ok else before
        out[e] = (before, balance[k], ok)
    return out


def got(df):
    return {r["event_id"]: (r["quantity_before"], r["quantity_after"], r["accepted"]) for r in df.collect()}


@pytest.mark.parametrize("target", [None, 7, 90])
@pytest.mark.parametrize("lean", [-6, 0, 5])
def test_every_key_over_any_partitions(spark, target, lean):
    rng = random.Random(lean)
    rows = []
    for i in range(700):
        k = "hot" if rng.random() < 0.5 else rng.choice(["a", "b", None, "c"])
        x = rng.choice([None, float("nan"), float("inf")]) if rng.random() < 0.02 else float(rng.randrange(-20 + lean, 20 + lean))
        rows.append((T0 + dt.timedelta(seconds=rng.randrange(400)), i, k, x, "n"))
    df = spark.createDataFrame(rows, KIND)
    out = ledger.rejecting_ledger(df, ["k"], "ts", "event_id", "x", target)
    assert out.columns == ["ts", "event_id", "k", "x", "note", "quantity_before", "quantity_after", "accepted"]
    assert got(out) == plain(rows)


def test_empty_and_fractional_ledgers(spark):
    assert ledger.rejecting_ledger(spark.createDataFrame([], KIND), ["k"], "ts", "event_id", "x", 10).count() == 0
    rows = [(T0 + dt.timedelta(seconds=i), i, "a", x, "") for i, x in enumerate([0.1, 0.2, -0.3, -0.000001, 2.5, -2.5])]
    out = got(ledger.rejecting_ledger(spark.createDataFrame(rows, KIND), ["k"], "ts", "event_id", "x", 2))
    assert [out[i][2] for i in range(6)] == [True, True, True, False, True, True] and out[2][1] == 0.0 and out[5][1] == 0.0


def test_one_key_with_all_rows(spark):
    """Three million steps of one key in thirty partitions."""
    n = 3_000_000
    step = (F.pmod(F.xxhash64("id"), F.lit(41)) - 22).cast("double")
    df = spark.range(0, n, 1, 16).select(F.timestamp_seconds(F.col("id")).alias("ts"), F.col("id").alias("event_id"), F.lit("k").alias("k"), step.alias("x"))
    out = ledger.rejecting_ledger(df, ["k"], "ts", "event_id", "x", 100_000).select("event_id", "x", "quantity_after", "accepted").toArrow()
    order = np.argsort(out["event_id"].to_numpy())
    x, after = out["x"].to_numpy()[order].tolist(), out["quantity_after"].to_numpy()[order].tolist()
    b = 0.0
    for i in range(n):
        if b + x[i] >= 0:
            b += x[i]
        assert after[i] == b


def test_maps_of_stretches_chain():
    rng = random.Random(2)
    for _ in range(60):
        steps = [rng.choice([None, *range(-30, 25)]) for _ in range(rng.randrange(1, 50))]
        cut, most = rng.randrange(len(steps)), rng.randrange(90)
        t, c = ledger.exit_map(*ledger.exit_map(np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64), most, steps[:cut]), most, steps[cut:])
        for entry in range(most + 1):
            b = entry
            for x in steps:
                b = b + x if x is not None and b + x >= 0 else b
            assert entry + c[bisect_right(t.tolist(), entry) - 1] == b


# ---- streams -----------------------------------------------------------------------

STEPS = "ts timestamp, event_id long, ingredient_id long, location_id long, quantity double"


def step_rows(n=240):
    rng = random.Random(5)
    return [(T0 + dt.timedelta(minutes=7 * i + rng.randrange(20), microseconds=rng.randrange(999)), i, i % 3, i % 2, float(rng.randrange(-9, 9))) for i in range(n)]


def files(spark, rows, kind, how, path):
    df = spark.createDataFrame(rows, kind)
    parts = df.repartitionByRange(8, "ts") if how == "by time" else df.repartition(8, F.xxhash64("event_id"))
    for i, part in enumerate(parts.rdd.glom().collect()):  # one file after the other, so that triggers read them in this order
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(f"{path}/{i}")
    return live.file_stream(spark, f"{path}/*", "*.parquet", df.schema)


@pytest.mark.parametrize("how", ["by time", "hashed"])
@pytest.mark.parametrize("each", [1, None])
def test_stream_ledger_does_not_depend_on_files_and_triggers(spark, tmp_path, how, each):
    rows = step_rows()
    stream = files(spark, rows, STEPS, how, str(tmp_path / "s"))
    if each:
        stream = live.file_stream(spark, str(tmp_path / "s" / "*"), "*.parquet", spark.createDataFrame(rows[:1], STEPS).schema, each)
    lateness = "1 hour" if how == "by time" else "30 days"
    want = {}
    for key in {r[2:4] for r in rows}:
        want |= plain([(r[0], r[1], key, r[4], "") for r in rows if r[2:4] == key])
    out = timed.run_ledger(spark, stream, lateness)
    assert got(out) == want and out.count() == len(rows)
    batch = ledger.rejecting_ledger(spark.createDataFrame(rows, STEPS), ["ingredient_id", "location_id"], "ts", "event_id", "quantity")
    assert got(batch) == want


@pytest.mark.parametrize("each", [1, None])
def test_board_follows_the_latest_event_of_each_order(spark, tmp_path, each):
    rng = random.Random(9)
    shown = ["OPEN", "READY"]
    rows = [(T0 + dt.timedelta(seconds=3 * i), i, rng.randrange(12 if i < 90 else 4), rng.choice([*shown, "COMPLETED"])) for i in range(160)]
    kind = "ts timestamp, event_id long, order_id long, status string"
    files(spark, rows, kind, "by time", str(tmp_path / "b"))
    stream = live.file_stream(spark, str(tmp_path / "b" / "*"), "*.parquet", spark.createDataFrame(rows[:1], kind).schema, each)
    out = {r["order_id"]: (r["status"], r["tier"]) for r in timed.run_board(spark, stream, shown, "0 seconds").collect()}
    want = {r["order_id"]: (r["status"], r["tier"]) for r in ledger.open_orders(
        spark.createDataFrame(rows, kind), F.lit(rows[-1][0]), shown).collect()}
    assert out == want and {t for _, t in want.values()} >= {"normal", "amber"}


def test_orders_of_a_day_are_counted_once_over_triggers(spark, tmp_path):
    rng = random.Random(3)
    orders = spark.createDataFrame([(o, T0 + dt.timedelta(hours=o)) for o in range(60)], "order_id long, ts timestamp")
    lines = [(i, rng.randrange(60), rng.randrange(4), float(rng.randrange(1, 5))) for i in range(400)]
    for k in range(4):
        spark.createDataFrame(lines[k::4], "n long, order_id long, item_id long, quantity double").coalesce(1).write.parquet(str(tmp_path / "l" / str(k)))
    schema = spark.createDataFrame(lines[:1], "n long, order_id long, item_id long, quantity double").schema
    stream = live.file_stream(spark, str(tmp_path / "l" / "*"), "*.parquet", schema, 1).drop("n")
    out = {(str(r["date"]), r["item_id"]): (r["quantity_sold"], r["order_count"]) for r in timed.run_demand(spark, stream, orders, "30 days").collect()}
    want = defaultdict(lambda: [0.0, set()])
    for _, o, item, q in lines:
        cell = want[str((T0 + dt.timedelta(hours=o)).date()), item]
        cell[0] += q
        cell[1].add(o)
    assert out == {k: (q, len(s)) for k, (q, s) in want.items()}
