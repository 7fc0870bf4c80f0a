"""Quantiles, prefix scans, ranks and calendars against brute force."""

import datetime as dt
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.functions import calendars, quantiles, scan
from larder.functions.exprs import finite, first_row_per_key, ratio
from larder.functions.quantiles import exact_quantiles
from larder.functions.ranks import sorted_index
from larder.operators import ledger


def hot_events(n=400, seed=1):
    """A third of all rows belong to one key; times collide."""
    r = random.Random(seed)
    t0 = dt.datetime(2024, 1, 1)
    return [(i, t0 + dt.timedelta(seconds=r.randrange(0, 3 * 86400)), 1 if i % 3 == 0 else r.randrange(2, 9),
             float(r.randrange(-9, 9))) for i in range(n)]


def by_key(rows):
    out = {}
    for e in sorted(rows, key=lambda e: (e[1], e[0])):
        out.setdefault(e[2], []).append(e)
    return out


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(hot_events(), "event_id long, ts timestamp_ntz, k long, x double")


@pytest.mark.parametrize("accuracy", [10, 50, 100000])
def test_quantiles_match_numpy(spark, accuracy):
    r = random.Random(3)
    rows = [(g, v) for g in "abc" for v in [r.choice([0.0, 1.0, 1.0, 7.5, r.random() * 100]) for _ in range(57)]]
    rows += [("a", 1e15), ("b", -1e15)] + [("c", float(i)) for i in range(500)]
    rows += [("two", 1.0), ("two", 2.0), ("one", 4.0), ("same", 2.0), ("same", 2.0), ("null", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {x["g"]: x for x in exact_quantiles(df, "v", {"q1": 0.25, "med": 0.5, "q9": 0.9}, ["g"], accuracy=accuracy).collect()}
    for g in ["a", "b", "c", "one", "two", "same"]:
        v = [x for k, x in rows if k == g]
        for name, q in (("q1", 0.25), ("med", 0.5), ("q9", 0.9)):
            assert got[g][name] == pytest.approx(np.percentile(v, q * 100))
    assert "null" not in got
    assert exact_quantiles(df, "v", {"m": 0.5}).first()["m"] == pytest.approx(np.percentile([x for _, x in rows if x is not None], 50))


def test_quantiles_deal_a_large_group_by_value(spark, monkeypatch, capsys):
    rows = [(g, float(v)) for g, n in (("a", 90), ("b", 40), ("c", 3), (None, 5)) for v in range(n)]
    df = spark.createDataFrame(rows, "g string, v double")
    monkeypatch.setattr(quantiles, "LARGE_GROUPS", 1)  # one group by its range, the others by the join
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = exact_quantiles(df, "v", {"m": 0.5}, ["g"])
        got.explain()
        assert {r["g"]: r["m"] for r in got.collect()} == {"a": 44.5, "b": 19.5, "c": 1.0}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert re.search(r"Exchange hashpartitioning\(g#\d+, .*_side", capsys.readouterr().out)  # not by g alone


@pytest.mark.parametrize("target", [5, 100000])
def test_running_sum_and_min(events, target):
    s = scan.running_sum(events, ["k"], "ts", "event_id", "x", "s", target=target)
    got = {r["event_id"]: r["s"] for r in s.collect()}
    m = {r["event_id"]: r["m"] for r in scan.running_min(events, ["k"], "ts", "event_id", "x", "m", target=target).collect()}
    for rows in by_key(hot_events()).values():
        total, low = 0.0, float("inf")
        for e in rows:
            total, low = total + e[3], min(low, e[3])
            assert got[e[0]] == pytest.approx(total) and m[e[0]] == low


@pytest.mark.parametrize("target", [5, 100000])
def test_floored_ledger(events, target):
    got = {r["event_id"]: r for r in ledger.floored_ledger(events, ["k"], "ts", "event_id", "x", target).collect()}
    for rows in by_key(hot_events()).values():
        b = 0.0
        for e in rows:
            assert got[e[0]]["quantity_before"] == b
            b = max(0.0, b + e[3])
            assert got[e[0]]["quantity_after"] == b


@pytest.mark.parametrize("target", [40, 100000])
def test_rejecting_ledger_splits_a_hot_key(events, target):
    got = {r["event_id"]: r for r in ledger.rejecting_ledger(events, ["k"], "ts", "event_id", "x", target).collect()}
    assert len(got) == 400
    for rows in by_key(hot_events()).values():
        b = 0.0
        for e in rows:
            ok = b + e[3] >= 0
            assert got[e[0]]["accepted"] is ok and got[e[0]]["quantity_before"] == b
            b = b + e[3] if ok else b
            assert got[e[0]]["quantity_after"] == b >= 0


def test_hot_key_is_cut_and_others_are_not(events):
    seg = scan.with_segments(events, ["k"], "ts", target=40).groupBy("k").agg(F.countDistinct("_seg").alias("n"))
    n = {r["k"]: r["n"] for r in seg.collect()}
    assert n[1] > 2 and all(v == 1 for k, v in n.items() if k not in (1,) and len(by_key(hot_events())[k]) <= 40)


def test_sorted_index(spark):
    words = [f"w{random.Random(i).randrange(1000)}" for i in range(300)] + [None]
    got = {r["w"]: r["i"] for r in sorted_index(spark.createDataFrame([(w,) for w in words], "w string"), "w", "i").collect()}
    assert got == {w: i for i, w in enumerate(sorted({w for w in words if w}))}


# fixed values: Easter Sundays
EASTERS = {1818: "03-22", 1943: "04-25", 1954: "04-18", 1981: "04-19", 1995: "04-16", 2000: "04-23", 2008: "03-23",
           2011: "04-24", 2019: "04-21", 2024: "03-31", 2038: "04-25", 2049: "04-18", 2076: "04-19"}


def test_easter(spark):
    df = spark.createDataFrame([(y,) for y in EASTERS], "year int")
    got = {r[0]: r[1].strftime("%m-%d") for r in df.select("year", calendars.easter(F.col("year"))).collect()}
    assert got == EASTERS


def test_prayer_day_ends_in_2023(spark):
    h = calendars.holidays(spark.createDataFrame([(2023,), (2024,)], "year int")).where("holiday_name = 'Store bededag'")
    assert [str(r["date"]) for r in h.collect()] == ["2023-05-05"]


def test_small_helpers(spark):
    df = spark.createDataFrame([(1, float("nan"), 3.0), (1, 2.0, 0.0), (2, float("-inf"), None)], "k long, a double, b double")
    assert [r[0] for r in df.select(finite("a")).collect()] == [0.0, 2.0, 0.0]
    assert [r[0] for r in df.select(ratio(F.lit(6.0), "b")).collect()] == [2.0, None, None]
    first = first_row_per_key(df.fillna(0, ["a"]), ["k"], [F.col("b")])
    assert {(r["k"], r["b"]) for r in first.collect()} == {(1, 0.0), (2, None)}
