"""Operators on small frames with edge rows."""

import datetime as dt
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F, types as T

from larder.operators import baselines, calendar, cleaning, coldstart, demand, features, inventory, joins, metrics, promo, promotion, reports, retrieval, scalars
from larder.sources import catalog, files
from larder.session import scratch_path

D0 = dt.date(2023, 1, 1)


@pytest.fixture(scope="module")
def series(spark):
    r = random.Random(42)
    rows = [(D0 + dt.timedelta(days=i), 1, 100, float(r.randrange(0, 12)), 50.0 + i) for i in range(60)]
    rows += [(D0 + dt.timedelta(days=i), 2, 200, 0.0, 0.0) for i in range(60)] + [(D0, 3, 300, 4.0, 9.0)]
    return spark.createDataFrame(rows, "date date, place_id long, item_id long, quantity_sold double, revenue double")


def test_lag_and_rolling_match_pandas(series):
    out = features.ewm_features(features.rolling_features(features.lag_features(series))).toPandas().sort_values(["place_id", "date"])
    for _, g in out.groupby("place_id"):
        q = g["quantity_sold"].astype(float)
        exp = {
            "demand_lag_1d": q.shift(1), "demand_lag_7d": q.shift(7), "rolling_mean_7d": q.shift(1).rolling(7, min_periods=1).mean(),
            "rolling_std_14d": q.shift(1).rolling(14, min_periods=2).std(), "expanding_mean": q.shift(1).expanding(1).mean(),
            "ewm_7d": q.shift(1).ewm(span=7, adjust=True).mean(), "ewm_30d": q.shift(1).ewm(span=30, adjust=True).mean(),
            "demand_same_weekday_avg_4weeks": (q.shift(7) + q.shift(14) + q.shift(21) + q.shift(28)) / 4}
        for c, e in exp.items():
            pd.testing.assert_series_equal(g[c].astype(float), e, check_names=False, check_dtype=False, rtol=1e-9)


def test_series_do_not_leak(series):
    first = features.lag_features(series).where(F.col("date") == F.lit(D0)).select("demand_lag_1d").collect()
    assert all(r[0] is None for r in first) and len(first) == 3


def test_grid_fills_and_cuts(spark):
    rows = [(D0, 1, "a", 5.0, 1.0, 1), (D0 + dt.timedelta(days=3), 1, "b", 9.0, 2.0, 1), (D0 + dt.timedelta(days=9), 1, "c", 1.0, 2.0, 1)]
    df = spark.createDataFrame(rows, "date date, place_id long, item_id string, quantity_sold double, revenue double, order_count long")
    got = demand.date_grid(df, 2).collect()
    assert len(got) == 8 and {r["item_id"] for r in got} == {"a", "b"} and sum(r["quantity_sold"] for r in got) == 14
    own = demand.series_reindex(df.withColumn("item_id", F.lit("x"))).collect()
    assert len(own) == 10
    tie = spark.createDataFrame([(D0, 1, i, 3.0, 0.0, 1) for i in "dcba"], df.schema)
    assert [r["item_id"] for r in demand.topn_per_store(tie, 2).orderBy("rank").collect()] == ["a", "b"]


def test_local_date_on_clock_change(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 3, 30, 23, 30),), (dt.datetime(2024, 3, 31, 22, 30),)], "ts timestamp_ntz")
    assert [str(r[0]) for r in df.select(demand.local_date("ts", "Europe/Copenhagen")).collect()] == ["2024-03-31", "2024-04-01"]


def test_daily_demand_counts_orders_once(spark):
    o = spark.createDataFrame([(1, 7, dt.datetime(2024, 1, 1)), (2, 7, dt.datetime(2024, 1, 1))], "id long, place_id long, created_dt timestamp_ntz")
    l = spark.createDataFrame([(1, "a", 2.0, 10.0), (1, "a", 1.0, 5.0), (2, "a", 1.0, 5.0), (9, "a", 1.0, 5.0)], "order_id long, item_id string, quantity double, cost double")
    r = demand.daily_demand(o, l).collect()
    assert len(r) == 1 and (r[0]["quantity_sold"], r[0]["revenue"], r[0]["order_count"]) == (4.0, 20.0, 2)


def test_cleaning(spark):
    o = spark.createDataFrame([(1, "Closed", 0, 5), (1, "Closed", 0, 6), (2, "Open", 0, 5), (3, "Closed", 1, 5), (4, "Closed", None, 5), (5, "Closed", 0, None)],
                              "id long, status string, demo_mode long, place_id long")
    assert sorted((r["id"], r["place_id"]) for r in cleaning.clean_orders(o, "demo_mode").collect()) == [(1, 5), (4, 5)]
    l = spark.createDataFrame([(1, "a", 0.0), (2, None, 3.0), (3, "b", -1.0), (4, "c", 2.0)], "id long, item_id string, quantity double")
    assert [r["id"] for r in cleaning.clean_order_items(l).collect()] == [4]


def test_coerce_and_empty_table(spark):
    raw = spark.createDataFrame([("1", "9.5", "nan"), ("x", None, "7")], "id string, total_amount string, user_id string")
    got = cleaning.coerce_schema(raw, T.StructType([T.StructField("id", T.LongType()), T.StructField("total_amount", T.DoubleType()), T.StructField("user_id", T.LongType())]))
    assert [tuple(r) for r in got.collect()] == [(1, 9.5, None), (None, None, 7)]
    with pytest.raises(Exception, match="table is empty"):
        cleaning.dq_report(raw.limit(0), ["id"], ["id"]).collect()
    r = cleaning.dq_report(raw, ["id", "gone"], ["id"]).first()
    assert r["missing_columns"] == "gone" and r["row_count"] == 2


def test_metrics_known_value(spark):
    df = spark.createDataFrame([(10.0, 12.0), (20.0, 18.0), (30.0, 35.0), (40.0, 38.0), (50.0, 52.0)], "quantity_sold double, predicted double").withColumn("item_price", F.lit(75.0))
    r = metrics.evaluate_predictions(df).first()
    assert r["mae"] == pytest.approx(2.6) and r["waste_cost_dkk"] == pytest.approx(9 * 75 * 0.3) and r["stockout_cost_dkk"] == pytest.approx(4 * 75)
    bad = df.unionByName(spark.createDataFrame([(float("nan"), float("inf"), None)], "quantity_sold double, predicted double, item_price double"))
    assert not math.isnan(metrics.evaluate_predictions(bad).first()["mae"])
    zero = metrics.evaluate_predictions(df.withColumn("quantity_sold", F.lit(0.0))).first()
    assert zero["wmape"] == 0 and zero["mape"] == 0


def test_inventory_formulas(spark):
    one = spark.range(1)
    assert one.select(inventory.safety_stock(F.lit(10.0), 1)).first()[0] == pytest.approx(16.5)
    assert one.select(inventory.reorder_point(F.lit(10.0), F.lit(5.0), 2)).first()[0] == 25


def test_prep_flags_a_volatile_item(spark):
    r = random.Random(5)
    rows = [(D0 + dt.timedelta(days=i), 1, 1, float(r.choice([0, 0, 0, 20, 30])), 5.0, "Soup", "S") for i in range(60)] + [(D0, 2, 1, 3.0, 3.0, "Soup", "S")]
    df = spark.createDataFrame(rows, "date date, place_id long, item_id long, quantity_sold double, predicted double, item_name string, store_name string")
    got = {x["place_id"]: x for x in inventory.prep_recommendations(df).collect()}
    assert got[1]["alert_level"] in ("red", "yellow") and got[1]["recommended_prep_qty"] > 5
    assert got[2]["demand_std"] == 0.1 and got[2]["recommended_prep_qty"] == 4
    assert inventory.prep_schedule(df).where("recommended_qty < 0").count() == 0


def test_ingredient_demand(spark):
    prods = spark.createDataFrame([(1, "Pizza"), (2, "Cola"), (3, "pizza")], "id long, title string")
    skus = spark.createDataFrame([(10, 3, "Pizza kit", 0.0, 5.0, "composite", "pcs"), (11, None, "Flour", 4.0, 1.0, "normal", "kg"), (12, 2, "Cola can", 100.0, 200.0, "normal", "pcs"),
                                  (13, None, "Salt", 1.0, None, "normal", "kg")],
                                 "id long, item_id long, title string, quantity double, low_stock_threshold double, type string, unit string")
    bom = spark.createDataFrame([(10, 11, 0.5)], "parent_sku_id long, sku_id long, quantity double")
    dem = spark.createDataFrame([("Pizza", 14.0), ("Cola", 7.0), ("Ghost", 3.0)], "item_name string, demand double")
    got = {r["sku_id"]: r for r in inventory.ingredient_demand(dem, prods, skus, bom, 7).collect()}
    assert got[11]["forecasted_demand"] == 7.0 and got[11]["reorder_urgency"] == "soon" and got[11]["needs_reorder"]
    assert got[12]["reorder_urgency"] == "low_stock" and got[12]["days_of_stock_remaining"] == 100.0
    assert got[10]["forecasted_demand"] == 0 and got[13]["reorder_urgency"] == "ok" and got[13]["days_of_stock_remaining"] == 999.0


def test_promo_calendar_and_recency(spark):
    c = spark.createDataFrame([(1, 1, D0, D0 + dt.timedelta(days=1), 10.0, "a"), (2, 1, D0, D0, 20.0, "b"), (3, 1, D0 + dt.timedelta(days=5), D0, 5.0, "x"), (4, 1, None, D0, 5.0, "x"),
                               (5, None, D0, D0, 5.0, "x")], "campaign_id long, place_id long, start_date date, end_date date, discount double, type string")
    cal = promo.promo_calendar(promo.promo_days(c)).orderBy("date").collect()
    assert [(r["campaign_count"], r["discount_percentage"], r["promotion_type"]) for r in cal] == [(2, 20.0, "a"), (1, 10.0, "a")]
    days = spark.createDataFrame([(D0 + dt.timedelta(days=i), 1, int(i in (0, 3))) for i in range(5)], "date date, place_id long, is_promotion_active int")
    got = [(r["days_since_last_promotion"], r["days_until_next_promotion"]) for r in promo.promo_recency(days).orderBy("date").collect()]
    assert got == [(-1, 3), (1, 2), (2, 1), (3, -1), (1, -1)]


def test_opening_hours(spark):
    p = spark.createDataFrame([(1, '{"monday": {"from": "12.00", "to": "20.30"}, "tuesday": {"from": "closed"}}'), (2, ""), (3, None), (4, "{oops")], "place_id long, opening_hours string")
    d = spark.createDataFrame([(k, dt.date(2024, 1, 1) + dt.timedelta(days=i)) for k in (1, 2, 3, 4, 5) for i in range(2)], "place_id long, date date")
    got = {(r["place_id"], r["date"].day): r["is_open"] for r in calendar.opening_flag(d, p).collect()}
    assert got.pop((1, 2)) == 0 and set(got.values()) == {1}


def test_bias_text(spark):
    cols = ["is_friday", "is_weekend", "is_monday", "is_day_before_holiday", "long_weekend_approaching", "is_holiday", "is_day_after_holiday", "is_payday_week",
            "is_grilling_season", "is_julefrokost_season", "is_christmas_season", "is_school_holiday", "severe_weather"]
    base = spark.range(1).select(*[F.lit(False).alias(c) for c in cols], F.lit(None).cast("long").alias("precip_probability"), F.lit(None).cast("double").alias("temperature_max"))
    assert calendar.signal_bias(base).first()["reasoning"] == "No strong signals either way."
    r = calendar.signal_bias(base.withColumns({"is_monday": F.lit(True), "precip_probability": F.lit(61)})).first()
    assert r["bias"] == "waste_reduce" and "rain likely (61%)" in r["reasoning"]


def test_nested_children_split_a_big_parent(spark):
    kids = spark.range(2500).select((F.when(F.col("id") < 2400, 1).otherwise(2)).alias("p"), (F.col("id") % 1200).alias("v"))
    n = joins.nest_children(kids, "p", ["v"], rows=100).collect()
    big = [r for r in n if r["p"] == 1]
    assert len(big) > 5 and sum(x["copies"] for r in big for x in r["items"]) == 2400 and max(len(r["items"]) for r in big) < 400


@pytest.mark.parametrize("parent", [1, None])
def test_chunks_of_a_big_parent_are_in_order(spark, parent):
    kids = spark.range(2500).select(F.lit(parent).cast("int").alias("p"), F.expr("nullif(id * 7919 % 2500, 9)").alias("v"), (F.col("id") % 2).alias("w"))
    n = sorted(joins.nest_children(kids.repartition(5).union(kids.limit(1).withColumn("p", F.lit(2))), "p", ["v", "w"]).where("p IS NULL OR p <> 2").collect(), key=lambda r: r["chunk"])
    assert [(r["chunk"], len(r["items"])) for r in n] == [(0, 1000), (1, 1000), (2, 500)]
    assert [x["v"] for r in n for x in r["items"]] == [None, *[v for v in range(2500) if v != 9]]


def test_chunks_of_big_parents_hold_what_the_sql_lists(spark, tmp_path):
    import json

    import duckdb

    import __spark_entry__ as entry
    spark.range(2600).selectExpr("id * 37 % 2600 AS s_suppkey", "concat('S', id) AS s_name", "CASE WHEN id < 2500 THEN 1L ELSE 2L END AS s_nationkey", "id / 4 AS s_acctbal").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(3).selectExpr("id AS n_nationkey", "concat('N', id) AS n_name", "0L AS n_regionkey").write.parquet(f"{tmp_path}/nation.parquet")
    con = duckdb.connect()
    for t in ("supplier", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = {r[0]: json.loads(r[4]) if r[4] else None for r in con.execute(entry.oracle_sql()["nested_children"]).fetchall()}
    got = {}
    for r in sorted(entry.queries()["nested_children"](spark, str(tmp_path)).collect(), key=lambda r: r["chunk"] or 0):
        got[r["n_nationkey"]] = got.get(r["n_nationkey"], []) + json.loads(r["suppliers"]) if r["suppliers"] else None
    assert got == want and len(got[1]) == 2500 and got[0] is None


def test_order_lines_are_dealt_by_row_count(spark, monkeypatch):
    from larder.functions import exprs
    monkeypatch.setattr(exprs, "TASK_ROWS", 10)
    assert exprs.task_count(spark.range(995)) == 100 and exprs.task_count(spark.range(20)) is None
    o = spark.createDataFrame([(i, 1, dt.datetime(2024, 1, 1)) for i in range(50)] + [(7, 1, dt.datetime(2024, 1, 1)), (None, 1, None)], "id long, place_id long, created_dt timestamp_ntz")
    l = spark.createDataFrame([(i % 60, i % 3, 2.0, 1.5) for i in range(300)] + [(None, 1, 2.0, 1.0)], "order_id long, item_id long, quantity double, cost double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt = demand.daily_demand(o, l, parts=40)
        assert "order_id" in (plan := dealt._jdf.queryExecution().executedPlan().toString()) and plan.count(", 40), REPARTITION_BY_NUM") == 2
        assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, demand.daily_demand(o, l).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_title_match_is_containment(spark):
    words = ["bur", "cheese", "ki", "zz", "e"]
    titles = ["Cheeseburger", "Milk", "Big Burrito", "kiwi", ""]
    got = coldstart.match_titles(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(t,) for t in titles], "item string"))
    assert {tuple(r) for r in got.collect()} == {(w, t) for w in words for t in titles if w in t.lower()}


def test_titles_of_one_task_are_dealt_anew(spark):
    titles = spark.createDataFrame([("aa aab",), (None,), ("a",), ("AAB",)], "item string").coalesce(1)
    got = coldstart.match_titles(spark.createDataFrame([("aab",), ("a",), ("a",)], "word string"), titles)
    assert sorted(map(tuple, got.collect())) == [("a", "AAB"), ("a", "a"), ("a", "aa aab"), ("aab", "AAB"), ("aab", "aa aab")]
    assert "REPARTITION_BY_COL" in got._jdf.queryExecution().executedPlan().toString()


def test_cold_start_estimates_a_set_of_words_once(spark):
    stats = spark.createDataFrame([("red pan", 2.0), ("red pot", 4.0), ("tin", 8.0), ("odd", None)], "item string, avg_daily double")
    cats = spark.createDataFrame([("c", "tin"), ("c", "tin"), ("c", "none"), (None, "tin")], "category string, item string")
    new = [(i, ["red", "xx"], "c") for i in range(40)] + [(50, ["zzz"], "c"), (51, None, "c"), (52, ["zzz"], None), (None, ["red"], "c"), (53, ["red"], None), (53, ["tin"], None), (54, ["odd"], None)]
    df = spark.createDataFrame(new, "id long, words array<string>, category string")
    out = coldstart.cold_start(df, stats, cats, F.lit(D0), days=1, factor=1.0)
    got = {r["id"]: (r["method"], r["similar_items"], r["estimated_daily_demand"]) for r in out.collect()}
    every = round(14 / 3, 4)
    assert got[7] == ("keyword_match", 2, round(20 / 6, 4)) and got[50] == got[51] == ("category_match", 1, 8.0) and got[52] == got[None] == ("global_median", 1, every)
    assert got[53] == ("keyword_match", 3, 6.0) and got[54] == ("keyword_match", 1, every) and out.count() == len(new)
    few = coldstart._set_estimates(df.select("words"), "words", spark.createDataFrame([("red", "red pan", 2.0)], "word string, item string, avg_daily double"), "word", 1, 20)
    assert {tuple(r["words"]): tuple(r["_t1"]) for r in few.collect()}[("red",)] == (1, 2.0, 1)


def test_coupons(spark):
    now = dt.date(2024, 5, 1)
    c = spark.createDataFrame([("Ten", True, D0, dt.date(2030, 1, 1), 5, 5, None, [], None), ("OLD", True, D0, D0, None, 0, None, [], None), ("P", True, D0, dt.date(2030, 1, 1), None, 0, 50.0, ["a"], None)],
                              "code string, is_active boolean, valid_from date, valid_until date, max_uses int, used_count int, min_order_amount double, applicable_products array<string>, applicable_categories array<string>")
    u = spark.createDataFrame([(1, "TEN", now, 10.0, ["a"], ["x"]), (2, "old", now, 10.0, ["a"], ["x"]), (3, "p", now, 10.0, ["a"], ["x"]), (4, "p", now, 60.0, ["b"], ["x"]), (5, "p", now, 60.0, ["a"], ["x"]), (6, "no", now, 1.0, ["a"], ["x"])],
                              "order_id long, code string, now date, order_total double, product_ids array<string>, category_ids array<string>")
    got = {r["order_id"]: r["reason"] for r in promotion.coupon_validity(u, c).collect()}
    assert got == {1: "Coupon usage limit reached", 2: "Coupon has expired", 3: "Minimum order amount", 4: "Coupon not valid for these products", 5: None, 6: "Coupon not found"}


def test_repricing_rejects_unknown_products(spark):
    o = spark.createDataFrame([(1, 0.0, 1.0, 2.0, 3.0), (2, 0.0, 0.0, 0.0, 0.0)], "order_id long, stored_total double, discount_amount double, tax_amount double, tip_amount double")
    l = spark.createDataFrame([(1, "a", 0.5, 2.0), (2, "a", 0.0, 1.0), (2, "z", 0.0, 1.0)], "order_id long, product_id string, modifiers double, quantity double")
    audit, unknown = inventory.order_repricing(o, l, spark.createDataFrame([("a", 10.0)], "product_id string, price double"))
    assert [(r["order_id"], r["total"]) for r in audit.collect()] == [(1, 25.0)] and [r["product_id"] for r in unknown.collect()] == ["z"]


def test_search_batches_agree_and_refuse(spark, monkeypatch):
    r = random.Random(9)
    corpus = spark.createDataFrame([(i, [r.random() - 0.5 for _ in range(8)]) for i in range(60)], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(i, [r.random() - 0.5 for _ in range(8)]) for i in range(7)], "query_id long, vector array<float>")
    one = sorted(map(tuple, retrieval.search(corpus, q, 3).collect()))
    assert one == sorted(map(tuple, retrieval.search(corpus, q, 3, batches=3).collect())) and len(one) == 21
    monkeypatch.setattr(retrieval, "MAX_QUERIES", 2)
    with pytest.raises(Exception, match="use more batches"):
        retrieval.search(corpus, q, 3).collect()


def test_formats(spark):
    one = spark.range(1)
    v = lambda c: one.select(c).first()[0]
    assert v(scalars.currency(F.lit(1250.50))) == "DKK 1,250.50" and v(scalars.percentage_change(F.lit(100.0), F.lit(150.0))) == 50
    assert v(scalars.percentage_change(F.lit(0.0), F.lit(1.0))) is None
    assert [v(scalars.performance_tier(F.lit(x))) for x in (10, 50, 75, 90)] == ["poor", "fair", "good", "excellent"]
    assert v(scalars.short_dkk(F.lit(2500000.0))) == "2.5M DKK"


def test_sql_guard(spark):
    with pytest.raises(ValueError):
        catalog.adhoc_sql(spark, "  drop table x")
    assert catalog.adhoc_sql(spark, "select * from range(500)").count() == 100
    with pytest.raises(KeyError):
        catalog.resolve(catalog.default_catalog("/data"), "nope")
    with pytest.raises(ValueError):
        catalog.resolve(catalog.default_catalog("/data/../etc"), "fct_orders")


def test_catalog_loads_csv_and_reports_missing(spark):
    root = scratch_path(spark, "csv")
    spark.createDataFrame([("1", "1613139429", "Closed", "9.5"), ("2", "0", "Open", "x")], "id string, created string, status string, total_amount string").write.option("header", True).csv(f"{root}/fct_orders.csv")
    tables, errors = catalog.load_all_tables(spark, catalog.default_catalog(root), ["fct_orders", "dim_items"])
    rows = {r["id"]: r for r in tables["fct_orders"].collect()}
    assert str(rows[1]["created_dt"]) == "2021-02-12 15:17:09" and rows[2]["created_dt"] is None and rows[2]["total_amount"] is None and "dim_items" in errors


def test_prediction_store(spark, series):
    path = scratch_path(spark, "pred")
    p = series.withColumn("predicted", F.when(F.col("place_id") == 2, None).otherwise(F.col("quantity_sold")))
    files.save_predictions(p.select(*files.PREDICTION_COLUMNS), path)
    back = files.load_predictions(spark, path)
    assert back.count() == 121 and back.where("predicted is null").count() == 0
    spark.range(1).write.parquet(path + "-bad")
    with pytest.raises(ValueError):
        files.load_predictions(spark, path + "-bad")


def test_missing_weather_is_empty(spark):
    w = files.weather_dim(spark, None)
    days = spark.createDataFrame([(D0,)], "date date")
    r = joins.calendar_join(days, w, spark.createDataFrame([(D0, "Nytårsdag")], "date date, holiday_name string")).first()
    assert r["temperature_max"] is None and r["is_rainy"] == 0 and r["is_holiday"] == 1 and r["is_day_before_holiday"] == 0


def test_upsert_and_replace(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    assert {tuple(r) for r in joins.upsert(base, spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string"), ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    kids = spark.createDataFrame([(1, 0, 5), (2, 0, 6)], "parent long, sort_order int, child long")
    new = spark.createDataFrame([(1, [9, 8])], "parent long, items array<long>")
    assert {tuple(r) for r in joins.replace_children(kids, new, "parent", "items", "child").collect()} == {(2, 0, 6), (1, 0, 9), (1, 1, 8)}


def test_trend_needs_two_days(spark):
    fc = spark.createDataFrame([("a", D0, 1.0), ("b", D0, 1.0), ("b", D0 + dt.timedelta(days=1), 2.0)], "item_name string, date date, predicted_quantity double")
    assert [(r["item_name"], r["change_pct"]) for r in reports.forecast_trend(fc).collect()] == [("b", 100.0)]


def test_weekday_factors_fill_and_clamp(spark):
    rows = [(D0 + dt.timedelta(days=i), "x", 100.0 if i == 0 else 1.0) for i in range(5)] + [(D0, "zero", 0.0)]
    f = baselines.weekday_factors(spark.createDataFrame(rows, "date date, item_id string, quantity_sold double")).collect()
    got = {r["dow"]: r["factor"] for r in f}
    assert len(f) == 7 and got[6] == 1.8 and got[0] == 0.5 and got[4] == 0.8


def test_plain_units_with_parts_count_once(spark):
    dem = spark.createDataFrame([("Soup", 10.0)], "item_name string, demand double")
    prods = spark.createDataFrame([(1, "soup")], "id long, title string")
    skus = spark.createDataFrame([(11, 1, "normal", 5.0, 1.0), (12, None, "normal", 5.0, 1.0), (13, None, "normal", 5.0, 1.0)],
                                 "id long, item_id long, type string, quantity double, low_stock_threshold double")
    bom = spark.createDataFrame([(11, 12, 2.0), (11, 13, 3.0)], "parent_sku_id long, sku_id long, quantity double")
    assert [(r["sku_id"], r["demand"]) for r in inventory.ingredient_drivers(dem, prods, skus, bom).collect()] == [(11, 10.0)]
    through = inventory.ingredient_drivers(dem, prods, skus.withColumn("type", F.lit("composite")), bom)
    assert {r["sku_id"]: r["demand"] for r in through.collect()} == {12: 20.0, 13: 30.0}


def test_sql_guard_sees_writes_after_with(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1).write.parquet(path)
    spark.read.parquet(path).createOrReplaceTempView("guarded")
    for bad in (f"WITH a AS (SELECT 1L AS id) INSERT INTO parquet.`{path}` SELECT * FROM a", "WITH a AS (SELECT 1 AS x) INSERT INTO guarded SELECT * FROM a",
                "WITH a AS (SELECT 1 AS x) FROM a INSERT INTO guarded SELECT x"):
        with pytest.raises(ValueError):
            catalog.adhoc_sql(spark, bad)
    assert spark.read.parquet(path).count() == 1
    assert catalog.adhoc_sql(spark, "WITH Insert_like AS (SELECT 'insert into t' AS x) SELECT x FROM Insert_like").count() == 1


def test_sql_guard_refuses_methods_files_and_table_functions(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    spark.read.parquet(path).createOrReplaceTempView("guarded")
    for bad in ("SELECT reflect('java.lang.System', 'getProperty', 'user.home')", "SELECT JAVA_METHOD ('java.lang.Math', 'random')", "SELECT `reflect`('a', 'b')",
                "SELECT system.builtin.try_reflect('a', 'b')", "SELECT reflect/* x */('a', 'b')", "SELECT identifier('reflect')('a', 'b')",
                f"SELECT * FROM parquet.`{path}`", f"SELECT * FROM text.`{path}`", f"WITH a AS (SELECT * FROM csv.`{path}`) SELECT * FROM a",
                f"SELECT (SELECT max(id) FROM parquet.`{path}`)", "SELECT * FROM identifier('parquet.`/x`')"):
        with pytest.raises(ValueError):
            catalog.adhoc_sql(spark, bad)
    assert catalog.adhoc_sql(spark, "SELECT 'reflect(' AS x, id FROM guarded -- reflect('a')").count() == 3
    assert catalog.adhoc_sql(spark, "WITH a AS (SELECT id FROM range(5)) SELECT * FROM a JOIN guarded USING (id)").count() == 3


def test_upsert_keeps_one_row_per_key(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id long, v string, at int")
    new = spark.createDataFrame([(1, "x", 5), (1, "y", 4), (3, "z", 1)], "id long, v string, at int")
    assert {r["id"]: r["v"] for r in joins.upsert(base, new, ["id"], "at").collect()} == {1: "x", 2: "b", 3: "z"}
    assert joins.upsert(base, new, ["id"]).count() == 3


def test_weighted_means_reach_back_to_the_first_row(spark):
    rows = [(D0 + dt.timedelta(days=i), 1, 1, 1e15 if i == 0 else 0.0) for i in range(400)]
    out = features.ewm_features(spark.createDataFrame(rows, "date date, place_id long, item_id long, quantity_sold double"), spans=(7,))
    got = {r["date"]: r["ewm_7d"] for r in out.collect()}
    want = pd.Series([r[3] for r in rows]).ewm(span=7, adjust=True).mean()
    assert got[D0] is None
    assert all(got[rows[i][0]] == pytest.approx(want[i - 1], rel=1e-9) for i in (1, 2, 127, 128, 129, 150, 300, 399))


def test_short_series_are_forecast(spark):
    from larder.operators import ml
    rows = [(D0 + dt.timedelta(days=i), 1, k, float(3 + i % 7)) for k, n in ((1, 60), (2, 5), (3, 1)) for i in range(n)]
    got = ml.recursive_forecast(spark.createDataFrame(rows, "date date, place_id long, item_id long, quantity_sold double"), 2, maxIter=2, maxDepth=2)
    assert sorted((r["item_id"], r["n"]) for r in got.groupBy("item_id").agg(F.count("predicted").alias("n")).collect()) == [(1, 2), (2, 2), (3, 2)]


def test_stream_ledger_over_many_files(spark, tmp_path):
    from larder.streaming import live
    rng = random.Random(3)
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), i, i % 5, 0, float(rng.randrange(-6, 8))) for i in range(400)]
    df = spark.createDataFrame(rows, "ts timestamp, event_id long, ingredient_id long, location_id long, quantity double")
    df.repartition(8, F.xxhash64("event_id")).write.parquet(str(tmp_path / "e"))
    got = live.drain(spark, live.stock_stream(live.file_stream(spark, str(tmp_path / "e"), "*.parquet", df.schema)), "append")
    balance, want = {}, {}
    for _, e, k, _, q in rows:
        b = balance.get(k, 0.0)
        balance[k] = b + q if b + q >= 0 else b
        want[e] = (b, balance[k])
    assert {r["event_id"]: (r["quantity_before"], r["quantity_after"]) for r in got.collect()} == want


def test_rules_are_upserted_with_their_data(spark):
    import json

    from larder.operators import retrieval
    rules = retrieval.default_rules(spark)
    new = spark.createDataFrame([("waste_thresholds", "changed", json.dumps({"default": 0.2})), ("own", "mine", "{}")], retrieval.RULE)
    got = {r["rule_name"]: (r["description"], json.loads(r["rule_data"])) for r in retrieval.upsert_rules(rules, new).collect()}
    assert len(got) == 6 and got["waste_thresholds"] == ("changed", {"default": 0.2}) and got["expiry_alert_windows"][1]["actions"]["caution"] == "monitor"
