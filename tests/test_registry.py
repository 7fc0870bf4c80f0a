"""Registered queries: checking SQL, plan shape, streams against batch, model invariants."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from scripts.check import rows

QUICK = ["daily_demand", "date_grid", "rolling_std", "ewm_features", "promo_recency", "payday_signals", "evaluate_predictions", "compare_models",
         "ingredient_demand", "prep_schedule", "slow_movers", "iqr_filter", "cold_start", "stock_ledger", "stock_floor_ledger", "label_encode",
         "similar_recipes", "context_text", "stream_today", "unix_to_local", "scenario_impact"]
Q, O = entry.queries(), entry.oracle_sql()
KEYS = sorted(O) if os.environ.get("LARDER_FULL") else QUICK


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("key", KEYS)
def test_matches_sql(spark, duck, sf, key):
    df = Q[key](spark, sf)
    cur = duck.execute(O[key])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()], 6) == rows(cols, [tuple(r) for r in cur.fetchall()], 6)


def test_registry_is_complete():
    assert len(Q) >= 190 and set(O) <= set(Q)


def test_entry(spark):
    assert entry.entry(spark).count() == 5


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["feature_matrix", "promo_features", "keyword_match", "cold_start", "context_signals", "similar_recipes", "ingredient_demand", "slow_movers", "iqr_filter", "scenario_impact"])
def test_no_cross_join(spark, sf, key):
    plan = _plan(Q[key](spark, sf))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "BatchEvalPython" not in plan


def test_top_k_is_cut_before_the_shuffle(spark, sf):
    for key in ("recent_revenue", "topn_per_store", "similar_recipes"):
        assert "WindowGroupLimit" in _plan(Q[key](spark, sf)), key


def test_series_windows_share_one_exchange(spark):
    from larder.operators import features
    g = spark.range(100).select(F.lit(1).alias("place_id"), (F.col("id") % 5).alias("item_id"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("date"), F.rand(1).alias("quantity_sold"))
    plan = _plan(features.rolling_features(features.lag_features(g)))
    assert plan.count("Exchange hashpartitioning") == 1


def test_scan_prunes_and_pushes(spark, sf):
    from larder.plans import frames
    text = _explain(frames.sales(spark, sf).groupBy("date").agg(F.sum("quantity")))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>" in text
    assert "EqualTo(p_type" not in text and "IsNotNull(l_orderkey)" in text


def _explain(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_stream_ledger_equals_batch(spark, sf):
    a = {r["event_id"]: (r["quantity_before"], r["quantity_after"], r["accepted"]) for r in Q["stream_ledger"](spark, sf).collect()}
    b = {r["event_id"]: (r["quantity_before"], r["quantity_after"], r["accepted"]) for r in Q["stock_ledger"](spark, sf).collect()}
    assert a == b and all(x[1] >= 0 for x in a.values())


def test_stream_demand_equals_batch(spark, sf):
    got = Q["stream_demand"](spark, sf).agg(F.sum("quantity_sold")).first()[0]
    l, o = spark.read.parquet(f"{sf}/lineitem.parquet"), spark.read.parquet(f"{sf}/orders.parquet").where("o_orderstatus = 'F'")
    assert got == l.join(o, l.l_orderkey == o.o_orderkey).agg(F.sum("l_quantity")).first()[0]


def test_recursive_and_delta_are_not_negative(spark, sf):
    r = Q["fc_recursive"](spark, sf)
    assert r.count() == 30 * 7 and r.where("predicted < 0").count() == 0
    assert Q["fc_delta"](spark, sf).where("predicted_next < 0").count() == 0


def test_seasonal_band(spark, sf):
    s = Q["fc_seasonal"](spark, sf)
    assert s.count() > 0 and s.where("yhat < 0 or yhat_lower > yhat or yhat > yhat_upper").count() == 0


def test_blends(spark, sf):
    h = Q["fc_hybrid"](spark, sf)
    assert h.where("hybrid < 0 or hybrid < least(gbt, ma7) - 0.5 or hybrid > greatest(gbt, ma7) + 0.5").count() == 0
    assert Q["fc_waste_opt"](spark, sf).where("waste_opt > hybrid").count() == 0


def test_median_of_models(spark):
    from larder.operators.ml import median_of
    df = spark.createDataFrame([(1.0, 5.0, 3.0), (1.0, 5.0, None), (None, None, None), (2.0, None, None)], "a double, b double, c double")
    assert [r[0] for r in df.select(median_of(["a", "b", "c"])).collect()] == [3.0, 3.0, None, 2.0]


def test_model_round_trip(spark, sf):
    from larder.operators import ml
    from larder.session import scratch_path
    train = spark.range(200).select((F.col("id") % 7).cast("double").alias("day_of_week"), F.col("id").cast("double").alias("demand_lag_1d"), (F.col("id") % 7 * 3).cast("double").alias("quantity_sold"))
    m = ml.fit_gbt(train, maxIter=2, maxDepth=2)
    path = scratch_path(spark, "model")
    ml.save_model(m, path, spark, {"mae": 1.0})
    back, info = ml.load_model(path, spark)
    assert info["features"] == ["day_of_week", "demand_lag_1d"] and info["mae"] == 1.0
    assert ml.predict(back, train).agg(F.sum("gbt")).first()[0] == pytest.approx(ml.predict(m, train).agg(F.sum("gbt")).first()[0])


MODEL_QUERIES = ["fc_gbt", "fc_hybrid", "fc_waste_opt", "feature_importance", "model_comparison", "cv_metrics", "walk_forward", "fc_quantile", "item_holdout", "multi_horizon", "fc_recursive",
                 "fc_ensemble", "training_pipeline"]


@pytest.fixture
def few_days(spark, sf, monkeypatch):
    """The model queries see 200 days of one series instead of the feature matrix."""
    from larder.plans import frames, p_models
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int"))
    few = spark.range(200).select(F.lit(1).alias("place_id"), F.lit("a").alias("item_id"), day.alias("date"), (F.col("id") % 7).cast("double").alias("quantity_sold"), (F.col("id") % 7).cast("double").alias("demand_lag_1d"))
    monkeypatch.setattr(p_models, "train_matrix", lambda *a: few)
    monkeypatch.setattr(frames, "grid", lambda *a: few)


@pytest.mark.parametrize("key", MODEL_QUERIES)
def test_model_queries_fit_the_full_model(spark, sf, few_days, monkeypatch, key):
    from larder.operators import ml

    class Asked(Exception):
        pass

    def asked(**params):
        raise Asked(params)

    monkeypatch.setattr(ml, "GBTRegressor", asked)
    with pytest.raises(Asked) as e:
        Q[key](spark, sf)
    got = e.value.args[0]
    assert {k: got[k] for k in ml.DEFAULTS} == ml.DEFAULTS == {"maxIter": 500, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8, "minInstancesPerNode": 5, "seed": 42, "featureSubsetStrategy": "0.8"}


def test_tuning_grid(spark, sf, few_days, monkeypatch):
    from larder.operators import ml
    seen = []
    monkeypatch.setattr(ml, "tune", lambda df, grid: seen.extend(grid) or df)
    Q["tune_gbt"](spark, sf)
    assert {tuple(g[k] for k in ("maxIter", "maxDepth", "stepSize")) for g in seen} == {(n, d, s) for n in (300, 500) for d in (4, 6, 8) for s in (0.03, 0.05, 0.1)} and len(seen) == 18


def test_ensemble_votes_with_the_hybrid_and_the_waste_model(spark):
    from larder.operators import ml
    latest = spark.sql("SELECT 1 AS place_id, 'a' AS item_id, 'Soup' AS item_name, DATE '2024-01-01' AS date, 4.0 AS quantity_sold, 1.0 AS rolling_std_14d, 100.0 AS gbt, 10.0 AS hybrid, 8.0 AS waste_opt, CAST(NULL AS DOUBLE) AS delta_forecast")
    factors = spark.sql("SELECT 'a' AS item_id, 1 AS dow, 2.0 AS factor")
    r = ml.ensemble(latest, factors, 1, ["hybrid", "waste_opt", "delta_forecast"], ["salad"]).first()
    assert (r["forecast_balanced"], r["forecast_waste_optimized"], r["forecast_stockout_optimized"]) == (18.0, 16.0, 24.0)
