"""Model training, validation and forecast queries, all with the parameters of a full training run (``ml.DEFAULTS``)."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from larder.functions.exprs import rnd
from larder.operators import baselines, features, ml
from larder.operators.demand import SERIES
from larder.operators.scalars import PERISHABLE_WORDS
from larder.plans import frames, p_calendar
from larder.plans.registry import query
from larder.plans.sqlbase import Q
from larder.session import scratch_path

TUNING = {"maxIter": (300, 500), "maxDepth": (4, 6, 8), "stepSize": (0.03, 0.05, 0.1)}
KEYS = ["date", *SERIES]


@frames.per_session
def train_matrix(spark, sf):
    """The encoded feature matrix as a written table: every fit scans it several times,
    and reads only the columns it needs."""
    return frames.written(ml.encode_categoricals(p_calendar.build_features(spark, sf)), "features")


def main_model(df):
    """The full model of the training rows of a matrix, fitted once; forecasts, scores and importances share it."""
    key = ("main_model", id(df))
    if key not in frames._MADE:
        train, _, _ = ml.parts(df)
        frames._MADE[key] = (df, ml.fit_gbt(train))
    return frames._MADE[key][1]


def scored_test(spark, sf):
    df = train_matrix(spark, sf)
    _, _, test = ml.parts(df)
    return ml.blended(ml.predict(main_model(df), test))


@query("time_split", Q("grid", "b AS (SELECT MIN(date) AS lo, MAX(date) AS hi FROM grid)", """SELECT split, COUNT(*) AS n, MIN(date) AS first_date, MAX(date) AS last_date FROM (SELECT date,
  CASE WHEN hi >= lo + INTERVAL 33 MONTH THEN CASE WHEN date < lo + INTERVAL 30 MONTH THEN 'train' WHEN date < lo + INTERVAL 33 MONTH THEN 'val' WHEN date < lo + INTERVAL 36 MONTH THEN 'test' END
  ELSE CASE WHEN (date - lo) / (hi - lo + 1) < 0.7 THEN 'train' WHEN (date - lo) / (hi - lo + 1) < 0.85 THEN 'val' ELSE 'test' END END AS split FROM grid, b) GROUP BY split"""))
def _(spark, sf):
    return ml.time_split(frames.grid(spark, sf)).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("fc_gbt")
def _(spark, sf):
    return scored_test(spark, sf).select(*KEYS, "quantity_sold", "gbt")


@query("fc_hybrid")
def _(spark, sf):
    return scored_test(spark, sf).select(*KEYS, "gbt", "ma7", "hybrid")


@query("fc_waste_opt")
def _(spark, sf):
    return scored_test(spark, sf).select(*KEYS, "hybrid", "waste_opt")


@query("feature_importance")
def _(spark, sf):
    return ml.feature_importance(main_model(train_matrix(spark, sf)), spark)


@query("model_comparison")
def _(spark, sf):
    df = train_matrix(spark, sf)
    _, _, test = ml.parts(df)
    return ml.model_comparison(main_model(df), test)


@query("cv_metrics")
def _(spark, sf):
    return ml.cv_metrics(train_matrix(spark, sf), 5)


@query("walk_forward")
def _(spark, sf):
    return ml.walk_forward(train_matrix(spark, sf), 3)


@query("tune_gbt")
def _(spark, sf):
    grid = [dict(zip(TUNING, p)) for p in product(*TUNING.values())]
    return ml.tune(train_matrix(spark, sf), grid)


@query("fc_quantile")
def _(spark, sf):
    df = train_matrix(spark, sf)
    train, _, _ = ml.parts(df)
    cut = train.agg(F.max("date").alias("d")).scalar()
    later = ml.predict(main_model(df), df.where(F.col("date") > cut))
    return ml.quantile_forecast(train, later).select(*KEYS, "gbt", "q50", "q75", "q90")


@query("item_holdout")
def _(spark, sf):
    return ml.item_holdout(train_matrix(spark, sf), 30, 60)


@query("multi_horizon")
def _(spark, sf):
    return ml.multi_horizon(train_matrix(spark, sf), (1, 7, 30), 60)


@query("fc_seasonal")
def _(spark, sf):
    df = train_matrix(spark, sf)
    train, _, _ = ml.parts(df)
    return ml.seasonal(df, train.agg(F.max("date").alias("d")).scalar())


@query("fc_recursive")
def _(spark, sf):
    return ml.recursive_forecast(frames.grid(spark, sf), 7)


@query("fc_delta")
def _(spark, sf):
    return ml.delta_model(frames.grid(spark, sf), 60, 30)


@query("fc_ensemble")
def _(spark, sf):
    df = train_matrix(spark, sf)
    model = main_model(df)
    cols = [c for c in df.columns if c not in KEYS]
    latest = features.latest_per_series(df, cols)
    scored = baselines.hybrid(baselines.moving_average(ml.predict(model, latest), 7, "ma7"), "gbt", "ma7")
    scored = baselines.waste_optimised(scored)
    scored = scored.join(ml.delta_next(frames.grid(spark, sf), 60), SERIES, "left")
    factors = baselines.weekday_factors(frames.daily(spark, sf))
    return ml.ensemble(scored, factors, 7, ["hybrid", "waste_opt", "delta_forecast"], PERISHABLE_WORDS["forecast"])


@query("training_pipeline")
def _(spark, sf):
    df = train_matrix(spark, sf)
    return ml.training_pipeline(df, main_model(df), scratch_path(spark, "training"), spark)
