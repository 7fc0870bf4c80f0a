"""Forecasts: boosted trees, blends, validation, recursive and delta models."""

from __future__ import annotations

import json
import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from larder.functions.exprs import clipped, exact_sum, finite, rnd, rnd_even
from larder.operators import baselines, boosting, echo, metrics
from larder.operators.boosting import GBTRegressor, Model
from larder.operators.demand import SERIES
from larder.operators.scalars import label_encode
from larder.operators.trend import seasonal  # noqa: F401 - one of the models
from larder.session import materialise

# the columns a boosted-tree model reads, in the order of the vector
FEATURE_COLS = [
    "day_of_week", "day_of_month", "month", "quarter", "week_of_year", "day_of_year", "year", "is_weekend", "is_friday",
    "is_monday", "season", "dow_sin", "dow_cos", "month_sin", "month_cos",
    "demand_lag_1d", "demand_lag_7d", "demand_lag_14d", "demand_lag_28d",
    "rolling_mean_7d", "rolling_mean_14d", "rolling_mean_30d", "rolling_std_7d", "rolling_std_14d",
    "demand_same_weekday_last_week", "demand_same_weekday_avg_4weeks", "expanding_mean",
    "temperature_max", "temperature_min", "precipitation_mm", "is_rainy",
    "is_holiday", "is_day_before_holiday", "is_day_after_holiday",
    "is_promotion_active", "discount_percentage", "campaign_count", "is_open",
    "place_id_encoded", "item_id_encoded",
]
LAG_COLS = ["demand_lag_1d", "demand_lag_7d", "demand_lag_14d", "demand_lag_28d"]
TARGET = "quantity_sold"
DEFAULTS = {"maxIter": 500, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8, "minInstancesPerNode": 5, "seed": 42,
            "featureSubsetStrategy": "0.8"}


def encode_categoricals(df: DataFrame, fitted: DataFrame | None = None) -> DataFrame:
    """Sorted-label codes of place and item; unseen values give -1."""
    ref = df if fitted is None else fitted
    for c in SERIES:
        df = label_encode(df, ref.select(c), c, f"{c}_encoded")
    return df


def used_features(df: DataFrame, wanted: list[str] = FEATURE_COLS) -> list[str]:
    return [c for c in wanted if c in df.columns]


def training_rows(df: DataFrame, dropna: bool = False) -> DataFrame:
    """Rows with at least one known lag; or only rows without any NULL feature."""
    if dropna:
        return df.dropna(subset=used_features(df))
    lags = [c for c in LAG_COLS if c in df.columns]
    return df.where(F.coalesce(*lags).isNotNull()) if lags else df


def _filled(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: finite(c) for c in cols})


def fit_all(df: DataFrame, fits: list[tuple[dict, Column | None]], cols: list[str] | None = None, target: str = TARGET) -> list[Model]:
    """One model for each (settings, condition of its training rows), all grown side by side; unknown features count as 0."""
    cols = cols or used_features(df)
    specs = [(GBTRegressor(featuresCol="features", labelCol=target, predictionCol="_pred", **{**DEFAULTS, **p}), F.lit(True) if c is None else c) for p, c in fits]
    return boosting.fit(_filled(training_rows(df), cols), cols, specs)


def fit_gbt(train: DataFrame, cols: list[str] | None = None, target: str = TARGET, **params) -> Model:
    return fit_all(train, [(params, None)], cols, target)[0]


def predict(model: Model, df: DataFrame, out: str = "gbt") -> DataFrame:
    """Prediction not below 0; the feature columns keep their NULLs."""
    scored = boosting.predict(model, df, {c: finite(c) for c in model.cols}, "_pred")
    return scored.withColumn(out, clipped(F.col("_pred"))).drop("_pred")


def feature_importance(model: Model, spark, top: int = 20) -> DataFrame:
    """Importances by name; one value per feature, so the list is bounded by the model."""
    return spark.createDataFrame(model.importances(), "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(top)


def save_model(model: Model, path: str, spark, facts: dict) -> None:
    """Model and a one-row JSON table with features and metrics beside it."""
    spark.createDataFrame([(model.to_json(),)], "model string").coalesce(1).write.mode("overwrite").text(f"{path}/model")
    info = json.dumps({"features": model.cols, **facts})
    spark.createDataFrame([(info,)], "info string").coalesce(1).write.mode("overwrite").text(f"{path}/info")


def load_model(path: str, spark) -> tuple[Model, dict]:
    return Model.from_json(spark.read.text(f"{path}/model").first()[0]), json.loads(spark.read.text(f"{path}/info").first()[0])


# ---- splits ------------------------------------------------------------------------

def time_split(df: DataFrame, train_months: int = 30, val_months: int = 3, test_months: int = 3) -> DataFrame:
    """Add ``split``: train, val, test, or NULL after the test window.

    Where val or test would be empty the distinct dates are cut 70/15/15.
    """
    lo = df.agg(F.min("date").alias("d")).scalar()
    hi = df.agg(F.max("date").alias("d")).scalar()
    a, b = F.add_months(lo, train_months), F.add_months(lo, train_months + val_months)
    c = F.add_months(lo, train_months + val_months + test_months)
    d = F.col("date")
    by_month = F.when(d < a, "train").when(d < b, "val").when(d < c, "test")
    days = F.datediff(hi, lo) + 1
    share = F.datediff(d, lo) / days
    by_share = F.when(share < 0.7, "train").when(share < 0.85, "val").otherwise("test")
    return df.withColumn("split", F.when(hi >= b, by_month).otherwise(by_share))


def parts(df: DataFrame, **kw) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = time_split(df, **kw)
    return tuple(s.where(F.col("split") == n).drop("split") for n in ("train", "val", "test"))


def date_folds(df: DataFrame, folds: int = 5) -> DataFrame:
    """Add ``fold``: 0..folds by date, equal spans; fold k validates a model of folds before k."""
    lo = df.agg(F.min("date").alias("d")).scalar()
    days = df.agg((F.datediff(F.max("date"), F.min("date")) + 1).alias("n")).scalar()
    return df.withColumn("fold", F.floor(F.datediff("date", lo) * (folds + 1) / days).cast("int"))


def _scores(df: DataFrame, pred: str, keys: list[str] = ()) -> DataFrame:
    q = metrics.quality(TARGET, pred)
    a, p = F.col(TARGET), F.col(pred)
    n, sa = F.count(F.lit(1)), exact_sum(a)
    r2 = 1 - F.try_divide(exact_sum((a - p) * (a - p)), exact_sum(a * a) - sa * sa / n)
    return df.groupBy(*keys).agg(n.alias("n"), q["mae"].alias("mae"), q["rmse"].alias("rmse"), q["wmape"].alias("wmape"), r2.alias("r2"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def cv_metrics(df: DataFrame, folds: int = 5, **params) -> DataFrame:
    """Expanding-window validation: one row per fold and their mean (fold 0)."""
    f = date_folds(df, folds)
    models = fit_all(f, [(params, F.col("fold") < k) for k in range(1, folds + 1)])
    per = _union([_scores(predict(m, f.where(F.col("fold") == k)), "gbt").withColumn("fold", F.lit(k)) for k, m in enumerate(models, 1)])
    mean = per.agg(F.sum("n").alias("n"), *[F.avg(c).alias(c) for c in ("mae", "rmse", "wmape", "r2")]).withColumn("fold", F.lit(0))
    return per.unionByName(mean)


def with_confidence(df: DataFrame, pred: str, rmse: Column, confidence: float = 0.9) -> DataFrame:
    z = round(NormalDist().inv_cdf((1 + confidence) / 2), 3)
    return df.withColumns({"lower": clipped(F.col(pred) - rmse * z), "upper": F.col(pred) + rmse * z})


def walk_forward(df: DataFrame, splits: int = 3, test_months: int = 1, min_train: int = 100, min_test: int = 10, **params) -> DataFrame:
    """Metrics of the last months, one month after the other, each with a model of all earlier rows."""
    lo = df.agg(F.min("date").alias("d")).scalar()
    total = df.agg(((F.year(F.max("date")) - F.year(F.min("date"))) * 12 + F.month(F.max("date")) - F.month(F.min("date"))).alias("m")).scalar()
    edge = [F.add_months(lo, total - splits * test_months + i * test_months) for i in range(splits + 1)]
    train = [F.col("date") < edge[i] for i in range(splits)]
    test = [(F.col("date") >= edge[i]) & (F.col("date") < edge[i + 1]) for i in range(splits)]
    n = df.agg(*[F.count_if(c).alias(f"{k}{i}") for k, cs in (("train", train), ("test", test)) for i, c in enumerate(cs)]).first()
    use = [i for i in range(splits) if n[f"train{i}"] >= min_train and n[f"test{i}"] >= min_test]
    models = fit_all(df, [(params, train[i]) for i in use])
    return _union([_scores(predict(m, df.where(test[i])), "gbt").withColumn("split", F.lit(i)) for i, m in zip(use, models)])


def tune(df: DataFrame, grid: list[dict]) -> DataFrame:
    """Validation MAE of each parameter set on the explicit time split; best first."""
    train, val, _ = parts(df)
    # trees depend on those before them only: settings that differ in maxIter alone are one fit, the shorter its first trees
    rest = lambda p: tuple(sorted((k, v) for k, v in p.items() if k != "maxIter"))
    longest = {}
    for p in grid:
        n, had = p.get("maxIter", DEFAULTS["maxIter"]), longest.get(rest(p), {})
        longest[rest(p)] = had if had.get("maxIter", -1) >= n else {**p, "maxIter": n}
    fitted = dict(zip(longest, fit_all(train, [(p, None) for p in longest.values()])))
    models = [fitted[rest(p)].first(p.get("maxIter", DEFAULTS["maxIter"])) for p in grid]
    scores = [_scores(predict(m, val), "gbt").select("mae").withColumns({"no": F.lit(i), **{k: F.lit(v) for k, v in p.items()}})
              for i, (p, m) in enumerate(zip(grid, models))]
    return _union(scores).orderBy("mae", "no")


def model_comparison(model: Model, test: DataFrame) -> DataFrame:
    """All models on the test window: baselines, trees, hybrid, buffered and waste-optimised."""
    t = blended(predict(model, test))
    models = {"naive_last_week": "naive", "moving_avg_7d": "ma7", "moving_avg_28d": "ma28", "gbt": "gbt",
              "hybrid_gbt30_ma7": "hybrid", "ma7_buffer20pct": "buffered", "waste_optimised": "waste_opt"}
    return metrics.compare_models(t, models)


def blended(df: DataFrame) -> DataFrame:
    """Baselines and blends next to a ``gbt`` column."""
    df = baselines.naive_last_week(df)
    df = baselines.moving_average(df, 7, "ma7")
    df = baselines.moving_average(df, 28, "ma28")
    df = baselines.hybrid(df, "gbt", "ma7")
    return baselines.waste_optimised(baselines.buffered(df, "ma7"))


# ---- per-series figures ------------------------------------------------------------

def residual_quantiles(df: DataFrame, train_until: Column, model_col: str = "gbt", qs: tuple[float, ...] = (0.5, 0.75, 0.9)) -> DataFrame:
    """Mean forecast plus the quantiles of the series' training residuals, not below 0."""
    resid = F.when(F.col("date") <= train_until, F.col(TARGET) - F.col(model_col))
    q = df.groupBy(*SERIES).agg(F.percentile(resid, F.array(*[F.lit(x) for x in qs])).alias("_q"))
    j = df.join(q, SERIES)
    return j.withColumns({f"q{int(x * 100)}": clipped(F.col(model_col) + F.coalesce(F.col("_q")[i], F.lit(0.0)))
                          for i, x in enumerate(qs)}).drop("_q")


def holdout(df: DataFrame, rows: int = 30, min_train: int = 60) -> DataFrame:
    """Mark the last n rows of each series with enough history as ``is_test``."""
    w = Window.partitionBy(*SERIES)
    d = df.withColumns({"_rn": F.row_number().over(w.orderBy(F.desc("date"))), "_n": F.count(F.lit(1)).over(w)})
    return d.where(F.col("_n") - rows >= min_train).withColumn("is_test", F.col("_rn") <= rows).drop("_n")


def item_holdout(df: DataFrame, rows: int = 30, min_train: int = 60, **params) -> DataFrame:
    """Metrics per series on its held-out rows, one model for all."""
    h = holdout(df, rows, min_train)
    model = fit_gbt(h.where(~F.col("is_test")).drop("_rn"), **params)
    test = predict(model, h.where("is_test"))
    return metrics.extended_metrics(test, SERIES, TARGET, "gbt").join(_scores(test, "gbt", SERIES).drop("r2"), SERIES)


def multi_horizon(df: DataFrame, horizons: tuple[int, ...] = (1, 7, 30), min_train: int = 60, **params) -> DataFrame:
    """The hold-out of the last h rows for several h, per series and horizon."""
    w = Window.partitionBy(*SERIES)
    d = df.withColumns({"_rn": F.row_number().over(w.orderBy(F.desc("date"))), "_n": F.count(F.lit(1)).over(w)})
    long = [F.col("_n") - h >= min_train for h in horizons]
    models = fit_all(d, [(params, c & (F.col("_rn") > h)) for c, h in zip(long, horizons)])
    return _union([_scores(predict(m, d.where(c & (F.col("_rn") <= h))), "gbt", SERIES).withColumn("horizon", F.lit(h))
                   for m, c, h in zip(models, long, horizons)])


def quantile_forecast(train: DataFrame, df: DataFrame, qs: tuple[float, ...] = (0.5, 0.75, 0.9), **params) -> DataFrame:
    """A boosted model of its own for each quantile, by pinball loss: columns q50, q75, ..."""
    for q, m in zip(qs, fit_all(train, [({**params, "quantile": q}, None) for q in qs])):
        df = predict(m, df, f"q{int(q * 100)}")
    return df


# ---- recursive forecast ------------------------------------------------------------

HISTORY = 30
_SPANS = (7, 14, 30)
STEP_COLS = [*[f"lag_{n}" for n in (1, 7, 14, 28)], *[f"{f}_{n}" for n in _SPANS for f in ("mean", "std", "max", "min")], "ewm_7", "ewm_14",
             "dow", "month", "quarter", "is_weekend", "is_month_start", "is_month_end", "dow_sin", "dow_cos", "month_sin", "month_cos"]


def step_matrix(h: np.ndarray, dates: np.ndarray) -> np.ndarray:
    """Features (STEP_COLS x rows) of the day ``dates`` from the up to 30 days before it: rows of ``h``, newest last, NaN before the first.

    A lag the history does not reach is the mean of what there is; windows take the days they find.
    """
    known = ~np.isnan(h)
    n, x = known.sum(axis=1), np.where(known, h, 0.0)
    mean = x.sum(axis=1) / n
    out = [np.where(n >= k, x[:, -k], mean) for k in (1, 7, 14, 28)]
    for k in _SPANS:
        v, ok = x[:, -k:], known[:, -k:]
        m = np.minimum(n, k)
        avg = v.sum(axis=1) / m
        spread = np.sqrt(np.where(ok, (v - avg[:, None]) ** 2, 0.0).sum(axis=1) / np.maximum(m - 1, 1))
        out += [avg, spread, np.where(ok, v, -np.inf).max(axis=1), np.where(ok, v, np.inf).min(axis=1)]
    for k in (7, 14):
        r = 1 - 2.0 / (k + 1)
        out.append((x * r ** np.arange(x.shape[1] - 1, -1, -1)).sum(axis=1) * (1 - r) / (1 - r**n))
    day = dates.astype("datetime64[D]")
    dow, month = ((day.astype(int) + 3) % 7).astype(float), (day.astype("datetime64[M]").astype(int) % 12 + 1).astype(float)
    first = day == day.astype("datetime64[M]").astype("datetime64[D]")
    next_first = (day + 1) == (day + 1).astype("datetime64[M]").astype("datetime64[D]")
    out += [dow, month, (month - 1) // 3 + 1, dow >= 5, first, next_first]
    out += [f(v * 2 * math.pi / p) for v, p in ((dow, 7), (month, 12)) for f in (np.sin, np.cos)]
    return np.stack([np.asarray(v, dtype=float) for v in out])


def _histories(column: pa.Array) -> np.ndarray:
    """Lists of up to HISTORY values as rows of a matrix, newest last."""
    n = np.diff(column.offsets.to_numpy())
    out = np.full((len(column), HISTORY), np.nan)
    out[np.arange(HISTORY) >= HISTORY - n[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def history_rows(df: DataFrame) -> DataFrame:
    """Every day but a series' first with the array of the up to 30 days before it."""
    w = Window.partitionBy(*SERIES).orderBy("date").rowsBetween(-HISTORY, -1)
    return df.select(*SERIES, "date", F.col(TARGET).cast("double").alias(TARGET)).withColumn(
        "history", F.collect_list(TARGET).over(w)).where(F.size("history") > 0)


def _step_rows(batches):
    for batch in batches:
        x = step_matrix(_histories(batch.column("history")), batch.column("date").cast(pa.int32()).to_numpy().astype("datetime64[D]"))
        yield pa.RecordBatch.from_arrays([*map(pa.array, x), batch.column(TARGET)], names=[*STEP_COLS, TARGET])


def _horizon(model, days: int, names: list[str]):
    """Day by day: predict, append to the history, rebuild the features, for all series of a batch at once."""
    def run(batches):
        for batch in batches:
            h, last = _histories(batch.column("history")), batch.column("date").cast(pa.int32()).to_numpy()
            for k in range(1, days + 1):
                p = np.maximum(model.value.score(step_matrix(h, (last + k).astype("datetime64[D]"))), 0.0)
                h = np.concatenate([h[:, 1:], p[:, None]], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in SERIES], pa.array((last + k).astype(np.int32)).cast(pa.date32()), pa.array(p)], names=names)

    return run


def recursive_forecast(df: DataFrame, days: int, **params) -> DataFrame:
    """The days after each series' last, every forecast entering the history of the next; one job after the fit."""
    schema = ", ".join(f"{c} double" for c in [*STEP_COLS, TARGET])
    model = fit_gbt(history_rows(df).select("date", "history", TARGET).mapInArrow(_step_rows, schema), STEP_COLS, **params)
    w = Window.partitionBy(*SERIES).orderBy("date").rowsBetween(-(HISTORY - 1), 0)
    last = df.select(*SERIES, "date", F.col(TARGET).cast("double").alias(TARGET)).withColumn("history", F.collect_list(TARGET).over(w))
    state = last.groupBy(*SERIES).agg(F.max_by("history", "date").alias("history"), F.max("date").alias("date")).where(F.size("history") > 0)
    keys = state.select(*SERIES).schema
    names = [*SERIES, "date", "predicted"]
    out = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in keys.fields], "date date", "predicted double"])
    return state.mapInArrow(_horizon(df.sparkSession.sparkContext.broadcast(model), days, names), out)


# ---- delta model -------------------------------------------------------------------

def delta_model(df: DataFrame, length: int = 60, test_rows: int = 30, min_train: int = 60) -> DataFrame:
    """Next-day forecast as last value plus predicted change; scored on the last rows of each series."""
    series = materialise(echo.series_arrays(df, TARGET))
    net = echo.fit(series, length, test_rows, min_train)
    return echo.holdout_forecasts(series, net, test_rows, min_train, TARGET)


def delta_next(df: DataFrame, length: int = 60) -> DataFrame:
    """Forecast of the day after the data per series; short histories are padded with zeros on the left."""
    series = materialise(echo.series_arrays(df, TARGET))
    return echo.next_day(series, echo.fit(series, length))


# ---- ensemble ----------------------------------------------------------------------

def median_of(cols: list[str]) -> Column:
    """Median of the known values of a few columns."""
    v = F.sort_array(F.array_compact(F.array(*[F.col(c).cast("double") for c in cols])))
    n = F.size(v)
    mid = F.floor((n + 1) / 2).cast("int")
    return F.when(n == 0, F.lit(None)).when(n % 2 == 1, F.try_element_at(v, mid)).otherwise(
        (F.try_element_at(v, mid) + F.try_element_at(v, mid + 1)) / 2)


def ensemble(latest: DataFrame, factors: DataFrame, days: int, models: list[str], perishable: list[str]) -> DataFrame:
    """Median of the available models times the weekday factor, for the days after the data.

    ``latest``: one row per series with date, name, quantity_sold, rolling_std_14d and the
    model columns, hybrid and waste_opt among them; ``factors``: item_id, dow, factor.
    """
    std = F.coalesce("rolling_std_14d", F.lit(0.0))
    cv = F.when(F.col(TARGET) > 0, std / F.when(F.col(TARGET) > 0, F.col(TARGET))).otherwise(0.0)
    base = latest.withColumns({"_e": median_of(models), "_w": F.col("waste_opt"), "_b": F.col("hybrid"), "demand_cv": cv,
                               "safety_stock_units": std * 1.65})
    future = base.withColumn("day", F.explode(F.sequence(F.date_add("date", 1), F.date_add("date", days), F.expr("interval 1 day")))).withColumn(
        "dow", F.weekday("day"))
    j = future.join(factors.select("item_id", "dow", "factor"), ["item_id", "dow"], "left").withColumn("factor", F.coalesce("factor", F.lit(1.0)))
    scaled = lambda c, k=1.0: rnd_even(F.greatest(F.col(c) * F.col("factor"), F.lit(0.0)) * k, 1)
    return j.select(
        *SERIES, F.col("day").alias("date"), rnd_even(TARGET, 1).alias("avg_daily_demand"), rnd_even("demand_cv", 3).alias("demand_cv"),
        baselines.risk_tier(F.col("demand_cv")).alias("demand_risk"), baselines.matches_any(F.col("item_name"), perishable).alias("is_perishable"),
        rnd_even("safety_stock_units", 1).alias("safety_stock_units"), scaled("_e").alias("forecast_balanced"),
        scaled("_w").alias("forecast_waste_optimized"), scaled("_b", 1.2).alias("forecast_stockout_optimized"),
        F.when(F.col("delta_forecast").isNull(), "ensemble_2model").otherwise("ensemble_3model").alias("model_source"))


def training_pipeline(df: DataFrame, model: Model, path: str, spark) -> DataFrame:
    """Split, predict with the model of the training rows, score, save; one row per step with its figure."""
    from larder.sources.files import save_predictions
    train, _, test = parts(df)
    scored = blended(predict(model, test))
    mae = _scores(scored, "hybrid").first()["mae"]
    save_model(model, path, spark, {"mae": mae})
    save_predictions(scored.withColumn("predicted", F.col("hybrid")).select("date", *SERIES, TARGET, "predicted"), f"{path}/predictions")
    steps = [("split", "train rows", float(train.count())), ("fit", "trees", float(len(model.trees))),
             ("predict", "test rows", float(scored.count())), ("score", "hybrid mae", float(mae))]
    return spark.createDataFrame(steps, "step string, figure string, value double")
