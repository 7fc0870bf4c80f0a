"""Boosted trees, quantiles, recursion, echo-state and trend models, against plain versions and baselines."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.operators import boosting, echo, ml, trend
from larder.operators.boosting import GBTRegressor

D0 = dt.date(2022, 1, 3)


def frame(spark, x, y, extra=()):
    cols = [f"x{k}" for k in range(x.shape[1])]
    rows = [(*[None if np.isnan(v) else float(v) for v in r], float(t), *e) for r, t, e in zip(x, y, extra or [()] * len(y))]
    kind = ", ".join(f"{c} double" for c in [*cols, "y"]) + (", part int" if extra else "")
    return spark.createDataFrame(rows, kind).repartition(3), cols


def settings(**kw):
    return GBTRegressor(**{"labelCol": "y", "maxIter": 1, "maxDepth": 3, "stepSize": 1.0, "subsamplingRate": 1.0, "featureSubsetStrategy": "1.0",
                           "minInstancesPerNode": 3, "treesPerRound": 1, **kw})


def scores(model, x):
    return model.score(np.ascontiguousarray(x.T))


def plain_tree(bins, g, depth, least, lam):
    """Forecast of each row by greedy splits over all bins, one node at a time."""
    out = np.zeros(bins.shape[1])

    def grow(rows, d):
        best, gt, ct = (1e-9, None), g[rows].sum(), len(rows)
        if d < depth and ct >= 2 * least:
            for nulls_left in (True, False):
                for f in range(len(bins)):
                    for b in range(1, bins[f].max() + 1):
                        v = bins[f, rows]
                        left = (v <= b) & (v > 0) | (v == 0) & nulls_left
                        if left.sum() >= least and (~left).sum() >= least:
                            gl = g[rows][left].sum()
                            gain = gl**2 / (left.sum() + lam) + (gt - gl) ** 2 / ((~left).sum() + lam) - gt**2 / (ct + lam)
                            if gain > best[0] * (1 + 1e-9):
                                best = (gain, rows[left], rows[~left])
        if best[1] is None:
            out[rows] = -gt / (ct + lam) if d else 0.0
        else:
            grow(best[1], d + 1)
            grow(best[2], d + 1)

    grow(np.arange(bins.shape[1]), 0)
    return out


def test_one_tree_is_the_greedy_tree(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(400, 3)), 1)
    y = 4 * x[:, 0] - 3 * (x[:, 1] > 0.3) + rng.normal(0, 0.3, 400)
    x[rng.random(400) < 0.2, 0] = np.nan
    df, cols = frame(spark, x, y)
    m = boosting.fit(df, cols, [(settings(), F.lit(True))])[0]
    bins = boosting.binned(np.ascontiguousarray(x.T), m.edges)
    want = m.base + plain_tree(bins.astype(int), m.base - y, 3, 3, 1.0)
    assert m.base == pytest.approx(y.mean()) and np.allclose(scores(m, x), want, atol=2e-4)


def test_fits_side_by_side_are_the_same_as_alone(spark, monkeypatch):
    monkeypatch.setattr(boosting, "CUT", 2)  # also with written sums
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 4))
    y = np.sin(2 * x[:, 0]) + x[:, 1] ** 2
    df, cols = frame(spark, x, y, [(int(i % 3),) for i in range(600)])
    df = df.coalesce(1).sortWithinPartitions("x0")
    a, b = (settings(maxIter=n, stepSize=0.3, maxDepth=d, treesPerRound=2, subsamplingRate=0.7, featureSubsetStrategy="0.5") for n, d in ((7, 3), (10, 2)))
    conds = [F.col("part") < 2, F.lit(True)]
    both = boosting.fit(df, cols, [(a, conds[0]), (b, conds[1])])
    assert [len(m.trees) for m in both] == [7, 10]
    alone = boosting.fit(df, cols, [(b, conds[1])])[0]
    assert np.allclose(scores(both[1], x), scores(alone, x), atol=1e-3)
    back = boosting.Model.from_json(both[0].to_json())
    assert np.array_equal(scores(back, x), scores(both[0], x)) and sum(v for _, v in back.importances()) == pytest.approx(1)
    assert np.mean((scores(both[1], x) - y) ** 2) < 0.5 * y.var()


def test_nulls_learn_their_side(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 1))
    y = np.where(x[:, 0] > 0, 10.0, 0.0)
    x[:150, 0], y[:150] = np.nan, 10.0
    df, cols = frame(spark, x, y)
    m = boosting.fit(df, cols, [(settings(maxDepth=1), F.lit(True))])[0]
    got = scores(m, np.array([[np.nan], [1.0], [-1.0], [np.inf]]))
    assert got[0] == got[1] == got[3] and got[0] > 9 and got[2] < 1


def test_no_rows_and_constant_targets(spark):
    df, cols = frame(spark, np.ones((20, 2)), np.full(20, 4.0))
    m, none = boosting.fit(df, cols, [(settings(maxIter=3), F.lit(True)), (settings(maxIter=3), F.lit(False))])
    assert np.allclose(scores(m, np.zeros((2, 2))), 4.0) and np.allclose(scores(none, np.zeros((2, 2))), 0.0)


def test_quantile_models_cover_their_share(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 1, size=(4000, 2))
    y = 10 * x[:, 0] + rng.exponential(5 * (1 + x[:, 0]), 4000)
    df, cols = frame(spark, x, y)
    ask = [settings(maxIter=40, stepSize=0.2, maxDepth=3, treesPerRound=4, minInstancesPerNode=20, quantile=q) for q in (0.5, 0.75, 0.9)]
    for spec, m in zip(ask, boosting.fit(df, cols, [(s, F.lit(True)) for s in ask])):
        p = scores(m, x)
        for part in (x[:, 0] < 0.5, x[:, 0] >= 0.5):
            assert (y[part] <= p[part]).mean() == pytest.approx(spec.quantile, abs=0.05)


def test_sketch_of_residuals_is_near_the_quantile():
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(0, 100, 5000), np.zeros(500), rng.normal(0, 1e-3, 500)])
    counts = sum(np.bincount(boosting.sketch(part), minlength=2 * boosting.REACH + 1) for part in np.array_split(v, 7))
    for q in (0.1, 0.5, 0.75, 0.9, 0.99):
        assert boosting.sketch_quantile(counts, q) == pytest.approx(np.quantile(v, q), rel=0.03, abs=1e-2)


def demand(spark, series=12, days=420, seed=6, spread=3):
    """Weekly rhythm and noise, which a lag of seven days follows with the noise twice."""
    rng = random.Random(seed)
    rows = []
    for k in range(series):
        week = [rng.uniform(2, 30) for _ in range(7)]
        for i in range(days):
            rows.append((D0 + dt.timedelta(days=i), k % 3, k, max(0.0, round(week[i % 7] + rng.gauss(0, spread), 1))))
    return spark.createDataFrame(rows, "date date, place_id long, item_id long, quantity_sold double")


def test_boosted_trees_beat_naive_on_the_held_out_window(spark):
    from larder.operators import features
    df = ml.encode_categoricals(features.rolling_features(features.lag_features(demand(spark, 60, spread=6))).withColumns(
        {"day_of_week": F.weekday("date"), "day_of_year": F.dayofyear("date")}))
    train, _, test = ml.parts(df)
    scored = ml.blended(ml.predict(ml.fit_gbt(train, maxIter=60), test))
    mae = {c: ml._scores(scored, c).first()["mae"] for c in ("gbt", "naive", "ma7")}
    assert mae["gbt"] < 0.85 * mae["naive"] and mae["gbt"] < 0.85 * mae["ma7"]


def test_step_features_of_short_and_long_histories():
    h = np.full((2, ml.HISTORY), np.nan)
    h[0, -3:] = [1, 2, 6]
    h[1] = np.arange(30)
    x = dict(zip(ml.STEP_COLS, ml.step_matrix(h, np.array(["2024-02-29", "2024-03-01"], dtype="datetime64[D]"))))
    assert x["lag_1"].tolist() == [6, 29] and x["lag_7"].tolist() == [3, 23] and x["lag_28"].tolist() == [3, 2]
    assert x["mean_7"][0] == 3 and x["max_14"][0] == 6 and x["min_30"].tolist() == [1, 0] and x["std_7"][0] == pytest.approx(np.std([1, 2, 6], ddof=1))
    assert x["ewm_7"][0] == pytest.approx(np.average([1, 2, 6], weights=[0.75**2, 0.75, 1]))
    assert x["dow"].tolist() == [3, 4] and x["month"].tolist() == [2, 3] and x["quarter"].tolist() == [1, 1]
    assert x["is_month_end"].tolist() == [1, 0] and x["is_month_start"].tolist() == [0, 1] and x["is_weekend"].tolist() == [0, 0]


def test_recursive_forecast_feeds_itself(spark, monkeypatch):
    df = demand(spark, 4, 90)
    kept = []
    real = ml.fit_gbt
    monkeypatch.setattr(ml, "fit_gbt", lambda *a, **k: kept.append(real(*a, **k)) or kept[-1])
    got = {(r["item_id"], r["date"]): r["predicted"] for r in ml.recursive_forecast(df, 5, maxIter=20, maxDepth=3).collect()}
    for item in range(4):
        h = [r["quantity_sold"] for r in df.where(F.col("item_id") == item).orderBy("date").collect()][-ml.HISTORY:]
        for k in range(5):
            day = D0 + dt.timedelta(days=90 + k)
            p = max(0.0, float(kept[0].score(ml.step_matrix(np.array([h]), np.array([day], dtype="datetime64[D]")))[0]))
            assert got[item, day] == pytest.approx(p)
            h = h[1:] + [p]
    assert len(got) == 20


def test_echo_readout_is_the_ridge_solution(spark):
    df = demand(spark, 5, 200)
    series = echo.series_arrays(df, "quantity_sold")
    net = echo.fit(series, 30, 20, 60)
    xs, ys = [], []
    for r in series.collect():
        x, y, m = echo.cut(np.array(r["values"]), 30, 20, 60)
        xs.append(net.features(x[:m]))
        ys.append(y[:m] / net.scale)
    z, y = np.vstack(xs), np.concatenate(ys)
    want = np.linalg.solve(z.T @ z + echo.RIDGE * len(z) * np.eye(z.shape[1]), z.T @ y)
    assert np.allclose(net.readout, want, atol=1e-8)


def test_echo_beats_last_value_and_pads_short_series(spark):
    df = demand(spark, 8, 300)
    scored = ml.delta_model(df, 60, 30)
    err = scored.agg(F.avg(F.abs(F.col("predicted_next") - F.col("actual_next"))).alias("p"), F.avg(F.abs(F.col("quantity_sold") - F.col("actual_next"))).alias("last")).first()
    assert scored.count() == 8 * 30 and err["p"] < 0.6 * err["last"]
    short = df.where("item_id > 0 OR date < '2022-01-06'")
    assert ml.delta_next(short, 60).where("delta_forecast < 0 OR delta_forecast IS NULL").count() == 0 and ml.delta_next(short, 60).count() == 8


def test_trend_bends_where_the_series_does():
    rng = np.random.default_rng(7)
    day = np.arange(700.0) + 19000
    t = np.arange(700) / 600
    y = 30 + 20 * t - 45 * np.maximum(t - 0.5, 0) + 4 * np.sin(2 * np.pi * day / 7) + rng.normal(0, 0.8, 700)
    seen = np.arange(700) < 600
    yhat, sigma, b = trend.fit_series(day, y, seen, np.zeros((700, 0)))
    assert np.sqrt(np.mean((yhat - y)[~seen] ** 2)) < 2.0 and sigma == pytest.approx(0.8, abs=0.15)
    bends = b[2: 2 + trend.CHANGEPOINTS]
    assert (bends != 0).sum() < trend.CHANGEPOINTS / 2
    flat, _, b = trend.fit_series(day, 5 + rng.normal(0, 1, 700), seen, np.zeros((700, 0)))
    assert np.abs(b[2: 2 + trend.CHANGEPOINTS]).max() < 0.3 and np.abs(flat - 5).max() < 1.5


def test_coordinate_descent_meets_the_optimum():
    rng = np.random.default_rng(8)
    a = rng.normal(size=(80, 6))
    y = a @ np.array([1, 0, 0, 2, 0, -1]) + rng.normal(0, 0.1, 80)
    l1, l2 = np.array([0, 5, 5, 5, 5, 0.0]), np.array([0.5, 0, 0, 0, 0, 0.5])
    b = trend.solve(a.T @ a, a.T @ y, l1, l2)
    grad = a.T @ (a @ b - y) + l2 * b
    assert np.allclose(grad[l1 == 0], 0, atol=1e-4)
    for g, v, p in zip(grad[l1 > 0], b[l1 > 0], l1[l1 > 0]):
        assert abs(g) <= p + 1e-4 if v == 0 else g == pytest.approx(-p * np.sign(v), abs=1e-4)


def test_tuning_fits_settings_of_different_length_once(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(D0 + dt.timedelta(days=d), p, 1, float(x), float(3 * x + p + rng.normal(0, 0.1))) for p in range(3) for d, x in enumerate(rng.integers(0, 9, 90))]
    df = spark.createDataFrame(rows, "date date, place_id long, item_id long, day_of_week double, quantity_sold double").repartition(2)
    grid = [{"maxIter": n, "maxDepth": d, "stepSize": 0.4} for n in (4, 3) for d in (1, 2)]  # rounds of two trees: three end inside a round
    asked, fit_all = [], ml.fit_all
    monkeypatch.setattr(ml, "fit_all", lambda f, fits, *a, **k: asked.append(len(fits)) or fit_all(f, fits, *a, **k))
    got = {(r["maxIter"], r["maxDepth"]): (r["no"], r["mae"]) for r in ml.tune(df, grid).collect()}
    assert asked == [2] and {k: v[0] for k, v in got.items()} == {(p["maxIter"], p["maxDepth"]): i for i, p in enumerate(grid)}
    train, val, _ = ml.parts(df)
    for p in grid:
        alone = ml._scores(ml.predict(ml.fit_gbt(train, **p), val), "gbt").first()["mae"]
        assert got[p["maxIter"], p["maxDepth"]][1] == pytest.approx(alone, abs=1e-6)
    assert len({round(m, 6) for _, m in got.values()}) == 4
