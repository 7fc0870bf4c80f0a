"""Demand cube, grid, features, baselines and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions.exprs import rnd
from larder.operators import baselines, demand, features, metrics
from larder.plans import frames
from larder.plans.registry import query
from larder.plans.sqlbase import M, Q, S, _W

KEYS = ["date", "place_id", "item_id"]
MODELS = {"naive": "naive", "ma7": "predicted", "ma28": "ma28", "buffered": "buffered"}


@query("daily_demand", Q("daily", "SELECT * FROM daily"))
def _(spark, sf):
    return frames.daily(spark, sf)


@query("topn_per_store", Q("daily_nb", """SELECT place_id, item_id, total_quantity, rank FROM (
  SELECT place_id, item_id, SUM(quantity_sold) AS total_quantity,
    ROW_NUMBER() OVER (PARTITION BY place_id ORDER BY SUM(quantity_sold) DESC, item_id) AS rank
  FROM daily_nb GROUP BY place_id, item_id) WHERE rank <= 5"""))
def _(spark, sf):
    return demand.topn_per_store(frames.daily(spark, sf, "nation"), 5)


@query("date_grid", Q("daily", "kept AS (SELECT place_id, item_id FROM (SELECT place_id, item_id, ROW_NUMBER() OVER "
       "(PARTITION BY place_id ORDER BY SUM(quantity_sold) DESC, item_id) AS r FROM daily GROUP BY place_id, item_id) WHERE r <= 50)",
       "d AS (SELECT * FROM daily SEMI JOIN kept USING (place_id, item_id))",
       "b AS (SELECT MIN(date) AS lo, MAX(date) AS hi FROM d)",
       "g AS (SELECT CAST(x AS DATE) AS date FROM b, UNNEST(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS t(x))",
       """SELECT g.date, kept.place_id, kept.item_id, COALESCE(d.quantity_sold, 0) AS quantity_sold,
  COALESCE(d.revenue, 0) AS revenue, COALESCE(d.order_count, 0) AS order_count
FROM kept CROSS JOIN g LEFT JOIN d USING (date, place_id, item_id)"""))
def _(spark, sf):
    return frames.grid(spark, sf, top_n=50)


@query("series_reindex", Q("daily_nb", """spans AS (SELECT place_id, item_id, MIN(date) AS lo, MAX(date) AS hi
FROM daily_nb GROUP BY place_id, item_id)""", """SELECT CAST(t.d AS DATE) AS date, s.place_id, s.item_id,
  COALESCE(n.quantity_sold, 0) AS quantity_sold
FROM spans s, UNNEST(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS t(d)
LEFT JOIN daily_nb n ON n.place_id = s.place_id AND n.item_id = s.item_id AND n.date = CAST(t.d AS DATE)"""))
def _(spark, sf):
    return demand.series_reindex(frames.daily(spark, sf, "nation"))


@query("future_dates", Q("series bounds", """SELECT place_id, item_id, CAST(hi + CAST(k AS INTEGER) AS DATE) AS date
FROM series, bounds, range(1, 15) AS t(k)"""))
def _(spark, sf):
    return demand.future_dates(frames.daily(spark, sf), 14)


@query("time_features", Q("days", """SELECT date, ISODOW(date) - 1 AS day_of_week, DAY(date) AS day_of_month, MONTH(date) AS month,
  QUARTER(date) AS quarter, WEEK(date) AS week_of_year, DAYOFYEAR(date) AS day_of_year, YEAR(date) AS year,
  CAST(ISODOW(date) >= 6 AS BIGINT) AS is_weekend, CAST(ISODOW(date) = 5 AS BIGINT) AS is_friday,
  CAST(ISODOW(date) = 1 AS BIGINT) AS is_monday,
  CASE WHEN MONTH(date) IN (12, 1, 2) THEN 0 WHEN MONTH(date) IN (3, 4, 5) THEN 1 WHEN MONTH(date) IN (6, 7, 8) THEN 2 ELSE 3 END AS season,
  ROUND(SIN(2 * PI() * (ISODOW(date) - 1) / 7), 9) + 0 AS dow_sin, ROUND(COS(2 * PI() * (ISODOW(date) - 1) / 7), 9) + 0 AS dow_cos,
  ROUND(SIN(2 * PI() * (MONTH(date) - 1) / 12), 9) + 0 AS month_sin, ROUND(COS(2 * PI() * (MONTH(date) - 1) / 12), 9) + 0 AS month_cos
FROM days"""))
def _(spark, sf):
    days = frames.grid(spark, sf).select("date").distinct()
    out = features.time_features(days)
    return out.withColumns({c: rnd(c, 9) + 0 for c in ("dow_sin", "dow_cos", "month_sin", "month_cos")})


@query("time_features_v2", Q("days", """SELECT date, ISODOW(date) - 1 AS day_of_week, DAY(date) AS day_of_month, MONTH(date) AS month,
  QUARTER(date) AS quarter, WEEK(date) AS week_of_year, YEAR(date) AS year, CAST(ISODOW(date) >= 6 AS BIGINT) AS is_weekend,
  CAST(DAY(date) = 1 AS BIGINT) AS is_month_start, CAST(date = LAST_DAY(date) AS BIGINT) AS is_month_end,
  ROUND(SIN(2 * PI() * (ISODOW(date) - 1) / 7), 9) + 0 AS dow_sin, ROUND(COS(2 * PI() * (ISODOW(date) - 1) / 7), 9) + 0 AS dow_cos,
  ROUND(SIN(2 * PI() * MONTH(date) / 12), 9) + 0 AS month_sin, ROUND(COS(2 * PI() * MONTH(date) / 12), 9) + 0 AS month_cos,
  CAST(DAY(date) <= 7 AS BIGINT) AS is_first_week, CAST(DAY(date) >= 24 AS BIGINT) AS is_last_week
FROM days"""))
def _(spark, sf):
    days = frames.grid(spark, sf).select("date").distinct()
    loose = features.time_features_v2(days, start_until=7, end_from=24).select(
        "date", F.col("is_month_start").alias("is_first_week"), F.col("is_month_end").alias("is_last_week"))
    out = features.time_features_v2(days).join(loose, "date")
    return out.withColumns({c: rnd(c, 9) + 0 for c in ("dow_sin", "dow_cos", "month_sin", "month_cos")})


@query("lag_features", Q("feats", """SELECT date, place_id, item_id, quantity_sold, demand_lag_1d, demand_lag_7d, demand_lag_14d,
  demand_lag_28d FROM feats"""))
def _(spark, sf):
    return features.lag_features(frames.grid(spark, sf)).drop("revenue", "order_count")


@query("rolling_mean", Q("feats", "SELECT date, place_id, item_id, rolling_mean_7d, rolling_mean_14d, rolling_mean_30d FROM feats"))
def _(spark, sf):
    spec = {f"rolling_mean_{n}d": ("mean", n) for n in (7, 14, 30)}
    return features.rolling(frames.grid(spark, sf), "quantity_sold", demand.SERIES, spec).select(*KEYS, *spec)


@query("rolling_std", Q("feats", "SELECT date, place_id, item_id, ROUND(rolling_std_7d, 6) AS rolling_std_7d, "
       "ROUND(rolling_std_14d, 6) AS rolling_std_14d FROM feats"))
def _(spark, sf):
    spec = {f"rolling_std_{n}d": ("std", n) for n in (7, 14)}
    out = features.rolling(frames.grid(spark, sf), "quantity_sold", demand.SERIES, spec)
    return out.select(*KEYS, *[rnd(c).alias(c) for c in spec])


@query("weekday_avg", Q("feats", """SELECT date, place_id, item_id, demand_lag_7d AS demand_same_weekday_last_week,
  (demand_lag_7d + demand_lag_14d + lag21 + demand_lag_28d) / 4 AS demand_same_weekday_avg_4weeks FROM feats"""))
def _(spark, sf):
    return features.rolling_features(frames.grid(spark, sf)).select(
        *KEYS, "demand_same_weekday_last_week", "demand_same_weekday_avg_4weeks")


@query("expanding_mean", Q("feats", "SELECT date, place_id, item_id, expanding_mean FROM feats"))
def _(spark, sf):
    return features.rolling_features(frames.grid(spark, sf)).select(*KEYS, "expanding_mean")


def _rolling_sql(windows, kinds):
    fn = {"mean": "AVG", "std": "STDDEV_SAMP", "min": "MIN", "max": "MAX"}
    return ", ".join(
        f"ROUND({fn[k]}(quantity_sold) OVER ({_W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 6) AS rolling_{k}_{n}"
        for n in windows for k in kinds)


@query("rolling_minmax", Q("grid", f"SELECT date, place_id, item_id, {_rolling_sql((7, 14, 30), ('mean', 'std', 'max', 'min'))} FROM grid"))
def _(spark, sf):
    spec = {f"rolling_{k}_{n}": (k, n) for n in (7, 14, 30) for k in ("mean", "std", "max", "min")}
    out = features.rolling(frames.grid(spark, sf), "quantity_sold", demand.SERIES, spec)
    return out.select(*KEYS, *[rnd(c).alias(c) for c in spec])


def _ewm_sql(span):
    r = repr(1 - 2.0 / (span + 1))
    return f"ROUND(SUM(b.q * POW({r}::DOUBLE, a.n - b.n - 1)) / SUM(POW({r}::DOUBLE, a.n - b.n - 1)), 6) AS ewm_{span}d"


@query("ewm_features", Q("grid", "num AS (SELECT date, place_id, item_id, quantity_sold::DOUBLE AS q, ROW_NUMBER() OVER (PARTITION BY place_id, item_id ORDER BY date) AS n FROM grid)",
       f"""SELECT a.date, a.place_id, a.item_id, {', '.join(_ewm_sql(s) for s in (7, 14, 30))}
FROM num a LEFT JOIN num b ON a.place_id = b.place_id AND a.item_id = b.item_id AND b.n < a.n GROUP BY ALL"""))
def _(spark, sf):
    return features.ewm_features(frames.grid(spark, sf), spans=(7, 14, 30)).select(
        *KEYS, *[rnd(f"ewm_{s}d").alias(f"ewm_{s}d") for s in (7, 14, 30)])


@query("item_lag_features", Q("grid", "SELECT date, place_id, item_id, " + ", ".join(
    f"LAG(quantity_sold, {n}) OVER ({_W}) AS lag_{n}" for n in (1, 2, 3, 7, 14, 21, 28)) + ", " + ", ".join(
    f"CASE WHEN COUNT(*) OVER ({_W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) = {n} THEN "
    f"ROUND({f}(quantity_sold) OVER ({_W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 6) END AS rolling_{k}_{n}"
    for n in (7, 14, 28) for k, f in (("mean", "AVG"), ("std", "STDDEV_SAMP"), ("max", "MAX"))) + " FROM grid"))
def _(spark, sf):
    g = features.lag_features(frames.grid(spark, sf), lags=[1, 2, 3, 7, 14, 21, 28], name="lag_{}")
    spec = {f"rolling_{k}_{n}": (k, n) for n in (7, 14, 28) for k in ("mean", "std", "max")}
    out = features.rolling(g, "quantity_sold", demand.SERIES, spec, min_rows=-1)
    return out.select(*KEYS, *[f"lag_{n}" for n in (1, 2, 3, 7, 14, 21, 28)], *[rnd(c).alias(c) for c in spec])


@query("demand_deltas", Q("grid", f"SELECT date, place_id, item_id, quantity_sold - COALESCE(LAG(quantity_sold) OVER ({_W}), 0) AS delta FROM grid"))
def _(spark, sf):
    return features.demand_deltas(frames.grid(spark, sf)).select(*KEYS, "delta")


_DELTA = f"deltas AS (SELECT *, quantity_sold - COALESCE(LAG(quantity_sold) OVER ({_W}), 0) AS delta FROM grid)"


@query("delta_sequences", Q("grid", _DELTA, f"""seqs AS (SELECT date, place_id, item_id, LIST(delta) OVER ({_W} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS seq,
  LEAD(delta, 1) OVER ({_W}) AS target FROM deltas)""",
  """SELECT date, place_id, item_id, array_to_string(list_transform(seq, lambda x: CAST(x AS BIGINT)), ',') AS seq, target FROM seqs WHERE len(seq) = 60 AND target IS NOT NULL"""))
def _(spark, sf):
    out = features.delta_sequences(features.demand_deltas(frames.grid(spark, sf)), 60)
    return out.select(*KEYS, F.array_join(F.transform("seq", lambda x: x.cast("long")), ",").alias("seq"), "target")


@query("pad_sequences", Q("grid", _DELTA, f"""seqs AS (SELECT date, place_id, item_id,
  LIST(delta) OVER ({_W} ROWS BETWEEN 79 PRECEDING AND CURRENT ROW) AS seq FROM deltas)""",
  """SELECT date, place_id, item_id, array_to_string(list_transform(list_concat(list_resize(CAST([] AS DOUBLE[]), greatest(60 - len(seq), 0), 0.0),
  seq[greatest(len(seq) - 59, 1):]), lambda x: CAST(x AS BIGINT)), ',') AS padded FROM seqs"""))
def _(spark, sf):
    from larder.functions.exprs import series_window
    d = features.demand_deltas(frames.grid(spark, sf))
    seq = F.collect_list("delta").over(series_window(demand.SERIES, "date", -79, 0))
    padded = features.pad_sequence(F.col("seq"), 60)
    return d.withColumn("seq", seq).select(
        *KEYS, F.array_join(F.transform(padded, lambda x: x.cast("long")), ",").alias("padded"))


@query("latest_per_series", Q("feats", """SELECT place_id, item_id, MAX(date) AS date,
  ARG_MAX(quantity_sold, date) AS quantity_sold, ARG_MAX(rolling_mean_7d, date) FILTER (rolling_mean_7d IS NOT NULL) AS rolling_mean_7d,
  ARG_MAX(nonzero, date) FILTER (nonzero IS NOT NULL) AS last_nonzero
FROM (SELECT *, NULLIF(quantity_sold, 0) AS nonzero FROM feats) GROUP BY place_id, item_id"""))
def _(spark, sf):
    f = frames.features_frame(spark, sf).withColumn("nonzero", F.nullif(F.col("quantity_sold"), F.lit(0.0)))
    return features.latest_per_series(f, ["quantity_sold", "rolling_mean_7d", "nonzero"]).withColumnRenamed(
        "nonzero", "last_nonzero")


# ---- baselines ---------------------------------------------------------------------

@query("fc_naive", Q("pred", "SELECT date, place_id, item_id, naive FROM pred"))
def _(spark, sf):
    return baselines.naive_last_week(frames.grid(spark, sf)).select(*KEYS, "naive")


@query("fc_moving_avg", Q("feats", """SELECT date, place_id, item_id, COALESCE(rolling_mean_7d, 0) AS ma7,
  COALESCE(rolling_mean_14d, 0) AS ma14, COALESCE(rolling_mean_30d, 0) AS ma28 FROM feats"""))
def _(spark, sf):
    g = frames.grid(spark, sf)
    for n in (7, 14, 28):
        g = baselines.moving_average(g, n, f"ma{n}")
    return g.select(*KEYS, "ma7", "ma14", "ma28")


@query("fc_buffered", Q("pred", "SELECT date, place_id, item_id, buffered FROM pred"))
def _(spark, sf):
    g = baselines.moving_average(frames.grid(spark, sf), 7, "ma7")
    return baselines.buffered(g, "ma7").select(*KEYS, "buffered")


@query("baseline_mae", Q("pred", f"""SELECT model, {M('ABS(quantity_sold - pred)')} AS mae FROM (
  SELECT quantity_sold, UNNEST(['naive', 'ma7', 'ma28']) AS model, UNNEST([naive, predicted, ma28]) AS pred FROM pred) GROUP BY model"""))
def _(spark, sf):
    p = frames.predictions(spark, sf)
    return baselines.baseline_mae(p, {"naive": "naive", "ma7": "predicted", "ma28": "ma28"})


@query("fc_interval", Q("pred", "g AS (SELECT STDDEV_SAMP(quantity_sold) AS s FROM pred)",
       """SELECT date, place_id, item_id, ROUND(GREATEST(predicted - COALESCE(rolling_std_14d, g.s) * 1.96, 0), 6) AS lower,
  ROUND(predicted + COALESCE(rolling_std_14d, g.s) * 1.96, 6) AS upper FROM pred, g"""))
def _(spark, sf):
    out = baselines.interval(frames.predictions(spark, sf))
    return out.select(*KEYS, rnd("lower").alias("lower"), rnd("upper").alias("upper"))


_WMEANS = """m AS (SELECT item_id, ISODOW(date) - 1 AS dow, SUM(quantity_sold) / COUNT(*) AS dm FROM daily GROUP BY ALL)""", \
    """a AS (SELECT item_id, SUM(quantity_sold) / COUNT(*) AS am FROM daily GROUP BY item_id)"""


@query("weekday_factors", Q("daily_nb", "m AS (SELECT item_id, ISODOW(date) - 1 AS dow, SUM(quantity_sold) / COUNT(*) AS dm FROM daily_nb GROUP BY ALL)",
       "a AS (SELECT item_id, SUM(quantity_sold) / COUNT(*) AS am FROM daily_nb GROUP BY item_id)",
       """SELECT a.item_id, CAST(d.dow AS BIGINT) AS dow, COALESCE(LEAST(GREATEST(m.dm / a.am, 0.5), 1.8), 0.8) AS factor
FROM a CROSS JOIN range(0, 7) AS d(dow) LEFT JOIN m ON m.item_id = a.item_id AND m.dow = d.dow WHERE a.am > 0"""))
def _(spark, sf):
    return baselines.weekday_factors(frames.daily(spark, sf, "nation"))


_HIST = ("d AS (SELECT title AS item_name, date, SUM(quantity) AS quantity_sold FROM sales GROUP BY ALL)",
         """st AS (SELECT item_name, SUM(quantity_sold) / COUNT(*) AS av, COUNT(*) AS n, SUM(quantity_sold) AS tot,
  MIN(quantity_sold) AS mn, MAX(quantity_sold) AS mx,
  ROUND(STDDEV_SAMP(quantity_sold), 9) AS sd
FROM {src} GROUP BY item_name)""")
PERISHABLE = ["ring", "bolt"]
_PERISH_SQL = "(" + " OR ".join(f"LOWER(item_name) LIKE '%{w}%'" for w in PERISHABLE) + ")"


@query("fc_history", Q("sales", _HIST[0], _HIST[1].format(src="d"),
       "m AS (SELECT item_name, ISODOW(date) - 1 AS dow, SUM(quantity_sold) / COUNT(*) AS dm FROM d GROUP BY ALL)",
       "f AS (SELECT st.*, CAST(hi + CAST(k AS INTEGER) AS DATE) AS date FROM st, (SELECT MAX(date) AS hi FROM d), range(1, 8) AS t(k))",
       """p AS (SELECT f.*, GREATEST(f.av * COALESCE(LEAST(GREATEST(m.dm / f.av, 0.5), 1.8),
  CASE WHEN ISODOW(f.date) >= 6 THEN 0.8 WHEN ISODOW(f.date) = 5 THEN 1.1 ELSE 1.0 END), 0) AS pr,
  COALESCE(sd, 0) / av AS cv FROM f LEFT JOIN m ON m.item_name = f.item_name AND m.dow = ISODOW(f.date) - 1)""",
       f"""SELECT item_name, date, ROUND(pr, 4) AS predicted_quantity, ROUND(pr * 0.7, 4) AS lower_bound, ROUND(pr * 1.4, 4) AS upper_bound,
  CASE WHEN cv > 1.0 THEN 'high' WHEN cv > 0.5 THEN 'medium' ELSE 'low' END AS demand_risk, {_PERISH_SQL} AS is_perishable,
  ROUND(COALESCE(sd, 0) * 1.65, 4) AS safety_stock,
  CASE WHEN n >= 14 THEN 'medium' WHEN n >= 5 THEN 'low' ELSE 'very_low' END AS confidence FROM p"""))
def _(spark, sf):
    d = demand.item_daily_demand(frames.sales(spark, sf))
    return baselines.history_forecast(d, 7, PERISHABLE)


@query("fc_sql_fallback", Q("sales", _HIST[0],
       "r AS (SELECT * FROM d WHERE date >= (SELECT MAX(date) FROM d) - 60)", _HIST[1].format(src="r"),
       f"""SELECT item_name, ROUND(av, 4) AS avg_daily_demand, ROUND(sd / av, 4) AS demand_cv,
  CASE WHEN sd / av > 1.0 THEN 'high' WHEN sd / av > 0.5 THEN 'medium' ELSE 'low' END AS demand_risk, {_PERISH_SQL} AS is_perishable,
  ROUND(av * 0.85, 4) AS forecast_waste_optimized, ROUND(av * 1.20, 4) AS forecast_stockout_optimized,
  ROUND(av, 4) AS forecast_balanced, ROUND(sd * 1.65, 4) AS safety_stock, n AS active_days, mn AS min_daily, mx AS max_daily
FROM st ORDER BY av DESC, item_name LIMIT 30"""))
def _(spark, sf):
    d = demand.item_daily_demand(frames.sales(spark, sf))
    return baselines.average_fallback(d, 60, 30, PERISHABLE)


@query("fc_tail_mean", Q("daily_nb", "r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY place_id, item_id ORDER BY date DESC) AS rn FROM daily_nb)",
       """SELECT place_id, item_id, AVG(quantity_sold) FILTER (rn <= 7) AS mean_last_7, AVG(quantity_sold) FILTER (rn <= 4) AS mean_last_4,
  AVG(quantity_sold) FILTER (rn <= 3) AS mean_last_3 FROM r GROUP BY place_id, item_id"""))
def _(spark, sf):
    return baselines.tail_mean(frames.daily(spark, sf, "nation"))


# ---- metrics -----------------------------------------------------------------------

def _quality_sql(a="quantity_sold", p="pred"):
    w = f"CASE WHEN {S(a)} = 0 THEN 0 ELSE {S(f'ABS({a} - {p})')} / {S(a)} * 100 END"
    return {
        "mae": f"{S(f'ABS({a} - {p})')} / COUNT(*)",
        "rmse": f"SQRT({S(f'({a} - {p}) * ({a} - {p})')} / COUNT(*))",
        "mape": f"COALESCE({M(f'CASE WHEN {a} > 0 THEN ABS({a} - {p}) / {a} END', 9)} * 100, 0)",
        "wmape": w, "forecast_accuracy_pct": f"GREATEST(0, 100 - {w})"}


def _cost_sql(a="quantity_sold", p="pred", c="COALESCE(item_price, 75)", w=1.0, s=1.5):
    waste = S(f"GREATEST({p} - {a}, 0) * {c} * 0.3::DOUBLE")
    out = S(f"GREATEST({a} - {p}, 0) * {c}")
    return {"waste_cost_dkk": waste, "stockout_cost_dkk": out, "total": f"({waste} * {w} + {out} * {s})"}


def _volume_sql(a="quantity_sold", p="pred"):
    return {"total_actual_demand": S(a), "total_predicted": S(p), "overstock_units": S(f"GREATEST({p} - {a}, 0)"),
            "understock_units": S(f"GREATEST({a} - {p}, 0)"),
            "overstock_days_pct": f"COUNT(*) FILTER ({p} > {a}) / COUNT(*) * 100",
            "understock_days_pct": f"COUNT(*) FILTER ({p} < {a}) / COUNT(*) * 100", "n_samples": "COUNT(*)"}


def _sel(d):
    return ", ".join(f"{v} AS {k}" for k, v in d.items())


def _eval_sql(p="predicted"):
    c = _cost_sql(p=p)
    return _sel({**_quality_sql(p=p), "waste_cost_dkk": c["waste_cost_dkk"], "stockout_cost_dkk": c["stockout_cost_dkk"],
                 "total_business_cost_dkk": c["total"], **_volume_sql(p=p)})


@query("forecast_metrics", Q("pred", f"SELECT {_sel(_quality_sql(p='predicted'))} FROM pred"))
def _(spark, sf):
    return frames.predictions(spark, sf).agg(*metrics.named(metrics.quality()))


@query("evaluate_predictions", Q("pred", f"SELECT place_id, {_eval_sql()} FROM pred GROUP BY place_id UNION ALL SELECT NULL, {_eval_sql()} FROM pred"))
def _(spark, sf):
    p = frames.predictions(spark, sf)
    overall = metrics.evaluate_predictions(p).withColumn("place_id", F.lit(None).cast("long"))
    return metrics.evaluate_predictions(p, ["place_id"]).unionByName(overall)


@query("extended_metrics", Q("pred", f"""SELECT item_id, 1 - {S('(quantity_sold - predicted) * (quantity_sold - predicted)')}
    / ({S('quantity_sold * quantity_sold')} - {S('quantity_sold')} * {S('quantity_sold')} / COUNT(*)) AS r2,
  COUNT(*) FILTER (predicted < quantity_sold) / COUNT(*) AS stockout_rate, COUNT(*) FILTER (predicted > quantity_sold) / COUNT(*) AS overstock_rate,
  {S('GREATEST(quantity_sold - predicted, 0)')} AS shortage_units, {S('GREATEST(predicted - quantity_sold, 0)')} AS waste_units,
  {M('CASE WHEN quantity_sold <> 0 THEN ABS((quantity_sold - predicted) / quantity_sold) END', 9)} * 100 AS mape_nonzero,
  {S('ABS(quantity_sold - predicted) / GREATEST(quantity_sold, 1)', 9)} / COUNT(*) * 100 AS mape_floor1
FROM pred GROUP BY item_id"""))
def _(spark, sf):
    return metrics.extended_metrics(frames.predictions(spark, sf), ["item_id"])


_c = _cost_sql()
_LONG = """long AS (SELECT *, UNNEST(['naive', 'ma7', 'ma28', 'buffered']) AS model,
  UNNEST([naive, predicted, ma28, buffered]) AS pred FROM pred)"""
_PER_MODEL = "per AS (SELECT model, " + _sel({
    **{k: v for k, v in _quality_sql().items() if k in ("mae", "wmape", "forecast_accuracy_pct")},
    "waste_cost_dkk": _c["waste_cost_dkk"], "stockout_cost_dkk": _c["stockout_cost_dkk"], "total_cost_dkk": _c["total"],
    "overstock_units": _volume_sql()["overstock_units"], "understock_units": _volume_sql()["understock_units"],
}) + " FROM long GROUP BY model)"


@query("compare_models", Q("pred", _LONG, _PER_MODEL, """SELECT *, MAX(total_cost_dkk) OVER () - total_cost_dkk AS savings_vs_worst_dkk,
  (MAX(total_cost_dkk) OVER () - total_cost_dkk) / MAX(total_cost_dkk) OVER () * 100 AS savings_vs_worst_pct FROM per"""))
def _(spark, sf):
    return metrics.compare_models(frames.predictions(spark, sf), MODELS)


_cp = _cost_sql(p="predicted")
_qp = {k: v for k, v in _quality_sql(p="predicted").items() if k in ("mae", "wmape", "forecast_accuracy_pct")}
_cc = {"waste_cost_dkk": _cp["waste_cost_dkk"], "stockout_cost_dkk": _cp["stockout_cost_dkk"]}


@query("eval_by_store", Q("pred", f"""SELECT place_id, MIN(store_name) AS store_name, {_sel({**_qp, **_cc})},
  {_cp['total']} AS total_cost_dkk, {S('quantity_sold')} AS total_demand, COUNT(*) AS n_samples FROM pred GROUP BY place_id"""))
def _(spark, sf):
    return metrics.evaluate_by_store(frames.predictions(spark, sf))


@query("eval_by_dow", Q("pred", f"""SELECT day_of_week, {_sel({**_qp, **_cc})}, ['Monday', 'Tuesday', 'Wednesday', 'Thursday',
  'Friday', 'Saturday', 'Sunday'][day_of_week + 1] AS day_name FROM pred GROUP BY day_of_week"""))
def _(spark, sf):
    return metrics.evaluate_by_dow(frames.predictions(spark, sf))


@query("cost_presets", Q("pred", f"one AS (SELECT {_sel(_cc)} FROM pred)", """SELECT p.*, waste_cost_dkk, stockout_cost_dkk,
  waste_cost_dkk * waste_weight + stockout_cost_dkk * stockout_weight AS total_cost_dkk
FROM one, (VALUES ('default', 1.0::DOUBLE, 1.5::DOUBLE), ('balanced', 1.0, 1.0), ('profit', 1.0, 2.0), ('sustainability', 2.0, 1.0)) AS p(preset, waste_weight, stockout_weight)"""))
def _(spark, sf):
    return metrics.cost_presets(frames.predictions(spark, sf))


@query("business_summary", Q("pred", _LONG, _PER_MODEL, "b AS (SELECT * FROM per ORDER BY total_cost_dkk, model LIMIT 1)",
       "w AS (SELECT * FROM per ORDER BY total_cost_dkk DESC, model DESC LIMIT 1)",
       """SELECT b.model AS best_model, w.model AS worst_model, b.forecast_accuracy_pct AS best_forecast_accuracy, b.wmape AS best_wmape,
  (w.waste_cost_dkk - b.waste_cost_dkk) * (365::DOUBLE / days) AS annual_waste_reduction_dkk,
  (w.stockout_cost_dkk - b.stockout_cost_dkk) * (365::DOUBLE / days) AS annual_stockout_reduction_dkk,
  (w.total_cost_dkk - b.total_cost_dkk) * (365::DOUBLE / days) AS annual_total_savings_dkk,
  (1 - b.waste_cost_dkk / GREATEST(w.waste_cost_dkk, 1)) * 100 AS waste_reduction_pct,
  (1 - b.stockout_cost_dkk / GREATEST(w.stockout_cost_dkk, 1)) * 100 AS stockout_reduction_pct FROM b, w, (SELECT COUNT(DISTINCT date) AS days FROM pred)"""))
def _(spark, sf):
    p = frames.predictions(spark, sf)
    return metrics.business_summary(metrics.compare_models(p, MODELS), p.agg(F.countDistinct("date")).scalar())
