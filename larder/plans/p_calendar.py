"""Calendar, holiday, weather and promotion context; the full feature matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import calendars
from larder.functions.exprs import rnd
from larder.operators import calendar, features, joins, promo
from larder.plans import frames, p_joins  # noqa: F401 - its shared SQL
from larder.plans.p_scan import _OUDIN
from larder.plans.registry import query
from larder.plans.sqlbase import CTES, Q
from larder.sources import bindings


def order_days(spark, sf):
    return calendars.days_of(bindings.read(spark, sf, "orders"), "o_orderdate")


def holiday_dim(spark, sf):
    return calendars.holidays(calendars.years_of(bindings.read(spark, sf, "orders"), "o_orderdate", 1, 1))


_HOL = _OUDIN.replace("SELECT MIN(YEAR(o_orderdate)) AS a, MAX(YEAR(o_orderdate)) AS b", "SELECT MIN(YEAR(o_orderdate)) - 1 AS a, MAX(YEAR(o_orderdate)) + 1 AS b")
CTES["odays"] = ([], """SELECT CAST(d AS DATE) AS date FROM (SELECT MIN(CAST(o_orderdate AS TIMESTAMP)) AS lo, MAX(CAST(o_orderdate AS TIMESTAMP)) AS hi FROM orders),
  UNNEST(generate_series(lo, hi, INTERVAL 1 DAY)) AS t(d)""")
_hol_parts = [p.strip() for p in _HOL.split("),\n")]
CTES["hol"] = ([], "WITH " + _HOL + " SELECT CAST(date AS DATE) AS date, holiday_name FROM hol")
CTES["eas"] = ([], "WITH " + _HOL + " SELECT y, CAST(e AS DATE) AS e FROM eas")
CTES["cal"] = (["odays"], """SELECT date, strftime(date, '%A') AS day_of_week, ISODOW(date) AS day_of_week_num, ISODOW(date) >= 6 AS is_weekend,
  ISODOW(date) = 5 AS is_friday, ISODOW(date) = 1 AS is_monday, WEEK(date) AS week_number, MONTH(date) AS month, DAY(date) AS day_of_month,
  DAY(date) <= 3 AS is_month_start, DAY(date) >= DAY(LAST_DAY(date)) - 2 AS is_month_end FROM odays""")
CTES["retail"] = (["odays", "eas"], """SELECT date, date = e - 49 AS is_fastelavn, MONTH(date) = 6 AND DAY(date) = 23 AS is_sankt_hans,
  MONTH(date) = 11 AND ISODOW(date) = 5 AND DAY(date) <= 7 AS is_j_dag, MONTH(date) IN (11, 12) AND DAY(date) <= 23 AS is_julefrokost_season,
  MONTH(date) = 12 AND DAY(date) <= 24 AS is_christmas_season,
  CASE WHEN date <= make_date(YEAR(date), 12, 24) THEN make_date(YEAR(date), 12, 24) - date ELSE make_date(YEAR(date) + 1, 12, 24) - date END AS days_to_christmas,
  MONTH(date) = 12 AND DAY(date) = 31 AS is_new_years_eve, MONTH(date) IN (5, 6, 7, 8) AS is_grilling_season,
  (WEEK(date) IN (42, 7, 8) OR (MONTH(date) = 12 AND DAY(date) >= 23) OR (MONTH(date) = 1 AND DAY(date) <= 4) OR date BETWEEN e - 3 AND e + 5
    OR MONTH(date) = 7 OR (MONTH(date) = 6 AND DAY(date) >= 28) OR (MONTH(date) = 8 AND DAY(date) <= 10)) AS is_school_holiday,
  MONTH(date) = 11 AND ISODOW(date) = 5 AND DAY(date) BETWEEN 22 AND 28 AS is_black_friday,
  CASE WHEN MONTH(date) IN (12, 1, 2) THEN 'winter' WHEN MONTH(date) <= 5 THEN 'spring' WHEN MONTH(date) <= 8 THEN 'summer' ELSE 'autumn' END AS season
FROM odays JOIN eas ON y = YEAR(date)""")
CTES["pay"] = (["odays", "hol"], """SELECT date_trunc('month', x) AS m, MAX(x) AS pay FROM (SELECT CAST(d AS DATE) AS x FROM
  (SELECT MIN(date) - 62 AS lo, MAX(date) + 62 AS hi FROM odays), UNNEST(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS t(d))
WHERE ISODOW(x) < 6 AND x NOT IN (SELECT date FROM hol) GROUP BY 1""")
CTES["payday"] = (["odays", "hol", "pay"], """SELECT *, days_to_payday <= 2 OR days_since_payday <= 2 AS is_payday_week FROM (SELECT date,
  ISODOW(date) < 6 AND date NOT IN (SELECT date FROM hol) AS is_business_day,
  date - (SELECT MAX(pay) FROM pay WHERE pay < date OR (pay < date AND m = date_trunc('month', date))) AS days_since_payday,
  (SELECT MIN(pay) FROM pay WHERE pay >= date) - date AS days_to_payday FROM odays)""")
CTES["free"] = (["odays", "hol"], """SELECT CAST(d AS DATE) AS x FROM (SELECT MIN(date) - 10 AS lo, MAX(date) + 10 AS hi FROM odays),
  UNNEST(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS t(d) WHERE ISODOW(d) >= 6 OR CAST(d AS DATE) IN (SELECT date FROM hol)""")
CTES["lw"] = (["free"], "SELECT MIN(x) AS s, MAX(x) AS e FROM (SELECT x, x - CAST(ROW_NUMBER() OVER (ORDER BY x) AS INTEGER) AS g FROM free) GROUP BY g HAVING COUNT(*) >= 3")
CTES["holsig"] = (["odays", "hol", "lw"], """SELECT o.date, CAST(h.date IS NOT NULL AS BIGINT) AS is_holiday, COALESCE(h.holiday_name, '') AS holiday_name,
  CAST(o.date + 1 IN (SELECT date FROM hol) AS BIGINT) AS is_day_before_holiday, CAST(o.date - 1 IN (SELECT date FROM hol) AS BIGINT) AS is_day_after_holiday,
  (SELECT ARG_MIN(holiday_name, date) FROM hol x WHERE x.date > o.date) AS next_holiday, (SELECT MIN(date) FROM hol x WHERE x.date > o.date) - o.date AS days_to_next_holiday,
  EXISTS (SELECT 1 FROM lw WHERE o.date BETWEEN s AND e) AS is_long_weekend, EXISTS (SELECT 1 FROM lw WHERE s - o.date BETWEEN 1 AND 3) AS long_weekend_approaching
FROM odays o LEFT JOIN hol h ON h.date = o.date""")
_CODES = ", ".join(f"({k}, '{v}')" for k, v in calendar.WMO_TEXT.items())
CTES["wx"] = ([], f"""SELECT w.*, CASE WHEN precipitation_mm > 1.0 THEN 1 ELSE 0 END AS is_rainy,
  CASE WHEN weather_code IS NULL THEN 'unknown' ELSE COALESCE(c.t, 'code_' || weather_code) END AS weather_description, ROUND(sunshine_s / 3600, 1) AS sunshine_hours
FROM (SELECT CAST(o_orderdate AS DATE) AS date, CAST(COUNT(*) * 5 % 31 AS DOUBLE) AS temperature_max, CAST(COUNT(*) * 5 % 31 - 8 AS DOUBLE) AS temperature_min,
  CAST(SUM(o_custkey) % 37 AS BIGINT) / 10 AS precipitation_mm, CAST(SUM(o_custkey) % 100 AS BIGINT) AS precip_probability,
  CAST(NULLIF(SUM(o_custkey) % 100, 50) AS BIGINT) AS weather_code, CAST(SUM(o_custkey) % 40000 AS BIGINT) AS sunshine_s, COUNT(*) % 13 = 0 AS severe_weather
  FROM orders GROUP BY 1) w LEFT JOIN (VALUES {_CODES}) c(k, t) ON c.k = weather_code""")
_stock = [("is_friday OR is_weekend", "'weekend/Friday = higher foot traffic'"),
          ("is_day_before_holiday = 1 OR long_weekend_approaching", "'pre-holiday/long-weekend shopping surge'"),
          ("temperature_max > 22", "'warm (' || CAST(temperature_max AS VARCHAR) || 'C) = more outdoor activity, beverage demand'"),
          ("is_payday_week", "'payday week = higher discretionary spending'"), ("is_grilling_season", "'grilling season = outdoor food demand'"),
          ("is_julefrokost_season", "'Julefrokost season = office party supplies'"), ("is_christmas_season", "'Christmas season = elevated demand'"),
          ("is_school_holiday", "'school holiday = families at home, snack demand'")]
_waste = [("is_monday", "'Monday = historically lowest demand day'"), ("is_holiday = 1", "'holiday = stores may be closed or low traffic'"),
          ("is_day_after_holiday = 1", "'post-holiday = demand dip'"),
          ("precip_probability > 60", "'rain likely (' || precip_probability || '%) = less foot traffic'"), ("severe_weather", "'active severe weather warning'")]
_cnt = lambda xs: " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c, _ in xs)
_txt = lambda xs: "concat_ws('; ', " + ", ".join(f"CASE WHEN {c} THEN {t} END" for c, t in xs) + ")"
CTES["bias"] = (["cal", "retail", "payday", "holsig", "wx"], f"""SELECT *, CASE WHEN stockout_signals - waste_signals >= 2 THEN 'stockout_reduce'
  WHEN stockout_signals - waste_signals <= -1 THEN 'waste_reduce' ELSE 'neutral' END AS bias,
  CASE WHEN stockout_signals + waste_signals = 0 THEN 'No strong signals either way.' ELSE concat_ws(' | ', CASE WHEN stockout_signals > 0 THEN 'Stockout risks: ' || st END,
    CASE WHEN waste_signals > 0 THEN 'Waste risks: ' || wt END) END AS reasoning
FROM (SELECT *, {_cnt(_stock)} AS stockout_signals, {_cnt(_waste)} AS waste_signals, {_txt(_stock)} AS st, {_txt(_waste)} AS wt
  FROM cal JOIN retail USING (date) JOIN payday USING (date) JOIN holsig USING (date) LEFT JOIN wx USING (date))""")


@query("calendar_signals", Q("cal", "SELECT * FROM cal"))
def _(spark, sf):
    return calendar.calendar_signals(order_days(spark, sf))


@query("retail_calendar", Q("retail", "SELECT * FROM retail"))
def _(spark, sf):
    return calendar.retail_signals(order_days(spark, sf))


@query("payday_signals", Q("payday", "SELECT * FROM payday"))
def _(spark, sf):
    return calendar.payday_signals(order_days(spark, sf), holiday_dim(spark, sf))


@query("holiday_features", Q("holsig", "SELECT * FROM holsig"))
def _(spark, sf):
    return calendar.holiday_signals(order_days(spark, sf), holiday_dim(spark, sf))


@query("weather_features", Q("wx", "SELECT * FROM wx"))
def _(spark, sf):
    return calendar.weather_features(bindings.weather_by_order_day(spark, sf))


def context(spark, sf):
    return calendar.context_signals(order_days(spark, sf), holiday_dim(spark, sf), bindings.weather_by_order_day(spark, sf))


@query("signal_bias", Q("bias", "SELECT date, bias, reasoning, stockout_signals, waste_signals FROM bias"))
def _(spark, sf):
    return context(spark, sf).select("date", "recommendation_bias.*")


_ALL = calendar.CALENDAR + calendar.RETAIL + calendar.HOLIDAY + calendar.BUSINESS + calendar.WEATHER + calendar.BIAS


@query("context_signals", Q("bias", f"SELECT date, {', '.join(_ALL)} FROM bias"))
def _(spark, sf):
    c = context(spark, sf)
    return c.select("date", "calendar.*", "retail.*", "holidays.*", "business.*", "weather.*", "recommendation_bias.*")


_OPEN = """CASE WHEN place_id = 0 AND ISODOW(date) = 1 THEN 0 WHEN place_id = 3 AND ISODOW(date) >= 6 THEN 0 ELSE 1 END AS is_open"""


@query("is_open_flag", Q("days places", f"SELECT date, place_id, {_OPEN} FROM places CROSS JOIN days"))
def _(spark, sf):
    d = frames.grid(spark, sf).select("date", "place_id").distinct()
    return calendar.opening_flag(d, bindings.opening_hours(spark, sf)).select("date", "place_id", "is_open")


def build_features(spark, sf, top_n=None):
    """Grid of all series, dimensions, calendar, opening, holiday, weather, promotion, lag and rolling columns.

    Series windows run right after the grid, on its one exchange by series; the
    day-level columns are joined on afterwards from small daily tables.
    """
    f = frames.enriched(features.rolling_features(features.lag_features(frames.grid(spark, sf, top_n=top_n))), spark, sf)
    days = f.select("date").distinct()
    per_day = joins.calendar_join(features.time_features(days), bindings.weather_by_order_day(spark, sf), holiday_dim(spark, sf))
    cal = promo.promo_calendar(frames.campaign_days(spark, sf))
    place_days = promo.add_promotion_features(calendar.opening_flag(
        f.select("date", "place_id").distinct(), bindings.opening_hours(spark, sf)), cal)
    return f.join(place_days, ["date", "place_id"]).join(per_day, "date")


@query("feature_matrix", Q("feats items places recency hol wx", f"""t AS (SELECT DISTINCT date FROM grid)""",
  f"""SELECT f.date, f.place_id, f.item_id, f.quantity_sold, f.revenue, f.order_count, item_name, item_price, item_type, store_name,
  demand_lag_1d, demand_lag_7d, demand_lag_14d, demand_lag_28d, rolling_mean_7d, rolling_mean_14d, rolling_mean_30d,
  ROUND(rolling_std_7d, 6) AS rolling_std_7d, ROUND(rolling_std_14d, 6) AS rolling_std_14d, expanding_mean, demand_lag_7d AS demand_same_weekday_last_week,
  (demand_lag_7d + demand_lag_14d + lag21 + demand_lag_28d) / 4 AS demand_same_weekday_avg_4weeks,
  ISODOW(f.date) - 1 AS day_of_week, DAY(f.date) AS day_of_month, MONTH(f.date) AS month, QUARTER(f.date) AS quarter, WEEK(f.date) AS week_of_year,
  DAYOFYEAR(f.date) AS day_of_year, YEAR(f.date) AS year, CAST(ISODOW(f.date) >= 6 AS BIGINT) AS is_weekend, CAST(ISODOW(f.date) = 5 AS BIGINT) AS is_friday,
  CAST(ISODOW(f.date) = 1 AS BIGINT) AS is_monday, (MONTH(f.date) % 12) // 3 AS season,
  ROUND(SIN(2 * PI() * (ISODOW(f.date) - 1) / 7), 9) + 0 AS dow_sin, ROUND(COS(2 * PI() * (ISODOW(f.date) - 1) / 7), 9) + 0 AS dow_cos,
  ROUND(SIN(2 * PI() * (MONTH(f.date) - 1) / 12), 9) + 0 AS month_sin, ROUND(COS(2 * PI() * (MONTH(f.date) - 1) / 12), 9) + 0 AS month_cos,
  {_OPEN.replace('place_id', 'f.place_id').replace('(date)', '(f.date)')}, CAST(h.date IS NOT NULL AS BIGINT) AS is_holiday, COALESCE(h.holiday_name, '') AS holiday_name,
  CAST(f.date + 1 IN (SELECT date FROM hol) AS BIGINT) AS is_day_before_holiday, CAST(f.date - 1 IN (SELECT date FROM hol) AS BIGINT) AS is_day_after_holiday,
  wx.temperature_max, wx.temperature_min, wx.precipitation_mm, COALESCE(wx.is_rainy, 0) AS is_rainy,
  r.is_promotion_active, r.discount_percentage, r.promotion_type, r.campaign_count, r.days_since_last_promotion, r.days_until_next_promotion
FROM feats f LEFT JOIN items USING (item_id) LEFT JOIN places p ON p.place_id = f.place_id JOIN recency r ON r.date = f.date AND r.place_id = f.place_id
LEFT JOIN hol h ON h.date = f.date LEFT JOIN wx ON wx.date = f.date"""))
def _(spark, sf):
    out = build_features(spark, sf)
    return out.withColumns({
        **{c: rnd(c, 9) + 0 for c in ("dow_sin", "dow_cos", "month_sin", "month_cos")},
        **{c: rnd(c) for c in ("rolling_std_7d", "rolling_std_14d")}})
