"""Common table expressions shared by the checking SQL."""

from __future__ import annotations


def S(x: str, scale: int = 6) -> str:
    """Order-independent sum, as exprs.exact_sum."""
    return f"CAST(SUM(CAST({x} AS DECIMAL(28,{scale}))) AS DOUBLE)"


def M(x: str, scale: int = 6) -> str:
    """Order-independent mean, as exprs.exact_mean."""
    return f"({S(x, scale)} / NULLIF(COUNT({x}), 0))"


_SALES = """SELECT o.o_orderkey AS order_id, CAST(o.o_orderdate AS DATE) AS date,
  CAST({place} AS BIGINT) AS place_id, p.{item} AS item_id, p.p_name AS title,
  l.l_quantity AS quantity, l.l_extendedprice AS cost, l.l_discount AS discount, p.p_retailprice AS price,
  l.l_linenumber AS line_no
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN part p ON l.l_partkey = p.p_partkey
WHERE o.o_orderstatus = 'F'"""

_DAILY = f"""SELECT date, place_id, item_id, SUM(quantity) AS quantity_sold, {S('cost', 2)} AS revenue,
  COUNT(DISTINCT order_id) AS order_count FROM {{src}} GROUP BY date, place_id, item_id"""

_W = "PARTITION BY place_id, item_id ORDER BY date"


def _win(agg: str, n: int | None) -> str:
    start = "UNBOUNDED PRECEDING" if n is None else f"{n} PRECEDING"
    return f"{agg} OVER ({_W} ROWS BETWEEN {start} AND 1 PRECEDING)"


CTES: dict[str, tuple[list[str], str]] = {
    "sales": ([], _SALES.format(place="n.n_regionkey", item="p_type")),
    "sales_nb": ([], _SALES.format(place="n.n_nationkey", item="p_brand")),
    "daily": (["sales"], _DAILY.format(src="sales")),
    "daily_nb": (["sales_nb"], _DAILY.format(src="sales_nb")),
    "bounds": (["daily"], "SELECT MIN(date) AS lo, MAX(date) AS hi FROM daily"),
    "days": (["bounds"], "SELECT CAST(d AS DATE) AS date FROM bounds, "
             "UNNEST(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS t(d)"),
    "series": (["daily"], "SELECT DISTINCT place_id, item_id FROM daily"),
    "grid": (["days", "series", "daily"], """SELECT days.date, series.place_id, series.item_id,
  COALESCE(daily.quantity_sold, 0) AS quantity_sold, COALESCE(daily.revenue, 0) AS revenue,
  COALESCE(daily.order_count, 0) AS order_count
FROM series CROSS JOIN days LEFT JOIN daily USING (date, place_id, item_id)"""),
    "items": ([], f"SELECT p_type AS item_id, MIN(p_name) AS item_name, {M('p_retailprice', 2)} AS item_price, "
              "MAX(p_brand) AS item_type FROM part GROUP BY p_type"),
    "places": ([], "SELECT CAST(r_regionkey AS BIGINT) AS place_id, r_name AS store_name FROM region"),
    "feats": (["grid"], f"""SELECT *,
  LAG(quantity_sold, 1) OVER ({_W}) AS demand_lag_1d, LAG(quantity_sold, 7) OVER ({_W}) AS demand_lag_7d,
  LAG(quantity_sold, 14) OVER ({_W}) AS demand_lag_14d, LAG(quantity_sold, 28) OVER ({_W}) AS demand_lag_28d,
  LAG(quantity_sold, 21) OVER ({_W}) AS lag21,
  {_win('AVG(quantity_sold)', 7)} AS rolling_mean_7d, {_win('AVG(quantity_sold)', 14)} AS rolling_mean_14d,
  {_win('AVG(quantity_sold)', 30)} AS rolling_mean_30d,
  {_win('STDDEV_SAMP(quantity_sold)', 7)} AS rolling_std_7d, {_win('STDDEV_SAMP(quantity_sold)', 14)} AS rolling_std_14d,
  {_win('AVG(quantity_sold)', None)} AS expanding_mean
FROM grid"""),
    "pred": (["feats", "items", "places"], """SELECT f.date, f.place_id, f.item_id, f.quantity_sold, f.revenue,
  i.item_name, i.item_price, i.item_type, p.store_name,
  COALESCE(f.demand_lag_7d, 0) AS naive, COALESCE(f.rolling_mean_7d, 0) AS predicted,
  COALESCE(f.rolling_mean_30d, 0) AS ma28, COALESCE(f.rolling_mean_7d, 0) * 1.2 AS buffered,
  CAST(ISODOW(f.date) - 1 AS BIGINT) AS day_of_week, f.rolling_std_14d
FROM feats f LEFT JOIN items i USING (item_id) LEFT JOIN places p USING (place_id)"""),
    "campaigns": ([], """SELECT o.o_orderkey AS campaign_id, CAST(n.n_regionkey AS BIGINT) AS place_id,
  CAST(o.o_orderdate AS DATE) AS start_date,
  CAST(o.o_orderdate AS DATE) + CAST(o.o_orderkey % 5 - 1 AS INTEGER) AS end_date,
  CAST((o.o_orderkey % 4 + 1) * 5 AS DOUBLE) AS discount,
  CASE o.o_orderkey % 3 WHEN 0 THEN 'percent' WHEN 1 THEN 'amount' ELSE 'bundle' END AS type
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
WHERE o.o_orderpriority = '1-URGENT' AND o.o_orderstatus = 'F'"""),
    "promo_days": (["campaigns"], """SELECT CAST(d AS DATE) AS date, place_id, campaign_id, discount, type
FROM campaigns, UNNEST(generate_series(CAST(start_date AS TIMESTAMP), CAST(end_date AS TIMESTAMP), INTERVAL 1 DAY)) AS t(d)
WHERE end_date >= start_date"""),
    "promo_cal": (["promo_days"], """SELECT date, place_id, COUNT(*) AS campaign_count, MAX(discount) AS discount_percentage,
  ARG_MIN(type, campaign_id) AS promotion_type, 1 AS is_promotion_active FROM promo_days GROUP BY date, place_id"""),
    "pdays": (["daily"], "SELECT DISTINCT date, place_id FROM daily"),
}


def _resolve(names: list[str], done: dict[str, None]) -> None:
    for n in names:
        if n not in done:
            _resolve(CTES[n][0], done)
            done[n] = None


def Q(uses: list[str] | str, *parts: str) -> str:
    """SELECT with the named shared CTEs; all parts but the last are 'name AS (...)'."""
    names: dict[str, None] = {}
    _resolve(uses.split() if isinstance(uses, str) else uses, names)
    ctes = [f"{n} AS ({CTES[n][1]})" for n in names] + list(parts[:-1])
    head = "WITH " + ",\n".join(ctes) + "\n" if ctes else ""
    return head + parts[-1]
