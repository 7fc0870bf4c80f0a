"""Queries over the daily grid take every item of a place, also more than 50, on tables built here."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from larder.operators import ml
from larder.plans import p_models
from larder.plans.sqlbase import Q as sql
from scripts.check import rows

ITEMS, DAYS, PLACES = 60, 61, 2
TABLES = {
    "region": "SELECT k::INTEGER AS r_regionkey, 'R' || k AS r_name FROM range(0, $places) AS t(k)",
    "nation": "SELECT k::INTEGER AS n_nationkey, 'N' || k AS n_name, k::INTEGER AS n_regionkey FROM range(0, $places) AS t(k)",
    "customer": "SELECT k AS c_custkey, k::INTEGER AS c_nationkey FROM range(0, $places) AS t(k)",
    "part": "SELECT k AS p_partkey, 'part ' || k AS p_name, 'Brand#' || k % 5 AS p_brand, 'TYPE ' || k AS p_type, 1::INTEGER AS p_size, 10.0 + k AS p_retailprice FROM range(0, $items) AS t(k)",
    "orders": """SELECT d * $places + c AS o_orderkey, c AS o_custkey, 'F' AS o_orderstatus, 100.0::DOUBLE AS o_totalprice, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * d::INTEGER AS o_orderdate,
  CASE WHEN d % 9 = 0 THEN '1-URGENT' ELSE '5-LOW' END AS o_orderpriority FROM range(0, $days) AS t(d), range(0, $places) AS u(c)""",
    # the items differ in size, and not every one is sold every day
    "lineitem": """SELECT o AS l_orderkey, i AS l_partkey, 0::BIGINT AS l_suppkey, i::INTEGER + 1 AS l_linenumber, (1 + i + o * 7 % 11)::DOUBLE AS l_quantity, (10 * (1 + i))::DOUBLE AS l_extendedprice, 0.0::DOUBLE AS l_discount
  FROM range(0, $days * $places) AS t(o), range(0, $items) AS u(i) WHERE (o + i) % 3 > 0""",
}


@pytest.fixture(scope="module")
def wide(tmp_path_factory):
    """A folder of tables with 60 items a place, and DuckDB on it."""
    at, con = str(tmp_path_factory.mktemp("wide")), duckdb.connect()
    for name, q in TABLES.items():
        for k, v in (("$items", ITEMS), ("$days", DAYS), ("$places", PLACES)):
            q = q.replace(k, str(v))
        path = os.path.join(at, f"{name}.parquet")
        con.execute(f"COPY ({q}) TO '{path}' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return at, con


def same_as_sql(spark, wide, key):
    at, con = wide
    df = entry.queries()[key](spark, at)
    cur = con.execute(entry.oracle_sql()[key])
    cols = [d[0] for d in cur.description]
    got = [tuple(r) for r in df.collect()]
    assert sorted(cols) == sorted(df.columns) and rows(df.columns, got, 5) == rows(cols, [tuple(r) for r in cur.fetchall()], 5)
    return got


def test_cost_presets_count_every_item(spark, wide):
    assert len(same_as_sql(spark, wide, "cost_presets")) == 4


def test_waste_risk_has_every_item(spark, wide):
    assert len(same_as_sql(spark, wide, "waste_risk")) == PLACES * ITEMS


# ---- models: without any split the trees say the mean of the training rows, which plain sums give ----------

@pytest.fixture
def no_splits(monkeypatch):
    monkeypatch.setitem(ml.DEFAULTS, "minInstancesPerNode", 10**9)
    monkeypatch.setitem(ml.DEFAULTS, "maxIter", 1)


@pytest.fixture(scope="module")
def cube(wide):
    """Quantity by day and series, all of them."""
    got = wide[1].execute(sql("grid", "SELECT quantity_sold FROM grid ORDER BY date, place_id, item_id")).fetchnumpy()["quantity_sold"]
    return np.asarray(got, dtype=float).reshape(DAYS, PLACES * ITEMS)


def mean_error(cube, train, test):
    return np.abs(cube[test] - cube[1:][train[1:]].mean()).mean()  # the first day has no lag, so no training row


DAY = np.arange(DAYS)


def test_cv_metrics_fold_every_item(spark, wide, cube, no_splits):
    got = {r["fold"]: r for r in entry.queries()["cv_metrics"](spark, wide[0]).collect()}
    fold = DAY * 6 // DAYS
    for k in range(1, 6):
        assert got[k]["n"] == (fold == k).sum() * PLACES * ITEMS and got[k]["mae"] == pytest.approx(mean_error(cube, fold < k, fold == k))
    assert got[0]["n"] == (fold > 0).sum() * PLACES * ITEMS


def test_fc_quantile_forecasts_every_item(spark, wide, cube, no_splits):
    got = entry.queries()["fc_quantile"](spark, wide[0]).collect()
    share = DAY / DAYS
    assert len(got) == (share >= 0.7).sum() * PLACES * ITEMS and {r["item_id"] for r in got} == {f"TYPE {k}" for k in range(ITEMS)}
    train = cube[1:][share[1:] < 0.7]
    assert got[0]["gbt"] == pytest.approx(train.mean())
    for q in (0.5, 0.75, 0.9):
        said = {r[f"q{int(q * 100)}"] for r in got}
        assert len(said) == 1 and said.pop() == pytest.approx(np.quantile(train, q, method="inverted_cdf"), abs=1.5)  # bins 2 % wide, one step


def test_model_comparison_scores_every_item(spark, wide, cube, no_splits):
    got = {r["model"]: r for r in entry.queries()["model_comparison"](spark, wide[0]).collect()}
    share = DAY / DAYS
    test = share >= 0.85
    assert got["gbt"]["mae"] == pytest.approx(mean_error(cube, share < 0.7, test))
    naive = cube[DAY[test] - 7]
    assert got["naive_last_week"]["mae"] == pytest.approx(np.abs(cube[test] - naive).mean())
    assert got["naive_last_week"]["overstock_units"] == np.maximum(naive - cube[test], 0).sum()


def test_tune_gbt_validates_on_every_item(spark, wide, cube, no_splits, monkeypatch):
    monkeypatch.setattr(p_models, "TUNING", {"maxIter": (1,), "maxDepth": (1, 2), "stepSize": (1.0,)})
    got = entry.queries()["tune_gbt"](spark, wide[0]).collect()
    share = DAY / DAYS
    want = mean_error(cube, share < 0.7, (share >= 0.7) & (share < 0.85))
    assert [r["mae"] for r in got] == [pytest.approx(want)] * 2
