"""Time the headline queries: one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_KEYS (comma list) and BENCH_COMPARE=1 (adds the checking SQL's time in
DuckDB). Every query starts from the files: cached frames are dropped first.
"""

from __future__ import annotations

import glob
import json
import os
import time

from larder import plans  # noqa: F401 - fills the registry
from larder.plans import frames, registry
from larder.session import clean_scratch, local_session

HEADLINE = [
    "daily_demand", "daily_sales", "topn_per_store", "date_grid", "feature_matrix", "rolling_minmax", "ewm_features",
    "sales_for_forecast", "top_sellers", "order_stats", "orders_daily", "numeric_profile", "iqr_filter", "dedup_first",
    "evaluate_predictions", "compare_models", "business_impact", "prep_schedule", "waste_risk", "ingredient_demand",
    "cold_start", "fc_history", "stock_ledger", "stock_floor_ledger", "similar_recipes", "stream_today", "fc_delta",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    keys = os.environ["BENCH_KEYS"].split(",") if os.environ.get("BENCH_KEYS") else HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus))
    run(registry.QUERIES["orders_daily"](spark, sf))  # starts the JVM's workers and reads the schemas
    times = {}
    for k in keys:
        spark.catalog.clearCache()
        frames._MADE.clear()
        t = time.time()
        run(registry.QUERIES[k](spark, sf))
        times[k] = round(time.time() - t, 3)
        clean_scratch(spark)
    out = {"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
           "sf": os.path.basename(sf.rstrip("/")), "cpus": int(cpus)}
    if os.environ.get("BENCH_COMPARE"):
        import duckdb
        con = duckdb.connect()
        con.execute(f"SET threads = {int(cpus)}")
        for f in glob.glob(f"{sf}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
        base = {}
        for k in keys:
            if k in registry.ORACLES:
                t = time.time()
                con.execute(registry.ORACLES[k]).fetchall()
                base[k] = round(time.time() - t, 3)
        out["sql_seconds"] = base
    print(json.dumps(out))


if __name__ == "__main__":
    main()
