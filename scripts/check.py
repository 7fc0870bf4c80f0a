"""Run registered queries against their checking SQL: check.py [sf_dir] [key ...]."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from larder.plans import registry
import larder.plans  # noqa: F401
from larder.session import local_session


def norm(v, digits):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int,)):
        return float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, digits) if digits is not None else v
    if hasattr(v, "quantize"):
        return norm(float(v), digits)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x, digits) for x in v)
    return str(v)


def rows(cols, data, digits):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(norm(r[i], digits) for i in order) for r in data)


def main():
    args = sys.argv[1:]
    sf = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    keys = [a for a in args if not os.path.isdir(a)] or list(registry.QUERIES)
    spark = local_session()
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    bad = []
    for k in keys:
        t = time.time()
        try:
            df = registry.QUERIES[k](spark, sf)
            got = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL  {k}: {type(e).__name__} {str(e)[:700]}", flush=True)
            bad.append(k)
            continue
        ts = time.time() - t
        sql = registry.ORACLES.get(k)
        if sql is None:
            print(f"rows  {k}: {len(got)} rows {ts:.1f}s", flush=True)
            if not got:
                bad.append(k)
            continue
        t = time.time()
        try:
            cur = con.execute(sql)
            cols = [d[0] for d in cur.description]
            want = [tuple(r) for r in cur.fetchall()]
        except Exception as e:  # noqa: BLE001
            print(f"SQL   {k}: {str(e)[:700]}", flush=True)
            bad.append(k)
            continue
        td = time.time() - t
        if sorted(cols) != sorted(df.columns):
            print(f"COLS  {k}: only spark {set(df.columns) - set(cols)} only sql {set(cols) - set(df.columns)}", flush=True)
            bad.append(k)
            continue
        a, b = rows(df.columns, got, None), rows(cols, want, None)
        state = "exact" if a == b else None
        for d in (9, 6, 4, 2):
            if state is None and rows(df.columns, got, d) == rows(cols, want, d):
                state = f"round{d}"
        if state is None:
            state = "DIFF"
            bad.append(k)
        print(f"{state:6}{k}: {len(got)}/{len(want)} rows spark {ts:.1f}s duck {td:.1f}s", flush=True)
        if state == "DIFF":
            order = sorted(df.columns)
            x, y = list((a - b).elements()), list((b - a).elements())
            x.sort(key=str); y.sort(key=str)
            print("   ", order)
            for r in x[:3]:
                print("   spark", r)
            for r in y[:3]:
                print("   sql  ", r)
    print("BAD", bad, flush=True)


if __name__ == "__main__":
    main()
