"""Compare registered queries with their SQL on DuckDB: ``python check.py [sf_dir] [name-part ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from axisflow.catalog import load
from axisflow.session import build_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 and math.copysign(1, v) < 0 else v
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((norm(k), norm(x)) for k, x in v.items()))
    return v


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    queries, oracles = load()
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
                                                  "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    bad = []
    for name, fn in queries.items():
        if parts and not any(p in name for p in parts):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            cols = sorted(df.columns)
            got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
            dt = time.time() - t0
            if name not in oracles:
                print(f"rows  {name}: {len(got)} rows {dt:.1f}s {got[0] if got else ''}"[:230], flush=True)
                if not got:
                    bad.append(name)
                continue
            cur = con.execute(oracles[name])
            names = [d[0] for d in cur.description]
            order = [names.index(c) for c in sorted(names)]
            want = sorted((tuple(norm(r[i]) for i in order) for r in cur.fetchall()), key=repr)
            if sorted(names) != cols:
                raise AssertionError(f"columns {cols} vs {sorted(names)}")
            diff = [(a, b) for a, b in zip(got, want) if a != b or [type(x) for x in a] != [type(y) for y in b]]
            if len(got) != len(want) or diff:
                raise AssertionError(f"{len(got)} vs {len(want)} rows, {len(diff)} differ; first: {diff[:2]}")
            flag = "" if got else "  EMPTY"
            if not got:
                bad.append(name)
            print(f"ok    {name}: {len(got)} rows {dt:.1f}s duck {time.time() - t0 - dt:.1f}s{flag}", flush=True)
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"FAIL  {name}: {type(e).__name__}: {str(e)[:900]}", flush=True)
    print(f"{len(bad)} problems: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
