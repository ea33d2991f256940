"""Run registered queries and their DuckDB statements on the same tables and compare.

    python -m tests.compare [--sf DIR] [--show] [name ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import sys
import time

import duckdb

from fettle.plans import catalog
from fettle.session import build_session
from fettle.sources.views import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(x):
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, float) and math.isnan(x):
        return "NaN"
    if isinstance(x, (dt.datetime, dt.date)):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(plain(i) for i in x)
    if isinstance(x, dict):
        return tuple(sorted((str(k), plain(v)) for k, v in x.items()))
    return x


def kind(x) -> str:
    return type(x).__name__


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def check(spark, con, sf_dir: str, name: str, fn, sql: str | None, show: bool = False) -> tuple[bool, str]:
    start = time.time()
    df = fn(spark, sf_dir)
    names = df.columns
    got = rows_of(names, df.collect())
    took = time.time() - start
    if sql is None:
        return True, f"{len(got)} rows {took:.2f}s (rows only)"
    cur = con.execute(sql)
    duck_names = [d[0] for d in cur.description]
    want = rows_of(duck_names, cur.fetchall())
    if sorted(names) != sorted(duck_names):
        return False, f"columns {sorted(names)} != {sorted(duck_names)}"
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}; got {got[:2]} want {want[:2]}"
    for g, w in zip(got, want):
        if g != w or [kind(i) for i in g] != [kind(i) for i in w]:
            return False, f"cols {sorted(names)}\n   got  {g}\n   want {w}"
    if show:
        print(sorted(names), got[:3])
    return True, f"{len(got)} rows {took:.2f}s" + ("  EMPTY" if not got else "")


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--show", action="store_true")
    ap.add_argument("--like", default="")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark = build_session("compare", 8)
    con = connect(args.sf)
    queries, oracles = catalog.queries(), catalog.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if (args.names and name not in args.names) or args.like not in fn.__module__ + name:
            continue
        try:
            ok, note = check(spark, con, args.sf, name, fn, oracles.get(name), args.show)
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:700]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + f"{name:<28} {note}", flush=True)
    print(f"{bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
