"""Compare every registered query with its checking SQL, strictly by value.

    python tools/check_oracle.py [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from papersieve.catalog import ORACLES, QUERIES  # noqa: E402
from papersieve.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, (int, str)):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    return ("type", type(value).__name__, str(value))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = build_session(
        "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
                       "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{args.sf}/{t}.parquet'")
    bad = 0
    for name, fn in QUERIES.items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        start = time.time()
        try:
            df = fn(spark, args.sf)
            got = rows_of(df.columns, [tuple(r) for r in df.collect()])
            took = time.time() - start
            if name not in ORACLES:
                print(f"rows  {name}: {len(got)} rows, {took:.1f}s", flush=True)
                continue
            rel = con.sql(ORACLES[name])
            want = rows_of(rel.columns, rel.fetchall())
            if sorted(df.columns) != sorted(rel.columns):
                bad += 1
                print(f"COLS  {name}: {sorted(df.columns)} vs {sorted(rel.columns)}", flush=True)
            elif got == want:
                print(f"ok    {name}: {len(got)} rows, {took:.1f}s", flush=True)
            else:
                bad += 1
                a, b = [r for r in got if r not in want][:3], [r for r in want if r not in got][:3]
                print(f"DIFF  {name}: {len(got)} vs {len(want)} rows\n   spark {a}\n   sql   {b}", flush=True)
        except Exception as problem:
            bad += 1
            print(f"FAIL  {name}: {str(problem)[:700]}", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
