"""Compare every registered query with its SQL on DuckDB.

    python tools/check_queries.py [sf_dir] [name ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from millrace.plans import ORACLES, QUERIES  # noqa: E402
from millrace.session import local_session  # noqa: E402


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return repr(float(v) + 0.0)
    if hasattr(v, "as_tuple"):
        return repr(float(v))
    return str(v)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(QUERIES)
    spark = local_session(8)
    spark.sparkContext.setLogLevel("OFF")
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    bad = 0
    for name in wanted:
        started = time.monotonic()
        try:
            df = QUERIES[name](spark, sf_dir)
            rows = [tuple(r) for r in df.collect()]
            spent = time.monotonic() - started
            if name not in ORACLES:
                print(f"rows  {name:28s} {len(rows):7d} rows {spent:6.2f}s", flush=True)
                continue
            found = con.execute(ORACLES[name])
            head, want = [d[0] for d in found.description], found.fetchall()
            got_cols, got = normal(df.columns, rows)
            want_cols, expected = normal(head, want)
            if got_cols == want_cols and got == expected:
                print(f"ok    {name:28s} {len(rows):7d} rows {spent:6.2f}s", flush=True)
                continue
            bad += 1
            print(f"DIFF  {name:28s} {len(got)} vs {len(expected)} rows; columns {got_cols} vs {want_cols}", flush=True)
            only_got = [g for g in got if g not in set(expected)][:3]
            only_want = [e for e in expected if e not in set(got)][:3]
            print("   spark:", only_got, "\n   sql:  ", only_want, flush=True)
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name:28s} {type(error).__name__}: {str(error)[:600]}", flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} agree")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
