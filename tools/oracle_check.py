"""Compare every registered query with its DuckDB oracle.

Usage: python tools/oracle_check.py [--sf DIR] [name ...]

For each query: row count, column names, column types and the multiset of
rows must agree. Queries without an oracle are run for their row count only.
"""

from __future__ import annotations

import argparse
import decimal
import json
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from vitrine.plans import QUERIES  # noqa: E402
from vitrine.session import get_session  # noqa: E402

RAW = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
       "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 9)
    if isinstance(v, decimal.Decimal):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


DUCK_TO_SPARK = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "BOOLEAN": "boolean",
                 "DOUBLE": "double", "DATE": "date", "TIMESTAMP": "timestamp"}


def _duck_type(t: str) -> str:
    t = str(t)
    if t.startswith("DECIMAL"):
        return t.lower().replace(" ", "")
    return DUCK_TO_SPARK.get(t, t.lower())


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark = get_session("local[8]", 8)
    con = duckdb.connect()
    for t in RAW:
        path = f"{args.sf}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    names = args.names or list(QUERIES)
    failures = []
    for name in names:
        q = QUERIES[name]
        t0 = time.time()
        try:
            df = q.build(spark, args.sf)
            s_cols = df.columns
            s_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
            s_rows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            failures.append(name)
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            continue
        dt = time.time() - t0
        sql = q.oracle()
        if sql is None:
            print(f"rows {name}: {len(s_rows)} rows ({dt:.2f}s)")
            continue
        try:
            res = con.execute(sql)
            d_cols = [c[0] for c in res.description]
            d_types = {c[0]: _duck_type(c[1]) for c in res.description}
            d_rows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            failures.append(name)
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            continue
        problems = []
        if sorted(s_cols) != sorted(d_cols):
            problems.append(f"columns spark={sorted(s_cols)} duck={sorted(d_cols)}")
        else:
            bad_types = {c: (s_types[c], d_types[c]) for c in s_cols if s_types[c] != d_types[c]}
            if bad_types:
                problems.append(f"types {bad_types}")
        if len(s_rows) != len(d_rows):
            problems.append(f"rows spark={len(s_rows)} duck={len(d_rows)}")
        elif sorted(s_cols) == sorted(d_cols):
            a, b = _rows(s_cols, s_rows), _rows(d_cols, d_rows)
            if a != b:
                diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
                problems.append(f"values differ, e.g. {diff}")
        if problems:
            failures.append(name)
            print(f"FAIL {name}: " + "; ".join(problems))
        else:
            print(f"ok   {name}: {len(s_rows)} rows ({dt:.2f}s)")
    print(json.dumps({"checked": len(names), "failed": failures}))
    return 1 if failures else 0


if __name__ == "__main__":
    sys.exit(main())
