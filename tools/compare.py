"""Run registered queries beside their checking SQL and compare the values.

    python tools/compare.py [--sf DIR] [name or module fragment ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from jobweave import checks, fixtures, session  # noqa: E402


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, list):
        return "|".join(map(str, v))
    return v


def canon(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir):
    con = duckdb.connect()
    con.sql("set threads=8")
    for t in fixtures.TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir, name, query, oracle):
    t0 = time.time()
    df = query(spark, sf_dir)
    got = canon(df.columns, df.collect())
    t1 = time.time()
    if oracle is None:
        return f"rows-only {len(got[1])}", t1 - t0, 0.0
    rel = con.sql(oracle)
    want = canon(rel.columns, rel.fetchall())
    t2 = time.time()
    if got[0] != want[0]:
        return f"SCHEMA {got[0]} vs {want[0]}", t1 - t0, t2 - t1
    if got[1] != want[1]:
        a, b = set(got[1]), set(want[1])
        left, right = sorted(a - b, key=repr)[:4], sorted(b - a, key=repr)[:4]
        return f"DIFF rows {len(got[1])}/{len(want[1])}\n   spark {left}\n   duck  {right}", t1 - t0, t2 - t1
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    want_types = dict(zip(rel.columns, map(str, rel.types)))
    pairs = {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER", "date": "DATE"}
    odd = {k: (v, want_types[k]) for k, v in types.items() if pairs.get(v) != want_types[k]}
    note = f" types {odd}" if odd else ""
    return f"ok {len(got[1])}{note}", t1 - t0, t2 - t1


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    reg = checks.load()
    spark = session.local_session(8)
    con = duck(args.sf)
    bad = 0
    for name, query in reg.queries.items():
        if args.names and not any(n == name or n in query.__module__.rsplit(".", 1)[-1:] for n in args.names):
            continue
        try:
            result, s, d = compare(spark, con, args.sf, name, query, reg.oracles.get(name))
        except Exception as exc:  # report and go on with the next query
            result, s, d = f"ERROR {type(exc).__name__}: {str(exc)[:1500]}", 0.0, 0.0
        bad += not result.startswith(("ok", "rows-only"))
        print(f"{name:28s} {s:6.1f}s {d:5.1f}s  {result}", flush=True)
    print("failures:", bad)
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
