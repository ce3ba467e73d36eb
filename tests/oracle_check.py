"""Run each registered query in Spark and its oracle SQL in DuckDB and compare.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402
from tidemark.plans.bindings import TABLES  # noqa: E402

SPARK_TO_DUCK = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "date": "DATE", "boolean": "BOOLEAN", "float": "FLOAT", "timestamp_ntz": "TIMESTAMP",
    "array<string>": "VARCHAR[]", "array<float>": "FLOAT[]", "array<double>": "DOUBLE[]",
    "array<bigint>": "BIGINT[]",
}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{norm(x)}" for k, x in sorted(v.items())) + "}"
    return repr(v)


def spark_rows(df):
    cols = sorted(df.columns)
    rows = df.select(*cols).collect()
    out = []
    for r in rows:
        d = r.asDict(recursive=True)
        out.append(tuple(norm(d[c]) for c in cols))
    return cols, sorted(out), {f.name: f.dataType.simpleString() for f in df.schema.fields}


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    data = cur.fetchall()
    order = sorted(range(len(names)), key=lambda i: names[i])
    cols = [names[i] for i in order]
    out = sorted(tuple(norm(row[i]) for i in order) for row in data)
    return cols, out, types


def compare(spark, sf_dir: str, names: list[str] | None = None, verbose: bool = True) -> dict:
    qs = E.queries()
    oracle = E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in names or list(qs):
        t0 = time.time()
        try:
            s_cols, s_rows, s_types = spark_rows(qs[name](spark, sf_dir))
        except Exception as e:  # noqa: BLE001
            results[name] = f"SPARK ERROR {type(e).__name__}: {str(e)[:300]}"
            if verbose:
                print(name, results[name], flush=True)
            continue
        ts = time.time() - t0
        if name not in oracle:
            results[name] = f"rows-only {len(s_rows)}"
            if verbose:
                print(f"{name:24s} rows-only rows={len(s_rows)} {ts:.1f}s", flush=True)
            continue
        try:
            d_cols, d_rows, d_types = duck_rows(con, oracle[name])
        except Exception as e:  # noqa: BLE001
            results[name] = f"DUCK ERROR {str(e)[:300]}"
            if verbose:
                print(name, results[name], flush=True)
            continue
        problems = []
        if s_cols != d_cols:
            problems.append(f"cols spark={s_cols} duck={d_cols}")
        else:
            for c in s_cols:
                st, dt_ = s_types.get(c), d_types.get(c)
                if SPARK_TO_DUCK.get(st, st) != dt_:
                    problems.append(f"type {c}: spark={st} duck={dt_}")
        if len(s_rows) != len(d_rows):
            problems.append(f"rows spark={len(s_rows)} duck={len(d_rows)}")
        elif s_rows != d_rows:
            diff = [(a, b) for a, b in zip(s_rows, d_rows) if a != b]
            problems.append(f"values differ in {len(diff)} rows, e.g. {diff[:2]}")
        results[name] = "OK" if not problems else "; ".join(problems)
        if verbose:
            print(f"{name:24s} rows={len(s_rows):6d} {ts:5.1f}s {results[name]}", flush=True)
    return results


if __name__ == "__main__":
    from tidemark.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = local_session(8)
    res = compare(spark, sf, names)
    bad = {k: v for k, v in res.items() if v != "OK" and not v.startswith("rows-only")}
    print(f"\n{len(res) - len(bad)}/{len(res)} ok")
    for k, v in bad.items():
        print("FAIL", k, v)
