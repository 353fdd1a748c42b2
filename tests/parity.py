"""Run registered queries against their SQL on DuckDB. ``python tests/parity.py [names...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None or v != v:
            return "~"
        if isinstance(v, bool):
            return str(int(v))
        if isinstance(v, float):
            return f"{v:.6g}" if v != int(v) or abs(v) > 1e15 else str(int(v))
        if hasattr(v, "quantize"):
            return cell(float(v))
        return str(v)

    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def compare(spark, con, name, fn, sql, sf):
    start = time.time()
    df = fn(spark, sf)
    rows = [tuple(r) for r in df.collect()]
    spent = time.time() - start
    if sql is None:
        return f"rows-only {len(rows)} rows {spent:.1f}s", True, rows
    rel = con.sql(sql)
    got, want = canonical(rows, df.columns), canonical(rel.fetchall() if hasattr(rel, "fetchall") else [], rel.columns)
    if got == want:
        return f"ok {len(rows)} rows {spent:.1f}s", True, rows
    lines = [f"MISMATCH spark={len(rows)} duckdb={len(want[1])} cols {got[0]} vs {want[0]}"]
    a, b = set(got[1]), set(want[1])
    lines += [f"   spark only: {r}" for r in sorted(a - b)[:3]] + [f"   duckdb only: {r}" for r in sorted(b - a)[:3]]
    return "\n".join(l[:700] for l in lines), False, rows


def main(names):
    from attestry.session import local_session

    import __spark_entry__ as entry

    sf = os.environ.get("PARITY_SF", "/root/testdata/sf0.01")
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        try:
            text, ok, _ = compare(spark, con, name, fn, oracles.get(name), sf)
        except Exception as error:  # report and go on with the next query
            text, ok = f"ERROR {type(error).__name__}: {str(error)[:900]}", False
        bad += not ok
        print(f"{name}: {text}", flush=True)
    print(f"{bad} failing")


if __name__ == "__main__":
    main(sys.argv[1:])
