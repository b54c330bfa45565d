"""Run a registered query and its SQL side by side."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata"


def connect(folder: str):
    con = duckdb.connect()
    for name in os.listdir(folder):
        table = name.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{name}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]

    def plain(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, float) and math.isnan(v):
            return "nan"
        return v

    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return names, sorted(out, key=lambda r: tuple(
        (x is None, f"{x:.4f}" if isinstance(x, float) else str(x)) for x in r
    ))


def compare(spark_result, sql_result) -> str:
    (n1, r1), (n2, r2) = spark_result, sql_result
    if n1 != n2:
        return f"columns {n1} != {n2}"
    if len(r1) != len(r2):
        return f"rows {len(r1)} != {len(r2)}"
    soft = 0
    for a, b in zip(r1, r2):
        for n, x, y in zip(n1, a, b):
            if x == y and isinstance(x, (int, bool)) == isinstance(y, (int, bool)):
                continue
            if isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9):
                soft += 1
                continue
            return f"{n}: {x!r} != {y!r} in {a} / {b}"
    return f"ok ({soft} soft)" if soft else "ok"


def run_spark(spark, plan, folder):
    df = plan(spark, folder)
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def run_sql(con, sql):
    cur = con.execute(sql)
    return rows_of([d[0] for d in cur.description], cur.fetchall())


def main(names, scale="sf0.01"):
    from declara.session import local_session
    import __spark_entry__ as entry

    folder = f"{DATA}/{scale}"
    spark = local_session()
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in queries:
        if names and not any(n == name or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            got = run_spark(spark, queries[name], folder)
            took = time.time() - start
            start = time.time()
            verdict = compare(got, run_sql(con, oracles[name])) if name in oracles else f"rows only {len(got[1])}"
            verdict += "" if got[1] else " EMPTY"
        except Exception as e:  # noqa: BLE001 - a report line per query
            took, verdict = time.time() - start, f"ERROR {type(e).__name__}: {str(e)[:600]}"
        bad += not verdict.startswith(("ok", "rows only"))
        flag = "" if verdict.startswith(("ok", "rows only")) else "  <<<<"
        print(f"{name:32s} {took:6.2f}s  sql {time.time() - start:5.2f}s  n={len(got[1]) if 'got' in dir() else '?'} {verdict}{flag}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    scale = "sf0.01"
    args = sys.argv[1:]
    if args and args[0].startswith("sf"):
        scale = args.pop(0)
    main(args, scale)
