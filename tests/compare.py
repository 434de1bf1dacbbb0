"""Run registered queries next to their SQL in DuckDB and compare whole results."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, (bool, int, str)):
        return v
    if isinstance(v, dict) or hasattr(v, "asDict"):
        return str(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, fn, sql, sf_dir):
    """None if equal, else a message."""
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first {sorted(names)}\n   spark {bad[0][0]}\n   sql   {bad[0][1]}"
    types = [(a, b) for g, w in zip(got, want) for a, b in zip(g, w) if a is not None and type(a) is not type(b)]
    if types:
        return f"types differ: {types[0]}"
    return None


def main():
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from barflow import session

    only = [a for a in sys.argv[1:] if not a.startswith("--")]
    sf = next((a[5:] for a in sys.argv if a.startswith("--sf=")), "0.01")
    sf_dir = f"/root/testdata/sf{sf}"
    spark = session.build("compare", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    if "--blocked" in sys.argv:
        spark.conf.set(session.SINGLE_TASK_BYTES[0], "-1")
        spark.conf.set(session.BLOCK_ROWS[0], "97")
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if only and not any(name.startswith(o) for o in only):
            continue
        start = time.time()
        try:
            if name in oracle:
                msg = compare(spark, con, fn, oracle[name], sf_dir)
            else:
                msg = None
                n = fn(spark, sf_dir).count()
                print(f"   {name}: {n} rows, no SQL")
        except Exception as exc:  # noqa: BLE001
            msg = f"{type(exc).__name__}: {str(exc)[:700]}"
        failed += msg is not None
        print(f"{'ok  ' if msg is None else 'FAIL'} {name} {time.time() - start:.2f}s {msg or ''}", flush=True)
    print(f"{failed} failed; SQL without query: {sorted(set(oracle) - set(queries))}")


if __name__ == "__main__":
    main()
