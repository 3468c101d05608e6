"""Runs queries against their DuckDB SQL: python -m tests.compare SF_DIR [NAME...]"""

from __future__ import annotations

import glob
import os
import sys
import time


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for p in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    return con


def canonical(rows, cols) -> list:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    norm = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted(([norm(r[i]) for i in order] for r in rows), key=repr)


def differs(spark, con, fn, sql: str, sf_dir: str) -> str:
    """Empty if both have the same columns and, at 6 digits, equal values."""
    df = fn(spark, sf_dir)
    got = df.collect()
    rel = con.sql(sql)
    want = rel.fetchall()
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    a, b = canonical(got, df.columns), canonical(want, rel.columns)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else ""


if __name__ == "__main__":
    sys.path.insert(0, os.getcwd())
    import __spark_entry__ as E

    from tidemark.session import build_session

    spark = build_session(master="local[8]", shuffle_partitions=8, **{"spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    sf, names = sys.argv[1], sys.argv[2:]
    con, qs, sqls, failed = duck(sf), E.queries(), E.oracle_sql(), 0
    for n in names or qs:
        t = time.time()
        try:
            out = differs(spark, con, qs[n], sqls[n], sf) if n in sqls else f"rows only: {len(qs[n](spark, sf).collect())}"
        except Exception as e:  # noqa: BLE001
            out = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        failed += bool(out) and not out.startswith("rows only")
        print(f"{n}: {out or 'same'} ({time.time() - t:.1f} s)", flush=True)
    print("failed", failed)
