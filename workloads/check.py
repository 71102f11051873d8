"""Compare registered queries with their SQL on DuckDB:  python -m workloads.check SF_DIR [name ...]"""

from __future__ import annotations

import sys
import time
import traceback
from decimal import Decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if v is None:
        return "\0"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, Decimal):
        return str(int(v)) if v == v.to_integral_value() else str(v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf: str, fn, sql: str | None):
    """(rows, problem or None, seconds on Spark)"""
    start = time.time()
    df = fn(spark, sf)
    rows = df.collect()
    spent = time.time() - start
    got_cols, got = rows_of(df.columns, rows)
    if sql is None:
        return len(got), None, spent
    res = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in res.description], res.fetchall())
    if got_cols != want_cols:
        return len(got), f"columns {got_cols} expected {want_cols}", spent
    if got != want:
        a, b = set(got), set(want)
        return len(got), (f"rows {len(got)} expected {len(want)}; only here {sorted(a - b)[:2]}; "
                          f"only expected {sorted(b - a)[:2]}"), spent
    return len(got), None, spent


def main():
    from pyspark.sql import SparkSession
    from .queries import load
    queries, sql = load()
    sf, names = sys.argv[1], sys.argv[2:] or list(queries)
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(sf), 0
    for name in names:
        start = time.time()
        try:
            n, problem, spent = compare(spark, con, sf, queries[name], sql.get(name))
        except Exception as e:
            spent, n, problem = 0, 0, "".join(traceback.format_exception_only(e))[:1500]
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} rows={n} sql={'yes' if name in sql else 'no'} "
              f"spark {spent:.1f}s all {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} fine")
    sys.exit(bad > 0)


if __name__ == "__main__":
    main()
