"""Compare registered queries with their DuckDB statements on one data folder.

    python tests/compare.py [folder] [name ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from datetime import date, datetime
from decimal import Decimal

import duckdb


def duck(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.sql(f"CREATE VIEW {name} AS FROM '{path}'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ("", "")
    if isinstance(v, bool):
        return ("b", str(v))
    if isinstance(v, (int, float, Decimal)):
        return ("n", repr(float(v) + 0.0))
    if isinstance(v, datetime):
        return ("t", v.isoformat())
    if isinstance(v, date):
        return ("d", v.isoformat())
    return ("s", str(v))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql, folder):
    """Empty string if equal, else what differs."""
    df = fn(spark, folder)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.sql(sql)
    theirs = rows_of(result.columns, result.fetchall())
    if sorted(df.columns) != sorted(result.columns):
        return f"columns {sorted(df.columns)} vs {sorted(result.columns)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows vs {len(theirs)}; " + first_diff(ours, theirs)
    return "" if ours == theirs else first_diff(ours, theirs)


def first_diff(ours, theirs):
    a, b = sorted(set(ours) - set(theirs)), sorted(set(theirs) - set(ours))
    return f"{len(a)} differ, ours {a[:1]} theirs {b[:1]}"


def main():
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from __spark_entry__ import oracle_sql, queries
    from tidemark.plans import session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = session(master="local[8]", **{"spark__sql__shuffle__partitions": "8",
                                          "spark__ui__enabled": "false",
                                          "spark__ui__showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = duck(folder), oracle_sql(), 0
    wanted = sys.argv[2:] or list(sqls)
    for name in wanted:
        t = time.time()
        try:
            diff = compare(spark, con, queries()[name], sqls[name], folder)
        except Exception as e:
            diff = f"{type(e).__name__}: {str(e)[:400]}"
        bad += bool(diff)
        print(f"{'FAIL' if diff else 'ok  '} {name} {time.time() - t:.1f}s {diff[:700]}",
              flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} equal")


if __name__ == "__main__":
    main()
