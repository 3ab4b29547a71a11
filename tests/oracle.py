"""Compares a query with its SQL over the same tables. Run as a script: python tests/oracle.py SF NAME..."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

DATA = "/root/testdata"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(x, dict):
        return tuple(_plain(v) for v in x.values())
    if isinstance(x, (list, tuple)):
        return tuple(_plain(v) for v in x)
    return x


def rows(columns: list[str], data: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(_plain(r[k]) for k in order) for r in data), key=repr)


def compare(spark, name: str, sf_dir: str, query, sql: str) -> str | None:
    """What differs, or None."""
    df = query(spark, sf_dir)
    mine = rows(df.columns, df.collect())
    result = connect(sf_dir).sql(sql)
    theirs = rows(result.columns, result.fetchall())
    if sorted(df.columns) != sorted(result.columns):
        return f"{name}: columns {sorted(df.columns)} and {sorted(result.columns)}"
    if mine != theirs:
        only = [x for x in mine if x not in set(theirs)][:3], [x for x in theirs if x not in set(mine)][:3]
        return f"{name}: {len(mine)} rows and {len(theirs)}; only here {only[0]}; only in SQL {only[1]}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    os.environ.setdefault("PYTHONPATH", sys.path[0])
    import __spark_entry__ as entry
    from conftest import session

    spark = session()
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or list(queries):
        began = time.time()
        if name in sql:
            print(name, compare(spark, name, f"{DATA}/{sys.argv[1]}", queries[name], sql[name]) or "ok", f"{time.time() - began:.1f} s", flush=True)
        else:
            print(name, queries[name](spark, f"{DATA}/{sys.argv[1]}").count(), "rows, no SQL", f"{time.time() - began:.1f} s", flush=True)
