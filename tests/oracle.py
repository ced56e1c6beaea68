"""Side-by-side run of registered queries and their SQL in DuckDB, in this process.

    python tests/oracle.py [folder] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, int):
        return repr(float(value)) if abs(value) < 2**53 else repr(value)
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in value.items())
    return str(value)


def rows(names: list[str], data: list[tuple]) -> tuple[list[str], Counter]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in data)


def compare(spark, con, folder: str, name: str, query, sql: str | None) -> str:
    start = time.time()
    df = query(spark, folder)
    got_names, got = rows(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if sql is None:
        return f"rows  {name}: {sum(got.values())} rows {took:.1f}s"
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    want_names, want = rows(names, cursor.fetchall())
    if got_names != want_names:
        return f"FAIL  {name}: columns {got_names} != {want_names}"
    if got != want:
        extra, lost = list((got - want).items())[:3], list((want - got).items())[:3]
        return (
            f"FAIL  {name}: {sum(got.values())} vs {sum(want.values())} rows, {sum((got - want).values())} differ\n"
            f"   columns {got_names}\n   spark {extra}\n   sql   {lost}"
        )
    return f"ok    {name}: {sum(got.values())} rows {took:.1f}s"


if __name__ == "__main__":
    import __spark_entry__ as entry

    from veritable.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = local_session(8), connect(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or queries:
        try:
            print(compare(spark, con, folder, name, queries[name], sql.get(name)), flush=True)
        except Exception as error:
            print(f"ERROR {name}: {type(error).__name__}: {str(error)[:1500]}", flush=True)
