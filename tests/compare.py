"""Run registered queries against their SQL in DuckDB: `python tests/compare.py [sf] [name ...]`."""

from __future__ import annotations

import sys
import time
from datetime import date
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem".split()


def connect(folder: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def canonical(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None:
            return ("", "")
        if isinstance(v, bool):
            return ("b", str(v))
        if isinstance(v, float):
            return ("f", repr(round(v, 6) + 0.0))
        if isinstance(v, int):
            return ("i", str(v))
        return ("d" if isinstance(v, date) else "s", str(v))

    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def compare(spark, con, name: str, query, sql: str, folder: str) -> str | None:
    """None if both results agree, else the first difference."""
    df = query(spark, folder)
    mine = df.collect()
    theirs = con.execute(sql)
    names = [c[0] for c in theirs.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = canonical(df.columns, mine), canonical(names, theirs.fetchall())
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return f"{x} != {y}"
    return None


if __name__ == "__main__":
    from conftest import session

    import __spark_entry__ as spark_entry

    folder = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.001'}"
    spark, con = session(), connect(folder)
    all_queries, oracle = spark_entry.queries(), spark_entry.oracle_sql()
    for name in sys.argv[2:] or all_queries:
        start = time.time()
        try:
            if name in oracle:
                difference = compare(spark, con, name, all_queries[name], oracle[name], folder)
                result = "ok" if difference is None else f"DIFF {difference}"
            else:
                result = f"rows {all_queries[name](spark, folder).count()} (no SQL)"
        except Exception as error:
            result = f"ERROR {type(error).__name__} {str(error)[:400]}"
        print(f"{name:32s} {time.time() - start:6.2f}s {result}", flush=True)
