"""Comparing Spark rows with DuckDB rows."""
from __future__ import annotations

import glob
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, bool | str | bytes):
        return str(v)
    if isinstance(v, list | tuple):
        return str([plain(x) for x in v])
    try:
        return f"{float(v):.6f}"
    except (TypeError, ValueError):
        return str(v)


def rows(names: list[str], values: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(v[i]) for i in order) for v in values)


def agrees(df, con: duckdb.DuckDBPyConnection, sql: str) -> bool:
    got = df.collect()
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    return rows(df.columns, [tuple(r) for r in got]) == rows(names, want.fetchall())
