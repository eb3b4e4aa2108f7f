"""Compares registered queries with their SQL in DuckDB."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def plain(rows, columns: list[str]) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def value(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return None
        if hasattr(x, "date") and not isinstance(x, str):
            return str(x.date())
        if isinstance(x, bool) or type(x).__name__ == "bool_":
            return float(x)
        return round(float(x), 5) + 0.0 if isinstance(x, int | float) or type(x).__name__ == "Decimal" else str(x)

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=str)


def difference(spark, query, sql: str, sf_dir: str) -> str:
    df = query(spark, sf_dir)
    mine = plain(df.collect(), df.columns)
    found = connection(sf_dir).execute(sql)
    names = [c[0] for c in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    theirs = plain(found.fetchall(), names)
    if len(mine) != len(theirs):
        return f"{len(mine)} rows against {len(theirs)}"
    for a, b in zip(mine, theirs, strict=True):
        if any(x != y and not (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-5 + 1e-6 * abs(y)) for x, y in zip(a, b, strict=True)):
            return f"{a} against {b}"
    return ""
