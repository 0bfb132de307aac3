"""Rows of Spark and of DuckDB in one form."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    try:
        return round(float(v), 6) if type(v).__name__ == "Decimal" else v
    except ValueError:
        return v


def order(row):
    return tuple((x is not None, str(type(x)) if not isinstance(x, (int, float)) else "", x if isinstance(x, (int, float)) else str(x)) for x in row)


def rows_of(df) -> tuple[list[str], list[tuple]]:
    """Columns by name, and sorted rows of a Spark DataFrame."""
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=order)


def sql_rows(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET threads TO 4")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        at = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{at}')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    at = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(plain(r[i]) for i in at) for r in got.fetchall()]
    con.close()
    return sorted(names), sorted(rows, key=order)
