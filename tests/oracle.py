"""Runs a query on Spark and its SQL on DuckDB over the same files, and compares the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def rows_of(rows: list, names: list[str]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 5) + 0.0
        if type(v).__name__ == "Decimal":
            return round(float(v), 5)
        if isinstance(v, (list, tuple)):
            return tuple(map(plain, v))
        return v

    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=lambda r: tuple((v is not None, str(type(v).__name__) * 0, str(v)) for v in r))


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, con, query, sql: str, folder: str) -> tuple[int, str]:
    """Rows of the query, and what differs ('' if nothing does)."""
    df = query(spark, folder)
    mine = rows_of([tuple(r) for r in df.collect()], df.columns)
    rel = con.sql(sql)
    other = rows_of(rel.fetchall(), rel.columns)
    if mine[0] != other[0]:
        return len(mine[1]), f"columns {mine[0]} and {other[0]}"
    if len(mine[1]) != len(other[1]):
        return len(mine[1]), f"{len(mine[1])} and {len(other[1])} rows; first {mine[1][:2]} and {other[1][:2]}"
    for a, b in zip(mine[1], other[1]):
        if a != b:
            return len(mine[1]), f"row {a} and {b}"
    return len(mine[1]), ""
