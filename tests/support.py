"""Comparison of a DataFrame with SQL run elsewhere on the same tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd


def views(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for file in os.listdir(folder):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{folder}/{file}'")
    return con


def _plain(v):
    if v is None or pd.api.types.is_scalar(v) and pd.isna(v):
        return None
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, bool) or type(v).__name__ in ("bool_", "bool"):
        return bool(v)
    if isinstance(v, (int, float)) or hasattr(v, "as_tuple") or hasattr(v, "dtype"):
        return round(float(v), 6)
    return str(v)


def rows_of(pdf) -> tuple[list[str], list[tuple]]:
    columns = sorted(pdf.columns)
    return columns, sorted((tuple(map(_plain, r)) for r in pdf[columns].astype(object).itertuples(index=False)), key=repr)


def same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    assert rows_of(df.toPandas()) == rows_of(con.execute(sql).df())
