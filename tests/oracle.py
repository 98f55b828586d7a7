"""Compares a query with its SQL in DuckDB as multisets of rows."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        files = f"{path}/*.parquet" if path.is_dir() else path
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{files}'")
    return con


def rows(columns: list[str], values) -> Counter:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(r[i] for i in order) for r in values)


def same(df, sf_dir: str, sql: str) -> None:
    found = connect(sf_dir).sql(sql)
    assert sorted(found.columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(found.columns, found.fetchall())
