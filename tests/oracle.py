"""Compare a Spark result with DuckDB SQL over the same files."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(folder: str):
    db = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return db


def canonical(value) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return f"{float(value):.6g}" if abs(float(value)) > 1e9 else f"{float(value):.5f}"
    return str(value)


def rows(columns: list[str], data: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in data)


def same(df, folder: str, sql: str) -> None:
    with connect(folder) as db:
        want = db.sql(sql)
        names, data = want.columns, want.fetchall()
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, data)
