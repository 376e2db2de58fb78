"""A query's rows beside those of its SQL, with columns by name and floats to nine digits."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else 0.0 if x == 0 else float(f"{x:.9g}")
    if isinstance(x, Decimal):
        return plain(float(x))
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    return x.hex() if isinstance(x, (bytes, bytearray)) else x


def rows(names: list[str], found: list[tuple]) -> list[str]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(plain(row[i]) for i in order)) for row in found)


def duck(sql: str, folder: str) -> tuple[list[str], list[str]]:
    db = duckdb.connect()
    for file in sorted(Path(folder).glob("*.parquet")):
        at = f"{file}/*.parquet" if file.is_dir() else str(file)
        db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{at}')")
    found = db.execute(sql)
    names = [c[0] for c in found.description]
    return sorted(names), rows(names, found.fetchall())


def spark_rows(df) -> tuple[list[str], list[str]]:
    return sorted(df.columns), rows(df.columns, [tuple(r) for r in df.collect()])
