"""Runs a query's SQL in DuckDB over the driver tables and compares the rows."""

from __future__ import annotations

import datetime
import decimal
from collections import Counter
from pathlib import Path

import duckdb


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else round(value, 7) + 0.0
    if isinstance(value, decimal.Decimal):
        return plain(float(value)) if value % 1 else int(value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def number(value):
    return float(value) if isinstance(value, int) and not isinstance(value, bool) else value


def expected(folder: str, sql: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    con.execute("SET threads = 4")
    for file in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(number(plain(row[i])) for i in order) for row in result.fetchall())


def actual(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(number(plain(row[n])) for n in names) for row in df.collect())
