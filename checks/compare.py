"""Runs a query on Spark and its SQL on DuckDB and compares the rows, whatever their order."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from decimal import Decimal

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet')")
    return connection


def cell(value):
    """A value in the form both engines share; numbers of equal value are equal."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return float(f"{value:.12g}")
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    return value


def difference(df: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when columns and rows agree, otherwise what differs."""
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    expected_rows = result.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(set(names) ^ set(df.columns))}"
    order = sorted(names)
    expected = Counter(tuple(cell(row[names.index(c)]) for c in order) for row in expected_rows)
    actual = Counter(tuple(cell(row[c]) for c in order) for row in df.select(*[f"`{c}`" for c in order]).collect())
    if expected == actual:
        return None
    missing, extra = expected - actual, actual - expected
    lines = [f"{sum(expected.values())} rows expected, {sum(actual.values())} found, {sum(missing.values())} differ"]
    key = lambda row: tuple(str(v) for v in row)
    for want, got in list(zip(sorted(missing, key=key), sorted(extra, key=key)))[:2]:
        lines.append(str({c: (w, g) for c, w, g in zip(order, want, got) if w != g}))
    return "\n".join(lines)
