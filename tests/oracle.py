"""Compare a Spark result with SQL run by DuckDB on the same tables."""

from __future__ import annotations

import math
from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "smallint": "SMALLINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "timestamp_ntz": "TIMESTAMP",
    "date": "DATE",
    "boolean": "BOOLEAN",
}


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads = 4")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _cell(value):
    if value is None:
        return ("null",)
    if isinstance(value, float):
        return ("number", "nan" if math.isnan(value) else f"{value:.9g}")
    if isinstance(value, (int, Decimal)) and not isinstance(value, bool):
        return ("number", f"{value:.9g}" if isinstance(value, Decimal) else f"{float(value):.9g}")
    if isinstance(value, (datetime, date)):
        return ("time", value.isoformat())
    return ("text", str(value))


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> list[str]:
    """Differences between a frame and a SQL result; empty if they agree."""
    got = con.execute(sql)
    want_columns = [d[0] for d in got.description]
    want_types = {d[0]: str(d[1]) for d in got.description}
    want = got.fetchall()
    have = [tuple(r) for r in df.collect()]
    problems = []
    if sorted(df.columns) != sorted(want_columns):
        return [f"columns {sorted(df.columns)} != {sorted(want_columns)}"]
    for name, kind in df.dtypes:
        expected = TYPES.get(kind, kind.upper().replace(",", ","))
        if expected != want_types[name]:
            problems.append(f"type of {name}: {kind} != {want_types[name]}")
    if len(have) != len(want):
        problems.append(f"rows {len(have)} != {len(want)}")
    a, b = _rows(df.columns, have), _rows(want_columns, want)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
        problems.append(f"values differ: {diff}")
    return problems
