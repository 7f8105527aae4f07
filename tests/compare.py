"""Compare a Spark frame with the result of a SQL text that DuckDB runs on the same parquet files."""

from __future__ import annotations

from decimal import Decimal
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    conn = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        conn.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return conn


def _normal(value):
    if isinstance(value, Decimal):
        return format(value.normalize(), "f")
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, float):
        return repr(value)
    return str(value)


def _sorted_rows(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(_normal(row[i]) for i in order) for row in rows)


def differences(df, conn: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when columns and values agree, else a short description."""
    cursor = conn.execute(sql)
    columns = [c[0] for c in cursor.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    expected = _sorted_rows(columns, cursor.fetchall())
    actual = _sorted_rows(df.columns, df.collect())
    if expected == actual:
        return None
    extra = sorted(set(actual) - set(expected))[:3]
    lacking = sorted(set(expected) - set(actual))[:3]
    return f"{len(actual)} rows, expected {len(expected)}; extra {extra}; lacking {lacking}"
