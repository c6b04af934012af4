"""Spark result against DuckDB result: same columns, same rows, order aside."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def difference(frame, connection: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when equal, else a short description."""
    cursor = connection.execute(sql)
    expected_columns = [column[0] for column in cursor.description]
    if sorted(frame.columns) != sorted(expected_columns):
        return f"columns {sorted(frame.columns)} != {sorted(expected_columns)}"
    order = sorted(expected_columns)
    expected = Counter(tuple(dict(zip(expected_columns, row))[c] for c in order) for row in cursor.fetchall())
    actual = Counter(tuple(row[c] for c in order) for row in frame.collect())
    if expected == actual:
        return None
    extra, lacking = list((actual - expected).items()), list((expected - actual).items())
    return f"{order}: {len(extra)} extra, {len(lacking)} lacking; e.g. {str(extra[:1])[:600]} / {str(lacking[:1])[:600]}"
