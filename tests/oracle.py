"""Side-by-side run of registered queries and their checking SQL."""

from __future__ import annotations

import math
import time
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return int(value) if value == int(value) and abs(value) < 1e15 else value
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    if hasattr(value, "asDict"):
        return _cell(list(value))
    if value.__class__.__name__ == "Decimal":
        return _cell(float(value))
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir, query, sql):
    """(ok, message, rows, spark seconds)."""
    start = time.time()
    df = query(spark, sf_dir)
    got = df.collect()
    took = time.time() - start
    if sql is None:
        return len(got) > 0, "rows only", len(got), took
    result = con.execute(sql)
    columns = [item[0] for item in result.description]
    want = result.fetchall()
    if sorted(df.columns) != sorted(columns):
        return False, f"columns {sorted(df.columns)} != {sorted(columns)}", len(got), took
    left, right = rows_of(df.columns, got), rows_of(columns, want)
    if left != right:
        extra = list((left - right).items())[:3]
        missing = list((right - left).items())[:3]
        return (
            False,
            f"{len(got)} vs {len(want)} rows {sorted(columns)}\n   spark only {extra}\n   sql only {missing}",
            len(got),
            took,
        )
    return True, "equal", len(got), took
