"""Compare catalogue queries with their DuckDB counterparts, value by value."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _key(value):
    if value is None:
        return (0, "")
    if isinstance(value, float):
        return (1, "nan") if math.isnan(value) else (2, repr(value + 0.0))
    return (3, repr(value))


def normal_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_key(r[i]) for i in order) for r in rows)


def compare(con, sql: str, df) -> str | None:
    """None when both results agree, else what differs."""
    got = df.collect()
    result = con.execute(sql)
    want_columns = [c[0] for c in result.description]
    want = result.fetchall()
    if sorted(want_columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(want_columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    a, b = normal_rows(df.columns, got), normal_rows(want_columns, want)
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(wrong)} of {len(a)} rows differ, first {wrong[0]}" if wrong else None
