"""Side-by-side comparison of a Spark result and a DuckDB result."""

from __future__ import annotations

import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return value + 0.0
    return value


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    out.sort(key=lambda r: tuple((v is None, type(v).__name__, str(v)) for v in r))
    return [columns[i] for i in order], out


def close(a, b):
    if isinstance(a, float) and isinstance(b, (float, int)):
        return a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b and type(a) is type(b)


def compare(con, sql: str, df) -> str | None:
    """None if equal, else what differs."""
    got_columns, got = normal(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want_columns, want = normal(names, cursor.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if not all(close(a, b) for a, b in zip(g, w))]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first: {bad[0][0]} != {bad[0][1]} in {got_columns}"
    return None
