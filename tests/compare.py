"""Hold a query's rows against its SQL in DuckDB."""

from __future__ import annotations

import datetime
import math
import os

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "null" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    return "null" if v is None else str(v)


def rows(columns, data) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


def mismatch(df, con, sql: str) -> str | None:
    """None if equal; else what differs."""
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    theirs = rows(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} / {sorted(rel.columns)}"
    kind = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}
    types = dict(zip(rel.columns, map(str, rel.types), strict=True))
    for c, t in df.dtypes:
        if kind.get(t, types[c]) != types[c]:
            return f"type of {c}: {t} / {types[c]}"
    if ours != theirs:
        a, b = [x for x in ours if x not in set(theirs)][:3], [x for x in theirs if x not in set(ours)][:3]
        return f"{len(ours)} / {len(theirs)} rows; only ours {a}; only SQL {b}"
    return None
