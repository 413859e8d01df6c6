"""Compares registered queries with their SQL in DuckDB, as bags of rounded rows."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for path in sorted(glob.glob(f"{directory}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        at = f"{path}/*.parquet" if os.path.isdir(path) else path
        c.execute(f"create view {name} as select * from read_parquet('{at}')")
    return c


def value(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float)):
        x = float(x)
        if math.isnan(x):
            return None
        return float(f"{x:.9g}") + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat(" ")
    if isinstance(x, datetime.date):
        return datetime.datetime(x.year, x.month, x.day).isoformat(" ")
    if isinstance(x, (list, tuple)):
        return tuple(value(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((k, value(v)) for k, v in x.items()))
    return x


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


def same(df, sql: str, directory: str) -> str:
    """'' if both give the same rows, else what differs."""
    result = connect(directory).execute(sql)
    names = [d[0] for d in result.description]
    theirs = bag(names, result.fetchall())
    ours = bag(df.columns, df.collect())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if ours == theirs:
        return ""
    a, b = {}, {}
    for rows, into in ((ours, a), (theirs, b)):
        for r in rows:
            into[r] = into.get(r, 0) + 1
    extra = [r for r in a if a[r] > b.get(r, 0)][:3]
    missing = [r for r in b if b[r] > a.get(r, 0)][:3]
    return f"{len(ours)} rows and {len(theirs)}; only here: {extra}; only there: {missing}"
