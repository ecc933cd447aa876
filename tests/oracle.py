"""Rows of a query against the rows of its SQL in DuckDB."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        src = f"{f}/*.parquet" if os.path.isdir(f) else f
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{src}'")
    return con


def norm(v):  # noqa: ANN001, ANN201
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def rows(names: list[str], data) -> list[tuple]:  # noqa: ANN001
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def compare(df, sql: str, sf: str) -> None:  # noqa: ANN001
    got = rows(df.columns, df.collect())
    con = connect(sf)
    cur = con.execute(sql)
    want = rows(names := [d[0] for d in cur.description], cur.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(want), (len(got), len(want))
    for a, b in zip(got, want, strict=True):
        assert a == b, (a, b)
