"""Rows of a query against those of its SQL: names, count and values, in any order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("T00:00:00", "")
    return float(v) if hasattr(v, "as_tuple") else str(v)


def sql_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = con.execute(sql)
    return [d[0] for d in got.description], got.fetchall()


def same(df, sql: str, sf_dir: str) -> None:
    names, rows = sql_rows(sql, sf_dir)
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    order = sorted(names)
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    mine = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=key)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in rows), key=key)
    assert len(mine) == len(theirs), (len(mine), len(theirs))
    for a, b in zip(mine, theirs, strict=True):
        assert a == b, (order, a, b)
