"""Rows of a query held against SQL on the same tables, in any order, doubles to nine digits."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(d):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{d}/{t}.parquet"
        c.sql(f"create view {t} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return float(f"{float(v):.9g}")
    if isinstance(v, int):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v) if not isinstance(v, str) else v


def rows_of(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


def same(df, c, sql):
    rel = c.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    got, want = rows_of(df.columns, df.collect()), rows_of(rel.columns, rel.fetchall())
    assert got == want
