"""Compares a query with its SQL in DuckDB, as multisets of rows."""

import datetime
import decimal
import glob
import math
import os
from collections import Counter

import duckdb


def connect(d):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for p in glob.glob(d + "/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, bool):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def same(df, sql, c):
    rel = c.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    place = [rel.columns.index(n) for n in names]
    got = Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
    want = Counter(tuple(plain(r[i]) for i in place) for r in rel.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
