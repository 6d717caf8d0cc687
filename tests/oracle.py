"""Runs a query and its SQL oracle on one data folder and compares rows."""

import math
import os

import duckdb


def rows_of(df):
    names = sorted(df.columns)
    return [tuple(plain(r[c]) for c in names) for r in df.collect()], names


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        return v.replace(tzinfo=None)
    return v


def expected(sql, sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [tuple(plain(r[i]) for i in order) for r in got.fetchall()], sorted(names)


def key(row):
    return tuple((v is not None, str(type(v)), v) if v is not None else (False, "", 0) for v in row)


def compare(df, sql, sf):
    got, a = rows_of(df)
    want, b = expected(sql, sf)
    assert a == b, (a, b)
    assert len(got) == len(want), (len(got), len(want))
    for x, y in zip(sorted(got, key=lambda r: tuple(map(str, r))), sorted(want, key=lambda r: tuple(map(str, r)))):
        assert x == y, (x, y)
    return len(got)
