"""Spark results against DuckDB's for the same query."""

from __future__ import annotations

import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(rows):
    def one(x):
        if isinstance(x, decimal.Decimal):
            raise AssertionError("a decimal got in")
        if isinstance(x, float):
            return round(x, 6) + 0.0
        return x.isoformat() if hasattr(x, "isoformat") else tuple(x) if isinstance(x, list) else x

    return sorted((tuple(one(x) for x in r) for r in rows), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def same(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    cur = con.execute(sql)
    theirs = [d[0] for d in cur.description]
    assert sorted(theirs) == names
    at = [theirs.index(n) for n in names]
    got, want = plain([r[n] for n in names] for r in df.collect()), plain([r[i] for i in at] for r in cur.fetchall())
    assert got == want
