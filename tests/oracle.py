"""Compares a query's rows with those of its SQL in another engine."""

import datetime as dt
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "-"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None).isoformat()
    try:
        return f"{float(x) + 0.0:.6f}".replace("-0.000000", "0.000000")
    except (TypeError, ValueError):
        return str(x)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in values)


def check(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    found = connection(sf_dir).execute(sql)
    want = rows([c[0] for c in found.description], found.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
