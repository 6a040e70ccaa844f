"""Compares a Spark query with its SQL in DuckDB, as sets of rows."""

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(d):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    return c


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    norm = lambda v: round(v, 6) if isinstance(v, float) and not math.isnan(v) else bytes(v) if isinstance(v, (bytearray, bytes)) else v
    return sorted(cols), Counter(tuple(norm(r[i]) for i in order) for r in data)


def compare(spark, d, f, sql):
    df = f(spark, d)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck(d).execute(sql)
    want = rows([x[0] for x in cur.description], cur.fetchall())
    assert got[0] == want[0], (got[0], want[0])
    assert got[1] == want[1], (list((got[1] - want[1]).items())[:3], list((want[1] - got[1]).items())[:3])
    return sum(got[1].values())
