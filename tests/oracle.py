"""Comparison of a query with its SQL counterpart, whatever the order of rows and columns."""

from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    return plain(float(x)) if type(x).__name__ == "Decimal" else x


def compare(df, con, sql):
    names = sorted(df.columns)
    ours = Counter(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    at = [columns.index(c) for c in names]
    theirs = Counter(repr(tuple(plain(r[i]) for i in at)) for r in found.fetchall())
    assert ours == theirs, (list((ours - theirs))[:3], list((theirs - ours))[:3])
