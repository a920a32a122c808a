"""Compares a query with its DuckDB form, as the driver does: columns by name, rows in any order."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return x
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float):
        return round(x, 6)
    if type(x).__name__ == "Decimal":
        return round(float(x), 6)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if hasattr(x, "isoformat"):
        return x.isoformat()
    return x


def duck(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, cur.fetchall()


def table_of(names, rows):
    by = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in by], sorted((tuple(plain(r[i]) for i in by) for r in rows), key=lambda r: tuple((x is not None, str(type(x)), x if not isinstance(x, tuple) else str(x)) for x in r))


def compare(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    a = table_of(df.columns, [tuple(r) for r in df.collect()])
    b = table_of(*duck(sql, sf_dir))
    assert a[0] == b[0], (a[0], b[0])
    assert len(a[1]) == len(b[1]), (len(a[1]), len(b[1]))
    bad = [(x, y) for x, y in zip(a[1], b[1]) if x != y]
    assert not bad, (len(bad), bad[:3])
    return len(a[1])
