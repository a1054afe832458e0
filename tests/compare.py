"""Runs registered queries against their SQL twins."""

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def differences(spark, con, name, f, sql, sf_dir):
    df = f(spark, sf_dir)
    left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = con.sql(sql)
    right = rows_of(found.columns, found.fetchall())
    if left[0] != right[0]:
        return f"{name}: columns {left[0]} and {right[0]}"
    if left[1] != right[1]:
        a, b = [r for r in left[1] if r not in right[1]][:3], [r for r in right[1] if r not in left[1]][:3]
        return f"{name}: {len(left[1])} and {len(right[1])} rows; only here {a}; only in SQL {b}"
    return None if left[1] else f"{name}: no rows"
