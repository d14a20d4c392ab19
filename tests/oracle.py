"""Runs a query and its SQL over the same tables and says where they differ."""

import datetime
import decimal
import math
import os

import duckdb


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return str(v) if isinstance(v, (datetime.date, datetime.datetime)) else v


def connect(folder):
    c = duckdb.connect()
    for name in os.listdir(folder):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{folder}/{name}'")
    return c


def difference(spark, folder, query, sql, connection=None):
    """(rows only here, rows only there), compared as multisets by column name."""
    df = query(spark, folder)
    cursor = (connection or connect(folder)).execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(names)
    assert order == sorted(df.columns), (order, sorted(df.columns))
    here = sorted((tuple(_plain(r[k]) for k in order) for r in df.collect()), key=repr)
    there = sorted((tuple(_plain(dict(zip(names, r))[k]) for k in order) for r in cursor.fetchall()), key=repr)
    if here == there:
        return [], []
    return [x for x in here if x not in there][:5] or here[:5], [x for x in there if x not in here][:5] or there[:5]
