"""Runs a query on Spark and its SQL on DuckDB, and compares the rows as sets with counts."""

from __future__ import annotations

import datetime
import glob
import math
import os
from collections import Counter

import duckdb


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 3)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def duck(sf_dir: str):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def compare(df, sql: str, con) -> str:
    """What differs, or nothing."""
    a_names, a = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    b_names, b = rows_of([d[0] for d in cur.description], cur.fetchall())
    if a_names != b_names:
        return f"columns {a_names} {b_names}"
    return "" if a == b else f"{sum(a.values())} and {sum(b.values())} rows; only Spark {list((a - b).items())[:2]}, only DuckDB {list((b - a).items())[:2]}"
