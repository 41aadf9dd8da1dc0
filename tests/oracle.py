"""Runs a query and its SQL twin over the same tables and compares rows as multisets, columns by name."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, decimal.Decimal)):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return x


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(df, sql: str, sf_dir: str) -> tuple[int, list, list]:
    """(rows, rows only in the query, rows only in the SQL)."""
    con = duck(sf_dir)
    rel = con.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(rel.columns), (names, sorted(rel.columns))
    at = [rel.columns.index(n) for n in names]
    want = Counter(tuple(canon(r[i]) for i in at) for r in rel.fetchall())
    got = Counter(tuple(canon(r[n]) for n in names) for r in df.collect())
    return sum(got.values()), list((got - want).elements()), list((want - got).elements())
