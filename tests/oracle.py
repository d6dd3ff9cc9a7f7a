"""Runs a registered query and its DuckDB counterpart and compares rows without regard to order."""

from __future__ import annotations

import math
import os
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


def compare(spark, con, name, f, sql, sf_dir):
    df = f(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    assert sorted(rel.columns) == sorted(df.columns), (name, rel.columns, df.columns)
    want = rows(rel.columns, rel.fetchall())
    assert got == want, (name, sum(got.values()), sum(want.values()), list((got - want).items())[:3], list((want - got).items())[:3])
    return sum(got.values())
