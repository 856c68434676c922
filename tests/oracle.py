"""Holds a query's rows against DuckDB's, whatever their order."""

from __future__ import annotations

import decimal
import math
import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(value(r[c]) for c in cols) for r in df.collect())


def duck(sql, sf_dir=DATA):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    c = con.execute(sql)
    names = [d[0] for d in c.description]
    at = [names.index(n) for n in sorted(names)]
    return sorted(names), sorted(tuple(value(r[i]) for i in at) for r in c.fetchall())


def same(df, sql, sf_dir=DATA):
    assert rows_of(df) == duck(sql, sf_dir)
