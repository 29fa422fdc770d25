"""Holds a registered query against its SQL on the same tables."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pandas as pd

SMALL = "/root/testdata/sf0.001"


def value(v):
    if hasattr(v, "tolist") and getattr(v, "ndim", 0):
        return tuple(v.tolist())
    if v is None or v is pd.NA or v != v:
        return None
    return int(v) if isinstance(v, (float, np.floating)) and abs(v) < 2**53 and v == int(v) else v


def rows(pdf):
    return sorted(repr([value(v) for v in r]) for r in pdf[sorted(pdf.columns)].astype(object).itertuples(index=False, name=None))


def by_sql(sql: str, sf_dir: str = SMALL):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con.execute(sql).df()


def assert_equal(df, sql: str, sf_dir: str = SMALL) -> None:
    got, want = df.toPandas(), by_sql(sql, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
