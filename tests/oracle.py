"""Order-free comparison of a query with DuckDB on the same tables."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v) -> str:
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, (float, np.floating)) and np.isnan(v):
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (float, np.floating)):
        return str(int(v)) if float(v).is_integer() else repr(float(v))
    return str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    return sorted(tuple(map(plain, r)) for r in df[cols].itertuples(index=False))


def same(found: pd.DataFrame, wanted: pd.DataFrame) -> None:
    assert sorted(found.columns) == sorted(wanted.columns)
    a, b = rows(found), rows(wanted)
    assert len(a) == len(b)
    assert a == b, (sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3])
