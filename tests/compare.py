"""Spark results against DuckDB's, as multisets of rows with nine significant digits."""

import math
import os
from collections import Counter

import duckdb
import pandas as pd


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return None
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, bool) or isinstance(x, str):
        return x
    if isinstance(x, (int, float)):
        return f"{float(x):.9g}"
    return str(x)


def rows_of(df: pd.DataFrame) -> Counter:
    df = df.reindex(sorted(df.columns), axis=1)
    return Counter(tuple(None if v is None else plain(v) for v in r) for r in df.astype(object).itertuples(index=False))


def duck(sf: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{sf}/{f}{'/*' if os.path.isdir(f'{sf}/{f}') else ''}')")
    return con
