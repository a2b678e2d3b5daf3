"""Comparing a query's rows with its SQL oracle's, without regard to order."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(x):
    if isinstance(x, (np.ndarray, list, tuple)):
        return tuple(_plain(y) for y in x)
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and np.isnan(x)):
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (float, np.floating)):
        return round(float(x), 6) + 0.0
    return int(x) if isinstance(x, (int, np.integer)) else str(x)


def rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(_plain(x) for x in r) for r in df[names].itertuples(index=False)), key=repr)
