"""Runs a registered query in Spark and its SQL in DuckDB, and compares the rows."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd


def views(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, (list, tuple, np.ndarray)):
        return [_plain(v) for v in value]
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
        return ""
    return f"{value:.9g}" if isinstance(value, (float, np.floating)) else str(value)


def rows(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)]
    return sorted(repr([_plain(v) for v in r]) for r in frame.itertuples(index=False, name=None))
