"""Order-insensitive comparison of a Spark result with a DuckDB result."""

import glob
import os

import duckdb
import pandas as pd


def connection(sf_dir: str):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def tidy(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for k in df.columns:
        if df[k].dtype.kind in "fiu":
            df[k] = df[k].astype(float)
        else:
            df[k] = df[k].astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def assert_same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    a, b = tidy(got), tidy(want)
    assert list(a.columns) == list(b.columns)
    assert len(a) == len(b)
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=0, atol=2e-6)
