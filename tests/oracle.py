"""Holding a query's rows against those of its SQL."""

import os

import duckdb
import pandas as pd


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in sorted(os.listdir(sf_dir)):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind in "iuf":
            df[c] = pd.to_numeric(df[c]).astype("float64")
        elif df[c].dtype.kind != "b":
            df[c] = df[c].map(lambda x: None if x is None or x is pd.NA else str(x))
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


def assert_same(spark_df, con, sql: str) -> None:
    got, want = normal(spark_df.toPandas()), normal(con.execute(sql).df())
    assert list(got.columns) == list(want.columns)
    pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=2e-6, rtol=1e-9)
