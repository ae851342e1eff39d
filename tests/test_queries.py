"""Every registered query at the smallest scale, against its SQL in DuckDB where it has one."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidewater.plans import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracles()


@pytest.fixture(scope="module")
def duck(small_root):
    con = duckdb.connect()
    for path in glob.glob(f"{small_root}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def comparable(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object or str(df[c].dtype) in ("bool", "boolean", "str"):
            df[c] = df[c].map(lambda x: "~" if x is None or x is pd.NA or (isinstance(x, float) and np.isnan(x)) else str(x))
        else:
            df[c] = df[c].astype(float).fillna(-1e300) + 0.0
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, small_root, name):
    got, want = comparable(QUERIES[name](spark, small_root).toPandas()), comparable(duck.execute(ORACLES[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, check_exact=False, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, small_root, name):
    df = QUERIES[name](spark, small_root)
    assert len(df.columns) >= 2 and df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


SLICED = ("ma_crossover", "vol_filtered_momentum", "tca_volatility", "xs_momentum", "intent_ffill", "frictionless_backtest", "equity_frame", "ledger_replay", "trade_stats", "walk_forward", "param_sweep")


@pytest.mark.parametrize("name", SLICED)
def test_series_cut_into_slices_give_the_same(spark, duck, small_root, name, monkeypatch):
    from tidewater.operators import signals, sliced

    monkeypatch.setattr(sliced, "SLICE_ROWS", 41)
    monkeypatch.setattr(signals, "SLICE_ROWS", 41)
    got, want = comparable(QUERIES[name](spark, small_root).toPandas()), comparable(duck.execute(ORACLES[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, check_exact=False, rtol=1e-9, atol=1e-9)
