"""Numbering, halos, running aggregates and forward lookups against plain loops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.operators import panel, sliced


def rows(spark, n=500):
    rng = np.random.default_rng(4)
    data = [("HOT" if i % 3 else "AAA", int(t), None if i % 5 == 0 else float(i % 17)) for i, t in enumerate(rng.permutation(n))]
    return spark.createDataFrame(data, "symbol string, ts bigint, v double").withColumn("bucket", F.floor(F.col("ts") / 60)).repartition(4)


def test_numbers_and_halo(spark, monkeypatch):
    monkeypatch.setattr(sliced, "SLICE_ROWS", 50)
    out = sliced.numbered(rows(spark), "symbol", "bucket", "ts")
    d = out.orderBy("symbol", "ts").toPandas()
    assert (d.groupby("symbol").cumcount() == d.row_idx).all()
    haloed = sliced.with_halo(out, 7)
    w = sliced.by_slice().rowsBetween(-6, 0)
    got = sliced.own_rows(haloed.withColumn("m", F.max("ts").over(w)).withColumn("k", F.count("ts").over(w))).orderBy("symbol", "ts").toPandas()
    assert len(got) == 500 and (got.k == np.minimum(got.row_idx + 1, 7)).all() and (got.m == got.ts).all()
    with pytest.raises(ValueError):
        sliced.with_halo(out, 50)


def test_running_aggregates(spark):
    out = sliced.running(rows(spark), ("symbol",), "bucket", ("ts",), {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("v"))})
    for _, g in out.toPandas().sort_values("ts").groupby("symbol"):
        assert np.allclose(g.s, g.v.cumsum().ffill(), equal_nan=True) and np.allclose(g.m, g.v.cummax().ffill(), equal_nan=True)
        assert np.allclose(g.l, g.v.ffill(), equal_nan=True)
    assert set(out.columns) == {"symbol", "ts", "v", "bucket", "s", "m", "l"}


def test_forward_lookup(spark):
    rng = np.random.default_rng(5)
    week = panel.BUCKET_SECONDS
    right = [("A", int(t), float(t)) for t in rng.integers(0, 20 * week, 40)] + [("B", 3, 1.0)]
    left = [(i, str(k), int(t)) for i, (k, t) in enumerate(zip(rng.choice(["A", "B", "C"], 200), rng.integers(0, 25 * week, 200)))] + [(900, None, 5), (901, "A", None), (902, "A", right[0][1]), (902, "A", right[0][1])]
    got = panel.as_of_forward(spark.createDataFrame(left, "id bigint, symbol string, at bigint"), spark.createDataFrame(right, "symbol string, ts bigint, v double"), "symbol", "at", "ts", "v").toPandas()
    assert len(got) == len(left)
    by_key = {k: sorted(t for s, t, _ in right if s == k) for k in "ABC"}
    for r in got.itertuples():
        times = by_key.get(r.symbol, []) if r.at == r.at else []
        want = next((t for t in times if t >= r.at), times[-1] if times else None)
        assert (pd.isna(r.row_ts) and want is None) or r.row_ts == want
