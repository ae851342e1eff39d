"""Runs by the fold and in closed form agree; policies by name; sweeps and walk-forward validation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import runs, signals, simulation, sliced
from tidewater.operators.engine import Config
from tidewater.operators.simulation import Simulation, closed_form_fits, hot_symbols
from tidewater.plans.planner import run_policy

PANEL = "symbol string, row_idx bigint, ts bigint, close double, high double, low double, volume double, bid double, ask double"
PLAIN = Config(slippage_model="fixed", slippage_bps=1.0, commission_bps=1.0, max_position=2)
COMBOS = [(0, "moving_average_crossover", {"fast": 2, "slow": 5}), (1, "moving_average_crossover", {"fast": 3, "slow": 8}), (2, "momentum", {"lookback": 4})]


def panel(spark, volume=(1e6, 1e6, 4.0), rows=80):
    rng = np.random.default_rng(21)
    out = []
    for symbol, v in zip(("AAA", "BBB", "CCC"), volume):
        close = 20 * np.exp(np.cumsum(rng.normal(0, 0.02, rows)))
        out += [(symbol, i, i * 3_600, float(p), float(p), float(p), v, float(p), float(p)) for i, p in enumerate(close)]
    return spark.createDataFrame(out, PANEL)


@pytest.mark.parametrize("slice_rows", [100_000, 23])
def test_long_runs_in_closed_form_are_those_of_the_fold(spark, monkeypatch, slice_rows):
    """AAA and BBB are hot; the thin CCC, hot as well, fails the guard and is folded."""
    monkeypatch.setattr(sliced, "SLICE_ROWS", slice_rows)
    bars = panel(spark)
    monkeypatch.setattr(simulation, "HOT_ROWS", 40)
    hot = hot_symbols(bars)
    assert hot.count() == 3 and closed_form_fits(PLAIN) and not closed_form_fits(Config(latency_steps=1))
    monkeypatch.setattr(simulation, "HOT_ROWS", 1_000)
    assert hot_symbols(bars) is None
    targets = signals.momentum(bars, 3, 2).withColumn("mark", F.col("row_idx") * 1.0)
    some = hot.where("symbol != 'BBB'")
    one, two = Simulation(targets, PLAIN, extra="mark"), Simulation(targets, PLAIN, hot=some, extra="mark")
    a, b = (x.path.orderBy("symbol", "row_idx").toPandas() for x in (one, two))
    assert len(a) == 240 and (a.position == b.position).all() and (a.trade == b.trade).all() and (a.row_fills == b.row_fills).all()
    for c in ("cash", "equity", "drawdown", "traded", "close"):
        assert np.allclose(a[c], b[c], atol=1e-6)
    fa, fb = (x.fills.orderBy("symbol", "order_id").toPandas() for x in (one, two))
    assert len(fa) > 20 and fa[["symbol", "ts", "row_idx", "parent_order_id", "order_id", "quantity", "arrival_ts"]].equals(fb[["symbol", "ts", "row_idx", "parent_order_id", "order_id", "quantity", "arrival_ts"]])
    assert np.allclose(fa[["price", "fee", "arrival_price", "mark"]], fb[["price", "fee", "arrival_price", "mark"]]) and (fa.mark == fa.row_idx).all()
    la, lb = (x.ledger.orderBy("symbol", "sequence").toPandas() for x in (one, two))
    assert la.type.tolist() == lb.type.tolist() and np.allclose(la[["cash_after", "equity_after"]], lb[["cash_after", "equity_after"]], atol=1e-6)
    assert "ORDER_CANCELLED_REPLACE" in set(la[la.symbol == "CCC"].type)


def test_policies_run_by_name(spark):
    bars = panel(spark)
    assert run_policy(bars, "momentum", PLAIN, lookback=3, max_position=2).count() == 240
    crossed = run_policy(bars, "cross_sectional_momentum", PLAIN, lookback=3, winners=1, losers=1)
    assert crossed.where("position != 0").count() > 100


def test_a_sweep_takes_any_policy(spark):
    bars, combos = panel(spark), [*COMBOS, (3, "cross_sectional_momentum", {"lookback": 3, "winners": 1, "losers": 1}), (4, "volatility_filtered_momentum", {"lookback": 3, "window": 4, "ceiling": 0.02})]
    got = runs.sweep(bars, combos, PLAIN).toPandas().set_index(["combo_idx", "symbol"]).sort_index()
    assert len(got) == 15 and set(got.columns) >= {"sharpe", "sortino", "cagr", "max_drawdown", "calmar", "turnover_per_year", "fill_count", "pnl"}
    for i, name, params in combos:
        alone = run_policy(bars, name, PLAIN, **params).groupBy("symbol").agg(F.sum("row_fills").alias("n"), F.max_by("equity", "row_idx").alias("e")).toPandas().set_index("symbol").sort_index()
        assert (got.loc[i].fill_count == alone.n).all() and np.allclose(got.loc[i].pnl, alone.e - 1e6, atol=1e-6)
    assert runs.top_k(runs.sweep(bars, COMBOS, PLAIN), 2).count() == 6


def test_walk_forward_runs_every_part_anew(spark):
    """Each fold's figures are those of a sweep over its own rows alone."""
    rng = np.random.default_rng(4)
    row = lambda s, i, c: (s, i, i * 43_200, float(c), float(c), float(c), 1e6, float(c), float(c))
    long = [row("LONG", i, c) for i, c in enumerate(100 * np.exp(np.cumsum(rng.normal(0, 0.02, 150))))]
    thin = [row("THIN", i, c) for i, c in enumerate(100 * np.exp(np.cumsum(rng.normal(0, 0.02, 60))))]
    bars = spark.createDataFrame(long + thin, PANEL)
    folds, curve = (d.toPandas() for d in runs.walk_forward_folds(bars, COMBOS, PLAIN))
    assert len(folds) == 6 and len(curve) == sum(folds.test_end - folds.test_start)
    of_long = folds[folds.symbol == "LONG"].set_index("fold")
    span = of_long.loc[1]
    alone = lambda a, b: spark.createDataFrame([(s, i - a, *rest) for s, i, *rest in long[a:b]], PANEL)
    trained, tested = (runs.sweep(alone(int(a), int(b)), COMBOS, PLAIN).toPandas().set_index("combo_idx") for a, b in ((span.train_start, span.train_end), (span.test_start, span.test_end)))
    won = trained.sharpe.idxmax()
    assert span.combo_idx == won and np.isclose(span.is_sharpe, trained.sharpe[won]) and np.isclose(span.oos_sharpe, tested.sharpe[won])
    assert np.isclose(span.is_max_drawdown, trained.max_drawdown[won]) and np.isclose(span.oos_max_drawdown, tested.max_drawdown[won])
    assert np.allclose(of_long.efficiency, of_long.oos_sharpe.mean() / of_long.is_sharpe.mean())
    flat = runs.walk_forward_folds(bars.where("symbol = 'THIN'"), COMBOS[1:2], PLAIN)[0].toPandas()
    assert (flat.oos_sharpe == 0).all()  # six test rows are fewer than the slow average needs
    kept = runs.walk_forward_folds(bars, COMBOS, PLAIN, anchored=True, stride=2, shortlist=1)[0].toPandas()
    assert len(kept) == 6 and (kept.train_start == 0).all()
    split = runs.sweep_out_of_sample(bars, COMBOS, PLAIN, 0.7).toPandas()
    assert len(split) == 6 and (split.overfit_warning == ((split.oos_sharpe > 0) & (split.sharpe > 2 * split.oos_sharpe))).all()
