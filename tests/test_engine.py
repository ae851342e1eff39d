"""The fold: exact cases, properties, and agreement with the closed form."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import engine
from tidewater.operators.engine import Cell, Config, Instrument, Roll, Row, Rules, State, Step, Venue, fold, load_snapshot


def cell(close, target=0, **more):
    values = {"high": close, "low": close, "volume": 1e6, "bid": close, "ask": close} | more
    return Cell(close=close, target=target, **values)


def play(rows, config, state=None):
    """Run rows of (ts, tradable, cells); all events and the final state."""
    fills, audit, ledger, curve = [], [], [], []
    for events, point, state in fold(rows, config, state):
        fills += events.fills
        audit += events.audit
        ledger += events.ledger
        curve.append(point)
    return fills, audit, ledger + (engine.finish(state) if state else []), curve, state


def one_asset(prices, targets, **more):
    return [(i + 1, True, [cell(p, t, **more)]) for i, (p, t) in enumerate(zip(prices, targets))]


def test_golden_ledger():
    _, _, ledger, curve, _ = play(one_asset([100.0, 101.0], [1, 0]), Config(slippage_model="none"))
    got = [(e["sequence"], e["type"], e["parent_order_id"], e["order_id"], e["quantity"], e["price"]) for e in ledger]
    assert got == [
        (1, "ORDER_SUBMITTED", 1, 0, 1, 0.0),
        (2, "FILL_APPLIED", 1, 1_000_000, 1, 100.0),
        (3, "ORDER_SUBMITTED", 2, 0, -1, 0.0),
        (4, "FILL_APPLIED", 2, 1_000_001, -1, 101.0),
    ]
    assert [e["cash_after"] for e in ledger] == [1e6, 1e6, 999_900.0, 999_900.0]  # cash before the fill
    assert [e["equity_after"] for e in ledger] == [0.0, 1e6, 0.0, 1_000_001.0]
    assert curve[-1]["cash"] == 1_000_001.0


def test_buys_at_the_ask():
    fills, *_ = play(one_asset([100.0], [1], bid=99.5, ask=100.5), Config(slippage_model="none", use_bid_ask_execution=True))
    assert [f["price"] for f in fills] == [100.5]


def test_split_keeps_equity():
    rows = one_asset([100.0, 100.0, 50.0], [1, 1, 1])
    rows[2] = (3, False, [Cell(50, 50, 50, 1e6, 50, 50, 1, actions=(("SPLIT", 2.0),))])
    *_, curve, state = play(rows, Config(slippage_model="none"))
    assert state.positions.tolist() == [2] and state.adjustment.tolist() == [0.5] and curve[-1]["equity"] == 1e6


def test_dividends_spinoffs_and_delisting():
    act = lambda *a: [Cell(100, 100, 100, 1e6, 100, 100, 1, actions=a)]
    rows = one_asset([100.0], [1]) + [(2, True, act(("DIVIDEND", 3.0))), (3, True, act(("SPINOFF", 2.0)))]
    *_, state = play(rows, Config(slippage_model="none"))
    assert state.cash == 1e6 - 100 + 5
    rows.append((4, False, act(("DELISTING", 0.0))))
    _, audit, *_, state = play(rows, Config(slippage_model="none"))
    assert state.positions.tolist() == [0] and state.cash == 1e6 + 5 and audit[-1]["type"] == "FILL_APPLIED"


def test_kill_switch_within_a_row():
    cells = [cell(100.0, 1, ask=300.0), cell(100.0, 1, ask=100.0)]
    config = Config(starting_cash=1000.0, slippage_model="none", use_bid_ask_execution=True, max_drawdown_pct=0.05)
    fills, audit, _, _, state = play([(1, True, cells)], config)
    assert [f["asset"] for f in fills] == [0] and state.positions.tolist() == [1, 0] and state.halted
    assert "RISK_KILL_SWITCH" in {a["type"] for a in audit}


def test_leverage_rejects_every_asset():
    cells = [cell(100.0, 1) for _ in range(100)]
    fills, audit, *_, state = play([(1, True, cells)], Config(starting_cash=1000.0, max_gross_leverage=0.1))
    assert not fills and state.rejected_orders >= 100


def test_zero_volume_waits():
    fills, audit, *_ = play(one_asset([100.0], [1], volume=0.0), Config())
    assert not fills and [a["type"] for a in audit][-1] == "ORDER_WAITING_QUEUE"


def test_cash_rejection_keeps_its_fills():
    fills, audit, _, _, state = play(one_asset([100.0], [1]), Config(starting_cash=50.0, slippage_model="none"))
    assert len(fills) == 1 and state.positions.tolist() == [0] and state.cash == 50.0 and audit[-1]["type"] == "ORDER_REJECTED_CASH"


def test_latency_child_orders_and_limits():
    config = Config(slippage_model="none", max_position=5, latency_steps=1, child_order_size=2, child_slice_delay_steps=1)
    fills, *_ = play(one_asset([10.0] * 8, [5] * 8), config)
    assert [(f["ts"], f["quantity"]) for f in fills] == [(2, 2), (4, 2), (6, 1)]
    rows = [(1, True, [Cell(10, 11, 10, 1e6, 10, 10, 1, "limit", 9.5)]), (2, True, [Cell(9, 9, 9, 1e6, 9, 9, 1, "limit", 9.5)])]
    fills, *_ = play(rows, Config(slippage_model="none"))
    assert [(f["ts"], f["price"]) for f in fills] == [(2, 9)]


def test_venues_options_rolls_margin_and_carry():
    venues = (Venue(1, taker_fee_bps=1.0, volume_share=0.5), Venue(2, maker_fee_bps=1.0, volume_share=0.5))
    fills, *_ = play(one_asset([10.0], [5]), Config(max_position=5, slippage_model="none", venues=venues))
    assert [(f["venue_id"], f["quantity"]) for f in fills] == [(1, 2), (2, 3)] and fills[0]["fee"] > 0 > fills[1]["fee"]
    option = (Instrument("option_call", 2, 90.0),)
    *_, state = play(one_asset([100.0, 120.0], [1, 0]), Config(slippage_model="none", instruments=option, latency_steps=0))
    assert state.positions.tolist() == [0] and state.cash == 1e6 - 100 + 30
    rows = [(1, True, [cell(10.0, 1), cell(20.0, 0)]), (2, False, [cell(10.0, 1), cell(20.0, 0)])]
    _, audit, *_, state = play(rows, Config(slippage_model="none", rolls=(Roll(0, 1, 2, 100.0),)))
    assert state.positions.tolist() == [0, 1] and audit[-1]["type"] == "FUTURE_ROLL" and math.isclose(state.cash, 1e6 - 10 - 0.2)
    _, audit, *_, state = play([(1, True, [cell(10.0, 1), cell(20.0, 1)])], Config(slippage_model="none", margin_limit=25.0))
    assert state.positions.tolist() == [0, 1] and audit[-1]["type"] == "MARGIN_LIQUIDATION"
    *_, state = play(one_asset([100.0, 100.0], [-1, -1]), Config(slippage_model="none", annual_borrow_bps=252.0, annual_cash_yield_bps=0.0))
    assert math.isclose(state.total_borrow_cost, 0.01)


def test_session_cancels_and_bad_data_raises():
    rows = [(1, True, [cell(10.0, 1)]), (2, False, [cell(10.0, 1)])]
    _, audit, *_ = play(rows, Config(latency_steps=5))
    assert audit[-1]["type"] == "ORDER_CANCELLED_SESSION"
    with pytest.raises(ValueError, match="non-finite"):
        play(one_asset([math.nan], [1]), Config())


@pytest.mark.parametrize("cut", [1, 30, 59])
def test_resumed_run_equals_one_run(cut):
    rng = np.random.default_rng(3)
    prices = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 60)))
    rows = one_asset(prices, rng.integers(-3, 4, 60).tolist(), volume=40.0)
    config = Config(max_position=3, commission_bps=1.0, latency_steps=1, child_order_size=1, annual_borrow_bps=50)
    *_, whole = play(rows, config)
    *_, half = play(rows[:cut], config)
    *_, resumed = play(rows[cut:], config, State.from_json(half.to_json()))
    assert (resumed.cash, resumed.positions.tolist(), resumed.equity, resumed.max_drawdown) == (whole.cash, whole.positions.tolist(), whole.equity, whole.max_drawdown)


def test_cash_is_conserved():
    rng = np.random.default_rng(5)
    rows = one_asset(50 + rng.random(200) * 10, rng.integers(-2, 3, 200).tolist())
    fills, *_, state = play(rows, Config(max_position=2, commission_bps=2.0))
    paid = sum(f["quantity"] * f["price"] + f["fee"] for f in fills)
    assert math.isclose(state.cash, 1e6 - paid, rel_tol=1e-12)


def test_rows_must_cover_all_assets():
    with pytest.raises(ValueError, match="every asset"):
        Step(State.start(2, Config()), Rules(Config(), 2), Row.of(1, True, [cell(1.0)]))


def test_a_snapshot_goes_on_and_is_on_record():
    *_, state = play(one_asset([10.0, 11.0], [1, 1]), Config(slippage_model="none"))
    resumed = load_snapshot(state.to_json(), Config(), 3)
    assert resumed.last_entry["type"] == "SNAPSHOT_LOADED" and resumed.last_entry["value"] == 2
    _, _, ledger, curve, end = play([(3, True, [cell(12.0, 0)])], Config(slippage_model="none"), resumed)
    assert ledger[0]["type"] == "SNAPSHOT_LOADED" and end.cash == 1e6 + 2 and curve[0]["row_idx"] == 2


HARD = {
    "plain": Config(max_position=3, slippage_model="none"),
    "thin": Config(max_position=3, max_participation_rate=0.02, commission_bps=1.0),
    "poor": Config(max_position=3, starting_cash=260.0, max_gross_leverage=2.0),
    "stopped": Config(max_position=3, starting_cash=2_000.0, max_drawdown_pct=0.01),
    "margin": Config(max_position=3, margin_limit=220.0, slippage_model="fixed", slippage_bps=3.0),
    "slow": Config(max_position=3, latency_steps=2, child_order_size=1, child_slice_delay_steps=1, annual_borrow_bps=90.0, annual_cash_yield_bps=10.0),
    "borrow": Config(max_position=3, annual_borrow_bps=500.0, use_bid_ask_execution=True),
    "unmarked": Config(max_position=2, mark_to_market=False, allow_short=False),
}


def market(assets=1, rows=400, seed=13):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, (rows, assets)), axis=0))
    target = np.repeat(rng.integers(-4, 5, (rows // 20 + 1, assets)), 20, axis=0)[:rows]
    volume = rng.choice([0.0, 40.0, 150.0], (rows, assets))
    actions = {(i, int(rng.integers(assets))): (("SPLIT", 2.0), ("DIVIDEND", 0.5))[i % 2] for i in rng.integers(0, rows, 6).tolist()}
    return close, target, volume, actions, rng.random(rows) > 0.1, rng.random((rows, assets)) > 0.25


@pytest.mark.parametrize("name", HARD)
def test_stretches_give_what_single_steps_give(spark, name, monkeypatch):
    """One asset: the adapter, which works calm stretches as arrays, against the plain fold of every row."""
    close, target, volume, actions, tradable, _ = market()
    monkeypatch.setattr(engine, "_SHORT", 4)
    config, rows, table = HARD[name], [], []
    for i in range(len(close)):
        c, due = float(close[i, 0]), tuple(a for (k, _), a in actions.items() if k == i)
        rows.append((i, bool(tradable[i]), [Cell(c, c, c, float(volume[i, 0]), c - 0.1, c + 0.1, int(target[i, 0]), actions=due)]))
        table.append(("R", i, c, c, c, float(volume[i, 0]), c - 0.1, c + 0.1, int(target[i, 0]), bool(tradable[i]), [{"kind": k, "amount": a} for k, a in due]))
    fills, audit, ledger, curve, _ = play(rows, config)
    df = spark.createDataFrame(table, "run string, ts bigint, close double, high double, low double, volume double, bid double, ask double, target bigint, open boolean, due array<struct<kind:string,amount:double>>")
    events = engine.backtest(engine.run_rows(df, F.col("run"), actions=F.col("due"), tradable=F.col("open")), config).toPandas()
    points = events[events.kind == "curve"].sort_values("row_idx")
    assert np.allclose(points.equity_after, [p["equity"] for p in curve], atol=1e-6) and np.allclose(points.cash_after, [p["cash"] for p in curve], atol=1e-6)
    assert points.quantity.tolist() == [p["positions"][0] for p in curve]
    for kind, want in (("fill", fills), ("audit", audit), ("ledger", ledger)):
        got = events[events.kind == kind]
        assert len(got) == len(want)
        if kind == "ledger":
            got = got.sort_values("sequence")
            assert got.type.tolist() == [e["type"] for e in want] and np.allclose(got.equity_after, [e["equity_after"] for e in want], atol=1e-6)
    assert len(audit) > 20 or name == "stopped"


@pytest.mark.parametrize("name", HARD)
def test_assets_of_a_run_share_cash_and_rules(spark, name):
    """Several assets with gaps, against the fold of full rows in which absent assets are carried with no volume and no wish to change."""
    close, target, volume, actions, tradable, here = market(3, 240, 17)
    here[:, 0] |= ~here.any(axis=1)
    config, table, rows = HARD[name], [], []
    last, wish = np.zeros(3), np.zeros(3, dtype=int)
    state, rules, curve, kinds = State.start(3, config), Rules(config, 3), [], []
    for i in range(len(close)):
        now = np.flatnonzero(here[i])
        last[now], wish[now] = close[i, now], target[i, now]
        due = tuple((a, *x) for (k, a), x in actions.items() if k == i and here[i, a])
        row = Row(i, bool(tradable[i]), *(last.copy() for _ in range(3)), np.where(here[i], volume[i], 0.0), last - 0.1 * (last > 0), last + 0.1 * (last > 0), wish.copy(), np.zeros(3, bool), np.full(3, np.nan), due, now)
        events, point = Step(state, rules, row).run()
        curve.append(point)
        kinds += [a["type"] for a in events.audit]
        for a in now.tolist():
            c = float(close[i, a])
            table.append(("R", i, a, c, c, c, float(volume[i, a]), c - 0.1, c + 0.1, int(target[i, a]), bool(tradable[i]), [{"kind": x[1], "amount": x[2]} for x in due if x[0] == a]))
    df = spark.createDataFrame(table, "run string, ts bigint, asset int, close double, high double, low double, volume double, bid double, ask double, target bigint, open boolean, due array<struct<kind:string,amount:double>>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)  # batches end within a time
    try:
        events = engine.backtest(engine.run_rows(df, F.col("run"), asset=F.col("asset"), actions=F.col("due"), tradable=F.col("open")), config, shared=True).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    points = events[events.kind == "curve"].sort_values("row_idx")
    assert np.allclose(points.equity_after, [p["equity"] for p in curve], atol=1e-6) and points.quantity.tolist() == [sum(p["positions"]) for p in curve]
    assert sorted(events[events.kind == "audit"].type) == sorted(kinds)


def test_kill_switch_in_a_shared_run_and_empty_tables(spark):
    schema = "run string, ts bigint, asset int, close double, high double, low double, volume double, bid double, ask double, target bigint"
    df = spark.createDataFrame([("R", 1, a, 100.0, 100.0, 100.0, 1e6, 100.0, ask, 1) for a, ask in ((0, 300.0), (1, 100.0))], schema)
    config = Config(starting_cash=1000.0, slippage_model="none", use_bid_ask_execution=True, max_drawdown_pct=0.05)
    events = engine.backtest(engine.run_rows(df, F.col("run"), asset=F.col("asset")), config, shared=True).toPandas()
    assert events[events.kind == "fill"].asset.tolist() == [0] and "RISK_KILL_SWITCH" in set(events.type)
    assert engine.backtest(engine.run_rows(df.limit(0), F.col("run")), config).count() == 0
    with pytest.raises(Exception, match="non-finite"):
        engine.backtest(engine.run_rows(df.withColumn("close", F.lit(float("nan"))), F.col("run")), config).count()
