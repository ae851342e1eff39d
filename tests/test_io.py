"""Files in and out, strategies, reports, and small operators on awkward rows."""

import json

import pytest
from pyspark.sql import functions as F

from tidewater.functions import execution as ex
from tidewater.functions.strategy import OrderIntent, Strategy, load_strategy, run_strategy, strategy_targets
from tidewater.operators import analytics, costs, engine, panel, runs, signals
from tidewater.operators.engine import Config
from tidewater.operators.panel import PanelError
from tidewater.sources import files, sinks

BARS = "src_order bigint, ts bigint, symbol string, close double, high double, low double, volume double, bid double, ask double"


def test_long_csv_last_row_wins_and_gaps_show(spark, tmp_path):
    (tmp_path / "bars.csv").write_text("timestamp,symbol,close,high,low,volume,bid\n1,B,10,11,9,100,\n1,A,5,6,4,50,4.9\n2,A,6,7,5,60,\n1,A,5.5,6,4,70,\n")
    rows = {(r["ts"], r["symbol"]): r for r in files.read_bars_csv(spark, str(tmp_path / "bars.csv")).collect()}
    assert set(rows) == {(1, "A"), (1, "B"), (2, "A"), (2, "B")}
    assert rows[1, "A"]["close"] == 5.5 and rows[1, "A"]["bid"] == 5.5 and rows[2, "B"]["close"] is None and rows[2, "B"]["volume"] == 0
    (tmp_path / "bad.csv").write_text("timestamp,symbol,close\n1,A,2\n")
    with pytest.raises(PanelError, match="high"):
        files.read_bars_csv(spark, str(tmp_path / "bad.csv"))


def test_folder_parquet_actions_and_cost_files(spark, tmp_path):
    for name, close in (("AAA", 10), ("BBB", 20)):
        (tmp_path / "bars").mkdir(exist_ok=True)
        (tmp_path / "bars" / f"{name}.csv").write_text(f"timestamp,close,high,low,volume\n1,{close},11,9,100\n")
    assert {(r["symbol"], r["close"]) for r in files.read_bars_directory(spark, str(tmp_path / "bars")).collect()} == {("AAA", 10.0), ("BBB", 20.0)}
    spark.createDataFrame([(1, "A", 2.0, 3.0, 1.0, 9.0)], "timestamp bigint, symbol string, close double, high double, low double, volume double").write.parquet(str(tmp_path / "p"))
    assert files.read_bars_parquet(spark, str(tmp_path / "p")).first()["ask"] == 2.0
    (tmp_path / "a.csv").write_text("symbol,ex_date,action_type,value\nAAA,1970-01-02,split,2\nAAA,1970-01-03,what,1\nZZZ,1970-01-03,SPLIT,1\n")
    actions = files.read_actions_csv(spark, str(tmp_path / "a.csv"), spark.createDataFrame([(0, "AAA")], "asset bigint, symbol string")).collect()
    assert [(a["ex_date_timestamp"], a["action_type"], a["ratio_or_amount"]) for a in actions] == [(86_400, "SPLIT", 2.0)]
    (tmp_path / "c.csv").write_text("arrival_mid,fill_price,side,participation,quoted_spread_bps\n100,100.1,1,0.1,2\n100,99.9,-1,0.1,2\n100,100.3,1,0.2,2\n")
    fit = costs.calibrate(files.read_cost_samples_csv(spark, str(tmp_path / "c.csv"))).first()
    assert abs(fit["spread_bps"] - 2.0) < 1e-12 and fit["impact"] > 0
    assert costs.calibrate(files.read_cost_samples_csv(spark, str(tmp_path / "c.csv")).where("participation = 0.1")).first()["fixed_bps"] > 0
    raw = spark.createDataFrame([("A", 1, 10.0, 5.0), ("A", 2, 0.0, 5.0), ("A", 3, 10.0, None)], "symbol string, ts bigint, close double, adj_close double")
    assert [r["adjustment"] for r in files.adjusted_closes(raw).orderBy("ts").collect()] == [0.5, 1.0, 1.0]
    with pytest.raises(NotImplementedError):
        files.UnavailableFeed("a broker").next_tick(1.0)


def test_ledger_snapshot_and_report_round_trips(spark, tmp_path):
    ledger = spark.createDataFrame([(2, 5, "FILL_APPLIED"), (1, 5, "ORDER_SUBMITTED")], "sequence bigint, ts bigint, type string")
    sinks.write_ledger_csv(ledger, str(tmp_path / "l"))
    assert [r["type"] for r in files.read_ledger_csv(spark, str(tmp_path / "l")).orderBy("sequence").collect()] == ["ORDER_SUBMITTED", "FILL_APPLIED"]
    sinks.write_ledger_csv(ledger.limit(0), str(tmp_path / "e"))
    assert any("sequence,ts,type" in p.read_text() for p in (tmp_path / "e").glob("*.csv"))
    sinks.write_jsonl(ledger, str(tmp_path / "j"), "sequence")
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    state = engine.State.start(2, engine.Config())
    state.pending[1] = engine.Order(1, 2, 2, None, "market", 3)
    sinks.save_snapshot(state, str(tmp_path / "s.json"))
    assert sinks.load_snapshot(str(tmp_path / "s.json")).to_json() == state.to_json()
    content = {"summary": [{"symbol": "A", "pnl": 1.5}], "assets": [], "events": {"FILL_APPLIED": 2}}
    sinks.write_report_json(content, str(tmp_path / "r.json"))
    sinks.write_report_markdown(content, str(tmp_path / "r.md"))
    assert json.loads((tmp_path / "r.json").read_text())["events"]["FILL_APPLIED"] == 2 and "| A | 1.5 |" in (tmp_path / "r.md").read_text()
    samples = []
    with sinks.timed(samples, "load", rows=3):
        pass
    with pytest.raises(KeyError), sinks.timed(samples, "fail"):
        raise KeyError
    log = sinks.latency_samples(spark, samples, "test", 1)
    sinks.write_jsonl(log, str(tmp_path / "log"))
    assert {r["stage"]: r["n"] for r in analytics.latency_summary(log).collect()} == {"load": 1, "fail": 1}


CROSS = [(0, "moving_average_crossover", {"fast": 2, "slow": 3})]


class Alternate(Strategy):
    def on_start(self, symbol):
        self.n = 0

    def on_event(self, event):
        self.n += 1
        return [OrderIntent(self.n)] if self.n % 2 == 0 else []


def bars(spark, closes, symbol="AAA"):
    return spark.createDataFrame([(i, i, symbol, c, c, c, 1e6, None, None) for i, c in enumerate(closes)], BARS)


def test_strategies(spark):
    rows = panel.usable_panel(bars(spark, [10.0, 11.0, 12.0, 13.0]))
    assert [r["target"] for r in strategy_targets(rows, Alternate).orderBy("ts").collect()] == [0, 2, 2, 4]
    assert load_strategy("tests.test_io:Alternate", ("tests",)).__name__ == "Alternate"
    with pytest.raises(PermissionError):
        load_strategy("os:path", ("tests",))
    with pytest.raises(TypeError):
        load_strategy("tests.test_io:bars", ("tests",))
    with pytest.raises(ValueError):
        signals.apply_policy(rows, "nonsense")
    assert signals.apply_policy(rows, "minimum_variance", window=2, gross_target=7).first()["target"] == 7


class Pair(Strategy):
    """Speaks for both symbols whenever AAA has a bar."""

    def on_event(self, event):
        return [OrderIntent(1), OrderIntent(-1, symbol="BBB")] if event.symbol == "AAA" else []


def test_a_strategy_may_see_a_portfolio(spark):
    rows = panel.usable_panel(bars(spark, [10.0, 11.0]).unionByName(bars(spark, [20.0, 19.0], "BBB"))).withColumns({"book": F.lit("P"), "place": (F.col("symbol") == "BBB").cast("int")})
    got = {(r["symbol"], r["ts"]): r["target"] for r in strategy_targets(rows, Pair, "book").collect()}
    assert got == {("AAA", 0): 1, ("AAA", 1): 1, ("BBB", 0): -1, ("BBB", 1): -1}
    events = run_strategy(rows, Pair, Config(slippage_model="none"), "book", "place")
    assert [(r["asset"], r["quantity"]) for r in engine.events_of(events, "fill").orderBy("order_id").collect()] == [(0, 1), (1, -1)]
    alone = engine.events_of(run_strategy(rows, Alternate, Config(slippage_model="none", max_position=9)), "curve").where("run_id = 'AAA'").orderBy("row_idx").collect()
    assert [r["position"] for r in alone] == [0, 2]


def test_exact_small_cases(spark):
    times = spark.createDataFrame([(t,) for t in (34_140, 34_200, 34_260, 34_320)], "ts bigint")
    mask = times.select("ts", panel.session_mask(F.col("ts"), 570, 571, range(7)).alias("m")).orderBy("ts").collect()
    assert [r["m"] for r in mask] == [False, True, True, False]
    ranks = spark.createDataFrame([(1, "A", 10.0), (1, "B", 20.0), (1, "C", 30.0)], "ts bigint, symbol string, v double")
    assert [r["rank"] for r in signals.cross_sectional_rank(ranks, "v").orderBy("symbol").collect()] == [3, 2, 1]
    curve = spark.createDataFrame([("A", i, e) for i, e in enumerate([100.0, 120.0, 60.0, 70.0])], "symbol string, ts bigint, equity double")
    assert analytics.drawdowns(curve).agg(F.max("drawdown")).first()[0] == 0.5
    flat = spark.createDataFrame([("A", i, 1.0) for i in range(4)], "symbol string, epoch_day bigint, equity double")
    assert analytics.sharpe_sortino(flat).first()["sharpe"] == 0.0
    up = spark.createDataFrame([("A", i, 1.01**i) for i in range(9)], "symbol string, epoch_day bigint, equity double")
    assert analytics.sharpe_sortino(up).first()["sharpe"] > 1e6
    fills = spark.createDataFrame([("A", i, q, p, f) for i, (q, p, f) in enumerate([(2, 10.0, 1.0), (-1, 12.0, 0.5), (-3, 9.0, 0.5), (2, 8.0, 0.25)])], "symbol string, order_id bigint, quantity bigint, price double, fee double")
    s = analytics.trade_stats(fills).first()
    assert (s["closed"], s["win_rate"], s["avg_loss"]) == (3, 2 / 3, -1.5) and s["profit_factor"] == (1.5 + 1.75) / 1.5
    engine_side = spark.createDataFrame([("AAA", 1)], "symbol string, position bigint")
    r = costs.reconcile(engine_side, spark.createDataFrame([("AAA", 3)], "symbol string, position bigint"), auto=True).first()
    assert (r["delta"], r["action"]) == (2.0, "submit_order")
    sent = []
    costs.submit_corrections(lambda s, d: sent.append((s, d)))(spark.createDataFrame([r]), 0)
    assert sent == [("AAA", 2.0)]
    base = spark.range(1).select(ex.fill_probability(F.array(*(F.lit(x) for x in (1.0, 0.4, 2.0))), 0.5).alias("p")).first()
    assert base["p"] == 0.4


def test_validation_and_empty_tables(spark):
    with pytest.raises(PanelError, match="non-finite"):
        panel.require_finite(spark.createDataFrame([(1, "A", float("nan"), 1.0, 1.0, 1.0, 1.0, 1.0)], "ts bigint, symbol string, close double, high double, low double, volume double, bid double, ask double"))
    none = bars(spark, [10.0]).limit(0)
    rows = panel.usable_panel(none)
    for out in (panel.densify_days(none), signals.rolling_volatility(rows, 3), runs.sweep(rows, CROSS, Config()), *runs.walk_forward_folds(rows, CROSS, Config())):
        assert out.count() == 0
    assert engine.backtest(engine.run_rows(rows.withColumn("target", F.lit(1)), F.col("symbol"))).count() == 0
    odd = spark.createDataFrame([(1, 5, "A", 3.0, None, float("nan"), -1.0, None, None), (2, 5, "A", None, None, None, None, None, None), (3, None, "A", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), (4, 6, None, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), (5, 9, "A", 4.0, None, float("nan"), -1.0, None, None)], BARS)
    r = panel.usable_panel(odd).collect()
    assert [(x["ts"], x["high"], x["low"], x["volume"], x["bid"]) for x in r] == [(9, 4.0, 4.0, 0.0, 4.0)]


def test_exact_percentiles_beyond_small_groups(spark, monkeypatch):
    monkeypatch.setattr(analytics, "SMALL_GROUP", 100)
    rows = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, None).otherwise("g").alias("k"), ((F.col("id") * 7919) % 20_000 / 3.0).alias("v"))
    got = {r["k"]: r for r in analytics.exact_percentiles(rows, ["k"], "v", (0.5, 0.95, 0.99)).collect()}
    for key in ("g", None):
        x = rows.where(F.col("k").eqNullSafe(F.lit(key))).toPandas()["v"]
        assert all(abs(got[key][n] - x.quantile(q)) < 1e-9 for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)))


def test_resampling(spark):
    x = [0.01, -0.005, 0.002, 0.004, -0.003] * 40
    sims = runs.monte_carlo(spark, x, 50, seed=1)
    assert sims.count() == 50 and sims.toPandas().equals(runs.monte_carlo(spark, x, 50, seed=1, parts=3).toPandas())
    shuffled = runs.monte_carlo(spark, x, 20, "shuffle").toPandas()
    assert shuffled["cagr"].std() < 1e-9 and shuffled["max_drawdown"].std() > 0  # order alone changes drawdown only
    assert 0 <= runs.simulation_report(sims, 1.0).first()["p_proxy"] <= 1
    with pytest.raises(ValueError):
        runs.monte_carlo(spark, x, 5, "magic")


def test_windows(spark):
    sizes = spark.createDataFrame([("A", 100), ("B", 5), ("C", 0)], "symbol string, rows bigint")
    spans = [tuple(r) for r in runs.fold_spans(sizes, 3).orderBy("symbol", "fold").collect()]
    assert spans == [("A", 0, 0, 23, 23, 33), ("A", 1, 33, 56, 56, 66), ("A", 2, 66, 89, 89, 100)]
    assert {r["train_start"] for r in runs.fold_spans(sizes, 3, anchored=True).collect()} == {0}


def test_cost_model(spark):
    samples = "arrival_mid double, fill_price double, side int, participation double, quoted_spread_bps double"
    rows = [(100.0, 100.0 * (1 + s * (2 + 1e4 * 0.05 * p * p) * 1e-4), s, p, q) for s, p, q in ((1, 0.1, 1.0), (-1, 0.2, 5.0), (1, 0.3, 9.0), (1, 0.4, 40.0))]
    model = costs.calibrate(spark.createDataFrame(rows, samples))
    r = model.first()
    assert abs(r["fixed_bps"] - 2) < 1e-6 and abs(r["impact"] - 0.05) < 1e-8 and r["spread_bps"] == 7.0 and r["samples"] == 4
    config = costs.calibrated_config(model, Config(commission_bps=3.0))
    assert (config.slippage_bps, config.volume_share_impact, config.commission_bps) == (r["fixed_bps"], r["impact"], 3.0)
    bare = costs.calibrate(spark.createDataFrame([(*x[:4], None) for x in rows], samples)).first()
    assert abs(bare["spread_bps"] - ((2 + 500 * 0.04) + (2 + 500 * 0.09))) < 1e-6  # twice the median size of the impact
    assert costs.calibrate(spark.createDataFrame([], samples)).first()["samples"] == 0


def test_daily_equity_tells_steps_from_times(spark):
    curve = "symbol string, ts bigint, equity double"
    steps = [("STEP", i, float(i)) for i in range(3)]
    seconds = [("SEC", 86_400 * 19_000 + s, float(i)) for i, s in enumerate((0, 80_000, 90_000))]
    nanos = [("NANO", t * 10**9, e) for _, t, e in seconds]
    got = [tuple(r) for r in analytics.daily_equity(spark.createDataFrame(steps + seconds + nanos, curve)).orderBy("symbol", "epoch_day").collect()]
    assert got == [("NANO", 19_000, 1.0), ("NANO", 19_001, 2.0), ("SEC", 19_000, 1.0), ("SEC", 19_001, 2.0), ("STEP", 0, 0.0), ("STEP", 1, 1.0), ("STEP", 2, 2.0)]
