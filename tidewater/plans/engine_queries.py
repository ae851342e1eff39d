"""Queries that fold runs row by row, resample paths or run as streams; SQL can't express these."""

from __future__ import annotations

import uuid
from collections import deque
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.strategy import MarketEvent, OrderIntent, Strategy, run_strategy
from tidewater.operators import engine, panel, runs, signals
from tidewater.operators.asknown import usable_splits
from tidewater.operators.engine import Config, Venue
from tidewater.operators.readings import bad_closes
from tidewater.operators.sliced import by_slice, numbered, own_rows, with_halo
from tidewater.plans.fold_sql import fold_sql, portfolio_sql
from tidewater.plans.reference_queries import FAST, MOST, SLOW, sql
from tidewater.runtime import shared_folder
from tidewater.sources.tables import table
from tidewater.streaming import paper

#: Files of a micro-batch: what one batch holds of a hot symbol stays bounded.
FILES_A_BATCH = 8
REALISTIC = Config(
    starting_cash=10_000_000.0,
    commission_bps=0.1,
    slippage_bps=0.2,
    max_participation_rate=0.2,
    max_position=MOST,
    latency_steps=1,
    child_order_size=2,
    child_slice_delay_steps=1,
    use_bid_ask_execution=True,
    annual_borrow_bps=50.0,
    venues=(Venue(1, 0.1, 0.3, 0.6), Venue(2, 0.2, 0.25, 0.4, (1.0, 0.8))),
)


#: Symbols of a portfolio.
ASSETS = 8
#: Settings under which the rules fire.
RULES = {
    "slow": Config(
        starting_cash=100_000.0, commission_bps=1.0371, slippage_model="fixed", slippage_bps=2.0133, max_participation_rate=0.01, max_position=4, latency_steps=1, child_order_size=2, child_slice_delay_steps=1,
        annual_borrow_bps=300.0, use_bid_ask_execution=True,
    ),
    "poor": Config(starting_cash=400.0, commission_bps=1.0371, slippage_model="fixed", slippage_bps=0.7133, max_position=MOST, max_gross_leverage=2.5),
    "stopped": Config(starting_cash=3_000.0, commission_bps=5.0371, slippage_model="fixed", slippage_bps=5.0133, max_position=MOST, max_drawdown_pct=0.02),
    "margin": Config(starting_cash=10_000.0, commission_bps=0.5371, slippage_model="fixed", slippage_bps=0.7133, max_position=MOST, margin_limit=500.0),
}
#: Limits that portfolios of symbols run into.
TIGHT = Config(starting_cash=1_500.0, commission_bps=1.0371, slippage_model="fixed", slippage_bps=2.0133, max_position=MOST, max_gross_leverage=3.0, max_drawdown_pct=0.3)


def _bars(spark: SparkSession, root: str) -> DataFrame:
    return panel.usable_panel(table(spark, root, "bars"))


def _crossovers(spark: SparkSession, root: str) -> DataFrame:
    return signals.moving_average_crossover(_bars(spark, root), FAST, SLOW, MOST)


def backtest_full(spark: SparkSession, root: str) -> DataFrame:
    """Fills and ledger of a crossover run of every symbol with latency, child orders, two venues, costs and borrow."""
    return engine.backtest(engine.run_rows(_crossovers(spark, root), F.col("symbol")), REALISTIC, keep=("fill", "ledger"))


def _in_portfolios(rows: DataFrame) -> DataFrame:
    """Rows with ``portfolio`` and ``place``: the symbols in order, so many a portfolio; as there are more symbols there are more portfolios."""
    ids = panel.dense_asset_ids(rows).select("symbol", F.floor(F.col("asset") / ASSETS).cast("int").alias("portfolio"), (F.col("asset") % ASSETS).cast("int").alias("place"))
    return rows.join(ids, "symbol")


def backtest_portfolio(spark: SparkSession, root: str) -> DataFrame:
    """The same settings with portfolios of symbols that share cash and limits; a symbol without a bar is carried at its last close."""
    rows = _in_portfolios(_crossovers(spark, root))
    return engine.backtest(engine.run_rows(rows, F.col("portfolio"), asset=F.col("place")), REALISTIC, keep=("fill", "ledger", "curve"), shared=True)


def portfolio_rules(spark: SparkSession, root: str) -> DataFrame:
    """Curves of portfolios under tight limits: shared cash runs short, leverage over all assets is refused, the kill switch stops a run within a bar."""
    rows = engine.run_rows(_in_portfolios(_crossovers(spark, root)), F.col("portfolio"), asset=F.col("place"))
    curve = engine.events_of(engine.backtest(rows, TIGHT, keep=("curve",), shared=True), "curve")
    return curve.select(F.col("run_id").cast("int").alias("portfolio"), "row_idx", "ts", "position", "trade", "row_fills", *(F.round(c, 4).alias(c) for c in ("cash", "equity")), F.round("drawdown", 9).alias("drawdown"))


def _under_rules(spark: SparkSession, root: str, kind: str) -> DataFrame:
    rows = engine.run_rows(_crossovers(spark, root), F.col("symbol"), "row_idx")
    parts = [engine.events_of(engine.backtest(rows, config, keep=(kind,)), kind).withColumn("rules", F.lit(name)) for name, config in RULES.items()]
    return reduce(DataFrame.unionByName, parts)


def engine_rules(spark: SparkSession, root: str) -> DataFrame:
    """Curves of every symbol's run under settings that make the rules fire: capacity, delays, cash, leverage, drawdown, margin, borrow cost."""
    rows = _under_rules(spark, root, "curve")
    return rows.select("rules", F.col("run_id").alias("symbol"), "row_idx", "position", *(F.round(c, 4).alias(c) for c in ("cash", "equity")), F.round("drawdown", 9).alias("drawdown"))


def engine_rules_log(spark: SparkSession, root: str) -> DataFrame:
    """The ledgers of those runs."""
    rows = _under_rules(spark, root, "ledger")
    money = (F.round(c, 4).alias(c) for c in ("price", "cash_after", "equity_after"))
    return rows.select("rules", F.col("run_id").alias("symbol"), "sequence", "ts", "type", "order_id", "parent_order_id", "quantity", *money)


class Chase(Strategy):
    """Long what has risen over ``lookback`` bars, short what has fallen; speaks only when its mind changes."""

    def __init__(self, lookback: int = 5, size: int = 3) -> None:
        self.lookback, self.size, self.past, self.said = lookback, size, {}, {}

    def on_event(self, event: MarketEvent) -> list[OrderIntent]:
        past = self.past.setdefault(event.symbol, deque(maxlen=self.lookback + 1))
        past.append(event.close)
        moved = event.close - past[0] if len(past) > self.lookback else 0.0
        target = self.size * ((moved > 0) - (moved < 0))
        if target == self.said.get(event.symbol, 0):
            return []
        self.said[event.symbol] = target
        return [OrderIntent(target)]


def strategy_run(spark: SparkSession, root: str) -> DataFrame:
    """Curves of a strategy written as a Python class, one run a symbol."""
    curve = engine.events_of(run_strategy(_bars(spark, root), Chase, RULES["slow"]), "curve")
    return curve.select(F.col("run_id").alias("symbol"), "row_idx", "position", *(F.round(c, 4).alias(c) for c in ("cash", "equity")))


def strategy_portfolios(spark: SparkSession, root: str) -> DataFrame:
    """Fills of the strategy over portfolios of symbols that share cash, an instance seeing all bars of its portfolio."""
    rows = _in_portfolios(_bars(spark, root))
    return engine.events_of(run_strategy(rows, Chase, REALISTIC, "portfolio", "place"), "fill")


def _tick_targets(spark: SparkSession, root: str) -> DataFrame:
    """Every symbol's usable ticks with quotes carried forward and a momentum target."""
    ticks = panel.load_ticks(table(spark, root, "ticks")).where((F.col("price") > 0) & (F.col("price") < float("inf"))).drop("asset")
    placed = with_halo(numbered(ticks, "symbol", "hour", "timestamp_ns", "src_order"), 10)
    moved = own_rows(placed.withColumn("change", F.col("price") - F.lag("price", 10).over(by_slice())))
    quoted, change = signals.carried_quotes(moved), F.col("change")
    return quoted.select(
        "symbol", F.col("timestamp_ns").alias("ts"), "side", F.col("price").alias("close"), F.col("price").alias("high"), F.col("price").alias("low"),
        F.greatest(F.coalesce("size", F.lit(0.0)), F.lit(0.0)).alias("volume"), F.col("best_bid").alias("bid"), F.col("best_ask").alias("ask"),
        F.signum(F.coalesce(change, F.lit(0.0))).cast("bigint").alias("target"),
    )


def backtest_ticks(spark: SparkSession, root: str) -> DataFrame:
    """Fills of a momentum run over every symbol's ticks: limit orders that only a trade can price."""
    limit = F.when(F.col("side") == "TRADE", F.col("close"))
    rows = engine.run_rows(_tick_targets(spark, root), F.col("symbol"), order_type=F.lit(engine.LIMIT), limit_price=limit)
    return engine.backtest(rows, Config(max_position=1), keep=("fill",))


def backtest_ticks_portfolio(spark: SparkSession, root: str) -> DataFrame:
    """Fills of portfolios of symbols over their ticks, which share cash: at each time the assets that tick can trade."""
    rows = engine.run_rows(_in_portfolios(_tick_targets(spark, root)), F.col("portfolio"), asset=F.col("place"))
    return engine.backtest(rows, Config(max_position=1, slippage_model="none"), keep=("fill",), shared=True)


def corp_actions_apply(spark: SparkSession, root: str) -> DataFrame:
    """Curve of a buy-and-hold run of every symbol with its corporate actions taking effect at their first bar."""
    bars = _bars(spark, root)
    actions = panel.load_actions(table(spark, root, "corporate_actions"), table(spark, root, "assets"))
    actions = actions.where("ratio_or_amount > 0").groupBy("symbol", "ex_date_timestamp", "action_type", "ratio_or_amount").agg(F.min("action_id").alias("action_id"))
    placed = panel.as_of_forward(actions, bars, "symbol", "ex_date_timestamp", "ts", "close").where("row_ts >= ex_date_timestamp")
    kinds = F.sort_array(F.collect_list(F.struct("action_id", F.col("action_type").alias("kind"), F.col("ratio_or_amount").alias("amount"))))
    due = placed.groupBy("symbol", F.col("row_ts").alias("ts")).agg(kinds.alias("due"))
    rows = bars.withColumn("target", F.lit(1)).join(due, ["symbol", "ts"], "left")
    due = F.transform("due", lambda a: F.struct(a["kind"].alias("kind"), a["amount"].alias("amount")))
    events = engine.backtest(engine.run_rows(rows, F.col("symbol"), actions=due), Config(max_position=1, slippage_model="none", dividend_reinvestment=True), keep=("curve", "audit"))
    return events.select("run_id", "kind", "row_idx", "ts", "type", "quantity", "cash_after", "equity_after", "value")


def mc_bootstrap(spark: SparkSession, root: str) -> DataFrame:
    """Block-bootstrapped paths of the market's mean daily return (one number per UTC day reaches the driver).

    Returns are those of closes adjusted for splits; closes that cannot be true (``readings``) are left out, lasting jumps stay.
    """
    bars = _bars(spark, root)
    bad = bad_closes(table(spark, root, "bars"))
    adjusted = signals.adjustment_factors(bars.join(bad, ["symbol", "ts"], "left_anti"), usable_splits(table(spark, root, "corporate_actions")))
    rows = own_rows(panel.sliced_returns(with_halo(adjusted.withColumn("close", F.col("close") / F.col("adjustment")), 64)))
    daily = rows.groupBy(F.floor(F.col("ts") / 86_400).alias("day")).agg(F.avg("ret").alias("ret")).orderBy("day").toPandas()
    years = max((daily["day"].iloc[-1] - daily["day"].iloc[0]) / 365.25, 1 / 252) if len(daily) else None
    return runs.monte_carlo(spark, daily["ret"].to_numpy(), n_sims=500, block=10, seed=7, years=years)


def mc_report(spark: SparkSession, root: str) -> DataFrame:
    """Percentiles of the resampled paths' figures."""
    out = runs.simulation_report(mc_bootstrap(spark, root), 1.0)
    return out.select(F.explode(F.array(*(F.struct(F.lit(c).alias("figure"), F.col(c).alias("percentiles")) for c in ("sharpe", "max_drawdown", "cagr")))).alias("r"), "p_proxy").select("r.*", "p_proxy")


def streaming_positions(spark: SparkSession, root: str) -> DataFrame:
    """Paper trading over all ticks as a stream that ends with its input; the last row of every symbol."""
    place = f"{shared_folder(spark).rstrip('/')}/paper-{uuid.uuid4().hex}"
    ticks = stream_table(spark, root, "ticks")
    query = (
        paper.paper_positions(ticks)
        .writeStream.outputMode("update")
        .foreachBatch(lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{place}/out/epoch={epoch}"))
        .option("checkpointLocation", f"{place}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    rows = spark.read.schema(paper.POSITION_SCHEMA + ", epoch int").parquet(f"{place}/out")
    last = F.max_by(F.struct("timestamp_ns", "position", "cash", "equity", "fills", "rows"), "epoch").alias("r")
    return rows.groupBy("symbol").agg(last).select("symbol", "r.*")


def stream_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the folder as a stream, whether it is one file or a folder of files."""
    path = f"{root}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    single = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_A_BATCH)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(root) if single else reader.parquet(path)


QUERIES = {
    "backtest_full": backtest_full,
    "backtest_portfolio": backtest_portfolio,
    "portfolio_rules": portfolio_rules,
    "engine_rules": engine_rules,
    "engine_rules_log": engine_rules_log,
    "strategy_run": strategy_run,
    "strategy_portfolios": strategy_portfolios,
    "backtest_ticks": backtest_ticks,
    "backtest_ticks_portfolio": backtest_ticks_portfolio,
    "corp_actions_apply": corp_actions_apply,
    "mc_bootstrap": mc_bootstrap,
    "mc_report": mc_report,
    "streaming_positions": streaming_positions,
}


def _rules_sql(select: str) -> str:
    """``select`` for every setting, with ``{folded}`` and ``{logged}`` for its tables."""
    parts = []
    for name, config in RULES.items():
        own = fold_sql("ma", "symbol", config)
        parts += [f"folded_{name} AS ({own['folded'].replace('FROM folded s', f'FROM folded_{name} s')})", f"logged_{name} AS ({own['logged'].replace('FROM folded)', f'FROM folded_{name})').replace('JOIN folded q', f'JOIN folded_{name} q')})"]
    each = [select.format(rules=name, folded=f"folded_{name}", logged=f"logged_{name}") for name in RULES]
    return sql("ma", " UNION ALL ".join(each), *parts)


ORACLES: dict[str, str] = {
    "portfolio_rules": sql(
        "ma",
        """SELECT portfolio, r AS row_idx, ts, list_sum(pos)::BIGINT AS position, (list_sum(pos) - pos0)::BIGINT AS trade, fills AS row_fills, round(cash, 4) AS cash, round(equity, 4) AS equity, round(drawdown, 9) AS drawdown
FROM folded_shared WHERE last""",
        *portfolio_sql("ma", ASSETS, TIGHT),
    ),
    "strategy_run": sql(
        "panel",
        "SELECT symbol, row_idx, held AS position, round(cash, 4) AS cash, round(equity, 4) AS equity FROM folded WHERE row_idx >= 0",
        "wished AS MATERIALIZED (SELECT *, (sign(coalesce(close - lag(close, 5) OVER (PARTITION BY symbol ORDER BY row_idx), 0)) * 3)::BIGINT AS target FROM panel)",
        f"folded AS ({fold_sql('wished', 'symbol', RULES['slow'])['folded']})",
    ),
    "engine_rules": _rules_sql("SELECT '{rules}' AS rules, symbol, row_idx, held AS position, round(cash, 4) AS cash, round(equity, 4) AS equity, round(drawdown, 9) AS drawdown FROM {folded} WHERE row_idx >= 0"),
    "engine_rules_log": _rules_sql(
        "SELECT '{rules}' AS rules, symbol, sequence, ts, type, order_id, parent_order_id, quantity, round(price, 4) AS price, round(cash_after, 4) AS cash_after, round(equity_after, 4) AS equity_after FROM {logged}"
    ),
}
