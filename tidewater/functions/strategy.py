"""Strategies as Python classes: loading from an allow-list, and their intents as a table."""

from __future__ import annotations

import importlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators import engine
from tidewater.operators.engine import Config
from tidewater.runtime import python_tasks


@dataclass(frozen=True)
class MarketEvent:
    """One bar of one symbol, as a strategy sees it."""

    row_idx: int
    ts: int
    symbol: str
    close: float
    high: float
    low: float
    volume: float
    bid: float
    ask: float


@dataclass(frozen=True)
class OrderIntent:
    target: int
    order_type: str = "market"
    limit_price: float | None = None
    symbol: str | None = None  # the event's own unless given


class Strategy:
    """Base class; ``on_event`` returns the intents of a bar, the last of which for a symbol holds until the next one."""

    def on_start(self, name: str) -> None:
        """Called before the first bar, with the symbol or the portfolio whose bars follow."""

    def on_event(self, event: MarketEvent) -> Iterable[OrderIntent]:
        raise NotImplementedError


def load_strategy(name: str, allowed: tuple[str, ...]) -> type[Strategy]:
    """The class named ``module:Class`` if its module is on the allow-list and it is a Strategy."""
    module, _, cls = name.partition(":")
    if not cls:
        raise ValueError("a strategy is named module:Class")
    if not any(module == a or module.startswith(a + ".") for a in allowed):
        raise PermissionError(f"module {module} is not on the list of allowed strategies")
    found = getattr(importlib.import_module(module), cls, None)
    if not (isinstance(found, type) and issubclass(found, Strategy)):
        raise TypeError(f"{name} is not a Strategy")
    return found


_OUT = "portfolio string, symbol string, row_idx bigint, ts bigint, target bigint, order_type string, limit_price double"


def strategy_targets(panel: DataFrame, strategy: type[Strategy], portfolio: str | None = None, **params) -> DataFrame:
    """The strategy's standing intent at every bar: ``symbol, row_idx, ts, target, order_type, limit_price``, and ``portfolio`` if given.

    Bars pass an instance in order of time, in Arrow batches: one instance a symbol, or with ``portfolio`` (a column) one a portfolio, which
    sees the bars of all its symbols and may speak for any of them. Before its first intent a symbol's target is 0; an intent for another
    symbol holds from that symbol's next bar. Strategies see market data only, so signals don't depend on execution.
    """
    of = portfolio or "symbol"

    def play(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, mind, held = None, None, {}
        for pdf in batches:
            out = []
            for whose, *bar in pdf.itertuples(index=False, name=None):
                event = MarketEvent(*bar)
                if whose != name:
                    name, mind, held = whose, strategy(**params), {}
                    mind.on_start(name)
                for intent in mind.on_event(event) or ():
                    held[intent.symbol or event.symbol] = intent
                now = held.get(event.symbol, OrderIntent(0))
                out.append((whose, event.symbol, event.row_idx, event.ts, now.target, now.order_type, now.limit_price))
            yield pd.DataFrame(out, columns=["portfolio", "symbol", "row_idx", "ts", "target", "order_type", "limit_price"]).astype({"limit_price": "float64"})

    bars = panel.where(F.col("symbol").isNotNull()).repartition(python_tasks(panel), of).sortWithinPartitions(of, "ts", "symbol")
    out = bars.select(F.col(of).cast("string").alias("portfolio"), "row_idx", "ts", "symbol", "close", "high", "low", "volume", "bid", "ask").mapInPandas(play, _OUT)
    out = out.withColumn("limit_price", F.when(~F.isnan("limit_price"), F.col("limit_price")))
    return out if portfolio else out.drop("portfolio")


def run_strategy(panel: DataFrame, strategy: type[Strategy], config: Config = Config(), portfolio: str | None = None, asset: str | None = None, **params) -> DataFrame:
    """The engine's events (see ``engine.backtest``) of a strategy's intents over the panel: a run a symbol, or with ``portfolio`` and ``asset`` (columns;
    the place of a symbol in its portfolio) runs of portfolios that share cash."""
    intents = strategy_targets(panel, strategy, portfolio, **params).drop("portfolio", "ts")
    rows = panel.join(intents, ["symbol", "row_idx"])
    laid = engine.run_rows(
        rows, F.col(portfolio or "symbol"), "ts" if portfolio else "row_idx", asset=F.col(asset) if portfolio else None, order_type=F.col("order_type"), limit_price=F.col("limit_price")
    )
    return engine.backtest(laid, config, shared=bool(portfolio))
