"""Targets run through the engine: the fold, and for runs too long for one task the closed form where configuration and data allow it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators import backtest, engine
from tidewater.operators.engine import Config, Venue


def closed_form_fits(config: Config) -> bool:
    """Whether nothing in the configuration defers, splits or revalues orders; the guard then decides on the data."""
    plain_venue = config.venues in ((), (Venue(),)) or (
        len(config.venues) == 1 and config.venues[0].taker_fee_bps == config.venues[0].maker_fee_bps == 0 and set(config.venues[0].fill_probability_curve) <= {1.0}
    )
    return (
        plain_venue
        and config.latency_steps == config.child_order_size == 0
        and config.slippage_model in ("none", "fixed")
        and not config.use_bid_ask_execution
        and config.mark_to_market
        and config.allow_short
        and config.lot_size == 1
        and config.queue_ahead_fraction == 0
        and config.venue_volume_share_cap >= 1
        and config.annual_borrow_bps == config.annual_cash_yield_bps == config.margin_limit == 0
        and config.signal_to_order_latency_us + config.order_to_fill_latency_us <= 0
        and config.adverse_selection_penalty_bps == 0
        and not (config.instruments or config.rolls or config.asset_max_positions or config.asset_notional_limits)
    )


def costs_of(config: Config) -> backtest.Costs:
    return backtest.Costs(
        config.starting_cash,
        config.commission_bps,
        0.0 if config.slippage_model == "none" else config.slippage_bps,
        config.max_participation_rate,
        config.max_gross_leverage,
        config.max_drawdown_pct,
        config.max_position,
    )


LEDGER = ("sequence", "ts", "order_id", "parent_order_id", "type", "quantity", "price", "cash_after", "equity_after")
FILLS = ("ts", "row_idx", "parent_order_id", "order_id", "quantity", "price", "fee", "arrival_ts", "arrival_price", "close", "bid", "ask", "volume")
#: Rows of a run up to which one task folds it; longer runs are worked in closed form, in slices, where that holds.
HOT_ROWS = 2_000_000


def hot_symbols(bars: DataFrame) -> DataFrame | None:
    """The symbols with over HOT_ROWS rows; None if there are none, as one pass over the column tells. They are at most one in HOT_ROWS rows."""
    counts = bars.where("symbol is not null").groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"))
    found = [(r["symbol"],) for r in counts.where(F.col("rows") > HOT_ROWS).select("symbol").collect()]
    return bars.sparkSession.createDataFrame(found, "symbol string") if found else None


@dataclass(frozen=True)
class Simulation:
    """Targets run through the engine, one run per ``run`` columns (``symbol`` among them), each of one asset.

    Runs are folded, each streaming through one task. For the symbols that are too long for that (``hot``, see ``hot_symbols``) the
    closed form takes over, windows that no task holds whole, where configuration and guard allow it; those in which a rule that depends on the
    path fires anywhere are folded all the same, as no row of theirs can be had without the rows before. Both give the same. ``extra`` names
    a column of the targets that fills carry along.
    """

    targets: DataFrame
    config: Config
    run: tuple[str, ...] = ("symbol",)
    sliced: bool = False
    hot: DataFrame | None = None
    extra: str | None = None

    @cached_property
    def _closed(self) -> tuple[DataFrame, DataFrame] | None:
        """The closed form of the hot runs where it holds, and the other hot runs."""
        if self.hot is None or not closed_form_fits(self.config):
            return None
        targets = self.targets.join(F.broadcast(self.hot), "symbol", "left_semi")
        path = backtest.closed_form(targets, costs_of(self.config), self.run, self.sliced)
        failing = path.where(~F.col("holds")).select(*self.run).distinct()
        return path.join(failing, list(self.run), "left_anti"), failing

    def _folded(self, kind: str) -> DataFrame:
        rows = self.targets.where("own").drop("own", "slice") if self.sliced else self.targets
        if self._closed:
            cold = rows.join(F.broadcast(self.hot), "symbol", "left_anti")
            rows = cold.unionByName(rows.join(F.broadcast(self.hot), "symbol", "left_semi").join(self._closed[1], list(self.run), "left_semi"))
        key = F.to_json(F.struct(*self.run)) if len(self.run) > 1 else F.col(self.run[0])
        events = engine.backtest(engine.run_rows(rows, key, "row_idx", extra=F.col(self.extra) if self.extra else None), self.config, keep=(kind,))
        out = engine.events_of(events, kind)
        if len(self.run) == 1:
            return out.withColumnRenamed("run_id", self.run[0])
        of = F.from_json("run_id", ", ".join(f"{c} {self.targets.schema[c].dataType.simpleString()}" for c in self.run))
        return out.withColumn("run", of).select("run.*", *(c for c in out.columns if c != "run_id"))

    def _both(self, closed: Callable[[DataFrame], DataFrame], kind: str, columns: tuple[str, ...]) -> DataFrame:
        folded = self._folded(kind).select(*self.run, *columns)
        return closed(self._closed[0]).select(*self.run, *columns).unionByName(folded) if self._closed else folded

    @property
    def path(self) -> DataFrame:
        """Every row: ``backtest.PATH_COLUMNS`` after the run's columns."""
        return self._both(lambda p: p, "curve", backtest.PATH_COLUMNS)

    @property
    def fills(self) -> DataFrame:
        """The fills: FILLS and the extra column after the run's columns."""
        more = (F.col(self.extra).alias("extra"),) if self.extra else (F.lit(None).cast("double").alias("extra"),)
        out = self._both(lambda p: backtest.fills_of(p, *more), "fill", (*FILLS, "extra"))
        return out.withColumnRenamed("extra", self.extra) if self.extra else out.drop("extra")

    @property
    def ledger(self) -> DataFrame:
        """The log: ``LEDGER`` after the run's columns."""
        return self._both(backtest.ledger_of, "ledger", LEDGER)
