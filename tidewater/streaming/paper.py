"""Paper trading: the engine's step as a stateful stream operator, and watermarked bars from ticks."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewater.operators.engine import Config, Row, Rules, State, Step

#: (symbol, price, state so far) -> wanted position
Decide = Callable[[str, float, dict], int]


def follow_trend(symbol: str, price: float, memory: dict) -> int:
    """A plain strategy: long after a rise, short after a fall, else as before."""
    last, wish = memory.get("last"), memory.get("wish", 0)
    if last is not None and price != last:
        wish = 1 if price > last else -1
    memory.update(last=price, wish=wish)
    return wish


#: Latest times of a symbol by which a tick sent again is known.
REMEMBERED = 256


class PaperSession:
    """One portfolio, tick by tick; everything it knows survives a round trip through JSON.

    Its symbols share cash and rules and become known with their first ticks; with ``members`` ticks of other symbols are dropped. A tick
    at a time that the symbol has had lately was sent twice and is dropped as well.
    """

    def __init__(self, config: Config, decide: Decide, text: str | None = None, members: frozenset[str] | None = None) -> None:
        raw = json.loads(text) if text else {}
        self.config, self.decide, self.members = config, decide, members
        self.symbols: list[str] = raw.get("symbols", [])
        self.quotes: dict[str, dict[str, float]] = raw.get("quotes", {})
        self.memory: dict[str, dict] = raw.get("memory", {})
        self.seen: dict[str, list[int]] = raw.get("seen", {})
        self.last: dict[str, list[float]] = raw.get("last", {k: [] for k in ("close", "volume", "bid", "ask", "target")})
        self.state = State.from_json(raw["state"]) if "state" in raw else State.start(0, config)
        self.rules = Rules(config, len(self.symbols))

    def to_json(self) -> str:
        kept = {k: getattr(self, k) for k in ("symbols", "quotes", "memory", "seen", "last")}
        return json.dumps(kept | {"state": self.state.to_json()})

    def on_tick(self, symbol: str, ts: int, price: float, size: float, side: str) -> list[dict]:
        """Take a tick; the fills it brought. Until the first trade the price is the quotes' middle, then the last trade."""
        if self.members is not None and symbol not in self.members:
            return []
        seen = self.seen.setdefault(symbol, [])
        if ts in seen:
            return []
        self.seen[symbol] = [*seen[1 - REMEMBERED :], ts]
        quotes = self.quotes.setdefault(symbol, {})
        quotes[side] = price
        if "TRADE" in quotes:
            close = quotes["TRADE"]
        else:
            known = [quotes[s] for s in ("BID", "ASK") if s in quotes]
            close = sum(known) / len(known)
        target = self.decide(symbol, close, self.memory.setdefault(symbol, {}))
        if symbol not in self.symbols:
            self.symbols.append(symbol)
            self.state.grow(len(self.symbols))
            self.rules = Rules(self.config, len(self.symbols))
            for values in self.last.values():
                values.append(0)
        at, last = self.symbols.index(symbol), self.last
        last["close"][at], last["volume"][at], last["bid"][at], last["ask"][at], last["target"][at] = close, max(size, 0.0), quotes.get("BID", close), quotes.get("ASK", close), target
        prices = np.array(last["close"], dtype=float)
        n = len(prices)
        row = Row(
            ts, True, prices, prices, prices, np.array(last["volume"], dtype=float), np.array(last["bid"], dtype=float), np.array(last["ask"], dtype=float), np.array(last["target"], dtype=np.int64),
            np.zeros(n, dtype=bool), np.full(n, np.nan), (), np.array([at]),
        )
        events, _ = Step(self.state, self.rules, row).run()  # the row counter goes on, so delayed orders get their turn
        return events.fills

    def reconcile(self, broker: dict[str, float], submit: Callable[[str, float], None] | None = None, tolerance: float = 0.0) -> list[dict]:
        """The symbols whose position at the broker differs by more than ``tolerance``; with ``submit`` each is ordered by its difference."""
        own = dict(zip(self.symbols, self.state.positions.tolist()))
        out = []
        for symbol in sorted(set(own) | set(broker)):
            delta = float(broker.get(symbol, 0) - own.get(symbol, 0))
            if abs(delta) > tolerance:
                out.append({"symbol": symbol, "engine_position": own.get(symbol, 0), "broker_position": broker.get(symbol, 0), "delta": delta, "action": "submit_order" if submit else "mismatch_detected"})
                if submit:
                    submit(symbol, delta)
        return out


POSITION_SCHEMA = "portfolio string, symbol string, timestamp_ns bigint, position bigint, cash double, equity double, fills bigint, rows bigint"


def paper_positions(ticks: DataFrame, config: Config = Config(), decide: Decide = follow_trend, portfolios: DataFrame | None = None) -> DataFrame:
    """Per micro-batch, for every portfolio with ticks and each of its symbols so far: position, and the portfolio's cash, equity, fills and rows.

    Works on a streaming table ``symbol, timestamp_ns, price, size, side``; ticks without symbol or time, or whose price is not
    positive and finite, are left out. ``portfolios`` (``symbol, portfolio``, one row a symbol) says which symbols share cash; symbols that are not there are
    dropped. Without it each symbol is a portfolio. State is one JSON text per portfolio in the state store. Within a micro-batch, which the
    source's limits bound (``maxFilesPerTrigger`` and the like), ticks go in order of time; late ones are taken as they come.
    """

    def advance(key: tuple, frames: Iterator[pd.DataFrame], store: GroupState) -> Iterator[pd.DataFrame]:
        session = PaperSession(config, decide, store.get[0] if store.exists else None)
        pdf = pd.concat(list(frames)).sort_values(["timestamp_ns", "symbol"], kind="stable")
        for symbol, ts, price, size, side in zip(pdf["symbol"], pdf["timestamp_ns"], pdf["price"], pdf["size"], pdf["side"]):
            session.on_tick(symbol, int(ts), float(price), float(size) if size == size else 0.0, side)
        store.update((session.to_json(),))
        s, now = session.state, int(pdf["timestamp_ns"].iloc[-1])
        rows = [(key[0], symbol, now, int(p), s.cash, s.equity, s.filled_orders, s.next_row) for symbol, p in zip(session.symbols, s.positions)]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in POSITION_SCHEMA.split(", ")])

    side = F.upper(F.trim("side"))
    good = ticks.where(F.col("symbol").isNotNull() & F.col("timestamp_ns").isNotNull() & (F.col("price") > 0) & (F.col("price") < float("inf"))).select(
        "symbol", "timestamp_ns", "price", F.col("size").cast("double").alias("size"), F.when(side.isin("BID", "ASK"), side).otherwise("TRADE").alias("side")
    )
    good = good.withColumn("portfolio", F.col("symbol")) if portfolios is None else good.join(portfolios.select("symbol", "portfolio"), "symbol")
    return good.groupBy("portfolio").applyInPandasWithState(advance, POSITION_SCHEMA, "session string", "update", GroupStateTimeout.NoTimeout)


def streamed_bars(ticks: DataFrame, width: str = "1 minute", lateness: str = "10 minutes") -> DataFrame:
    """Bars from a stream of ticks: open, high, low, close and volume per symbol and window, late ticks within bounds."""
    good = ticks.where(F.col("symbol").isNotNull() & (F.col("price") > 0) & (F.col("price") < float("inf")))
    timed = good.withColumn("at", F.timestamp_micros((F.col("timestamp_ns") / 1000).cast("bigint"))).withWatermark("at", lateness)
    return timed.groupBy("symbol", F.window("at", width).alias("w")).agg(
        F.min_by("price", "timestamp_ns").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "timestamp_ns").alias("close"), F.sum("size").alias("volume")
    ).select("symbol", F.unix_seconds("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def ledger_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that appends each micro-batch as JSON lines, once even if it is run again."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").json(f"{path.rstrip('/')}/epoch={epoch}")

    return write
