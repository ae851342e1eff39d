"""Order execution as an ordered fold: one pure step per time of a portfolio run, and its Spark adapter.

Assets of a run share cash, so a run is folded in order; runs are independent. The adapter streams a run's rows through
one task in Arrow batches: what is held is the portfolio's state, never the run. In runs of one asset only rows in which something can
happen are stepped; the stretches between them, in which a position is just carried and marked, are worked as arrays.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.runtime import python_tasks

MARKET, LIMIT = "market", "limit"
FIRST_CHILD_ID = 1_000_000


@dataclass(frozen=True)
class Venue:
    venue_id: int = 0
    maker_fee_bps: float = 0.0
    taker_fee_bps: float = 0.0
    volume_share: float = 1.0
    fill_probability_curve: tuple[float, ...] = (1.0,)
    one_way_latency_us: int = 0

    def probability(self, queue_ahead: float) -> float:
        curve = self.fill_probability_curve
        if not curve:
            return 1.0
        place = min(max(math.floor(queue_ahead * (len(curve) - 1)), 0), len(curve) - 1)
        return min(max(curve[place], 0.0), 1.0)


@dataclass(frozen=True)
class Instrument:
    kind: str = "equity"  # equity, future, option_call, option_put, fx_forward
    expiry_ts: int = 0
    strike: float = 0.0
    underlying: int = -1
    margin_ratio: float = 0.0


@dataclass(frozen=True)
class Roll:
    from_asset: int
    to_asset: int
    ts: int
    slippage_bps: float = 0.0


@dataclass(frozen=True)
class Config:
    """Settings of a run; names and defaults are those users of such engines know."""

    starting_cash: float = 1_000_000.0
    commission_bps: float = 0.0
    slippage_model: str = "volume_share"  # none, fixed, volume_share
    slippage_bps: float = 0.0
    volume_share_impact: float = 0.05
    max_participation_rate: float = 0.25
    lot_size: int = 1
    max_position: int = 1
    latency_steps: int = 0
    child_order_size: int = 0
    child_slice_delay_steps: int = 0
    annual_borrow_bps: float = 0.0
    annual_cash_yield_bps: float = 0.0
    max_gross_leverage: float = 10.0
    max_drawdown_pct: float = 1.0
    queue_ahead_fraction: float = 0.0
    venue_volume_share_cap: float = 1.0
    allow_short: bool = True
    mark_to_market: bool = True
    cancel_orders_outside_session: bool = True
    use_bid_ask_execution: bool = False
    dividend_reinvestment: bool = False
    signal_to_order_latency_us: int = 0
    order_to_fill_latency_us: int = 0
    stochastic_latency: bool = False
    latency_jitter_sigma: float = 0.0
    latency_drift_model: str = "none"  # none, gbm, empirical
    adverse_velocity_threshold: float = 0.0
    adverse_selection_penalty_bps: float = 0.0
    margin_limit: float = 0.0
    seed: int = 42
    venues: tuple[Venue, ...] = (Venue(),)
    instruments: tuple[Instrument, ...] = ()
    rolls: tuple[Roll, ...] = ()
    asset_max_positions: tuple[int, ...] = ()
    asset_notional_limits: tuple[float, ...] = ()


@dataclass
class Cell:
    """One asset's market data and wish in one row."""

    close: float
    high: float
    low: float
    volume: float
    bid: float
    ask: float
    target: int = 0
    order_type: str = MARKET
    limit_price: float | None = None
    actions: tuple[tuple[str, float], ...] = ()


@dataclass
class Row:
    """One time of a run: market data and wishes as arrays over its assets. Assets that are not ``present`` (all, if None) have no bar now:
    they are marked at their last close and don't trade."""

    ts: int
    tradable: bool
    close: np.ndarray
    high: np.ndarray
    low: np.ndarray
    volume: np.ndarray
    bid: np.ndarray
    ask: np.ndarray
    target: np.ndarray
    limited: np.ndarray
    limit: np.ndarray
    actions: tuple[tuple[int, str, float], ...] = ()
    present: np.ndarray | None = None

    @classmethod
    def of(cls, ts: int, tradable: bool, cells: list[Cell]) -> Row:
        data = [np.array([getattr(c, f) for c in cells], dtype=float) for f in ("close", "high", "low", "volume", "bid", "ask")]
        if not np.isfinite(data).all():
            raise ValueError("market data contains non-finite values")
        limit = np.array([np.nan if c.limit_price is None else c.limit_price for c in cells], dtype=float)
        actions = tuple((i, kind, amount) for i, c in enumerate(cells) for kind, amount in c.actions)
        return cls(ts, tradable, *data, np.array([c.target for c in cells], dtype=np.int64), np.array([c.order_type == LIMIT for c in cells]), limit, actions)


@dataclass
class Order:
    parent_id: int
    target: int
    remaining: int
    limit_price: float | None
    order_type: str
    ready: int
    arrival_ts: int = 0
    arrival_price: float = 0.0


@dataclass
class State:
    """Everything a run carries from row to row; it survives a round trip through JSON."""

    cash: float
    positions: np.ndarray
    adjustment: np.ndarray
    peak_equity: float
    pending: dict[int, Order] = field(default_factory=dict)
    max_drawdown: float = 0.0
    turnover: float = 0.0
    total_fees: float = 0.0
    total_borrow_cost: float = 0.0
    total_cash_yield: float = 0.0
    submitted_orders: int = 0
    filled_orders: int = 0
    rejected_orders: int = 0
    next_parent_id: int = 1
    next_child_id: int = FIRST_CHILD_ID
    next_sequence: int = 1
    next_row: int = 0
    equity: float = 0.0
    halted: bool = False
    last_entry: dict | None = None

    @classmethod
    def start(cls, assets: int, config: Config) -> State:
        cash = config.starting_cash
        return cls(cash, np.zeros(assets, dtype=np.int64), np.ones(assets), cash, equity=cash)

    def grow(self, assets: int) -> None:
        """Make room for assets that come up later in a run."""
        more = assets - len(self.positions)
        if more > 0:
            self.positions = np.append(self.positions, np.zeros(more, dtype=np.int64))
            self.adjustment = np.append(self.adjustment, np.ones(more))

    def to_json(self) -> str:
        plain = {f.name: getattr(self, f.name) for f in fields(self)}
        plain |= {"positions": self.positions.tolist(), "adjustment": self.adjustment.tolist(), "pending": {str(k): asdict(o) for k, o in self.pending.items()}}
        return json.dumps(plain)

    @classmethod
    def from_json(cls, text: str) -> State:
        raw = json.loads(text)
        raw["pending"] = {int(k): Order(**o) for k, o in raw["pending"].items()}
        raw["positions"], raw["adjustment"] = np.array(raw["positions"], dtype=np.int64), np.array(raw["adjustment"], dtype=float)
        return cls(**{f.name: raw[f.name] for f in fields(cls) if f.name in raw})


class Rules:
    """A configuration spread over the assets of a run."""

    def __init__(self, config: Config, assets: int) -> None:
        padded = lambda values, default: np.array([values[i] if i < len(values) and values[i] > 0 else default for i in range(assets)])
        self.config, self.assets = config, assets
        self.most = padded(config.asset_max_positions, config.max_position).astype(np.int64)
        self.least = -self.most if config.allow_short else np.zeros(assets, dtype=np.int64)
        self.notional = padded(config.asset_notional_limits, math.inf).astype(float)
        self.ratio = padded([x.margin_ratio for x in config.instruments], 1.0).astype(float)
        self.options = [(i, x) for i, x in enumerate(config.instruments[:assets]) if x.kind.startswith("option_")]
        self.dated = np.array([r.ts for r in config.rolls] + [x.expiry_ts for _, x in self.options], dtype=np.int64)
        self.borrow, self.earn = config.annual_borrow_bps * 1e-4 / 252.0, config.annual_cash_yield_bps * 1e-4 / 252.0


@dataclass
class Events:
    """What a step emits: fills, audit and finished ledger entries, as dicts."""

    fills: list[dict] = field(default_factory=list)
    audit: list[dict] = field(default_factory=list)
    ledger: list[dict] = field(default_factory=list)


class Step:
    """One row's work on the state, in the fixed order of the rules."""

    def __init__(self, state: State, rules: Rules, row: Row) -> None:
        if len(row.close) != len(state.positions) or rules.assets != len(state.positions):
            raise ValueError("a row must have a cell for every asset of the run")
        self.s, self.rules, self.c, self.r, self.ts = state, rules, rules.config, row, row.ts
        self.row = state.next_row
        self.out = Events()

    # -- records

    def note(self, kind: str, value: float, asset: int = -1, parent: int = 0, order: int = 0) -> None:
        self.out.audit.append({"ts": self.ts, "order_id": order, "parent_order_id": parent, "asset": asset, "type": kind, "value": float(value)})

    def enter(self, kind: str, value: float, asset: int = -1, parent: int = 0, order: int = 0, quantity: int = 0, remaining: int = 0, price: float = 0.0, equity: float = 0.0) -> None:
        """A ledger entry. The log's last entry is revalued every row, so an entry is finished when the next one comes."""
        if self.s.last_entry is not None:
            self.out.ledger.append(self.s.last_entry)
        self.s.last_entry = {
            "sequence": self.s.next_sequence, "ts": self.ts, "order_id": order, "parent_order_id": parent, "asset": asset, "type": kind, "quantity": quantity,
            "remaining_quantity": remaining, "price": float(price), "cash_after": self.s.cash, "equity_after": float(equity), "value": float(value),
        }
        self.s.next_sequence += 1

    def both(self, kind: str, value: float, asset: int = -1, parent: int = 0, quantity: int = 0, remaining: int = 0, price: float = 0.0) -> None:
        self.note(kind, value, asset, parent)
        self.enter(kind, value, asset, parent, 0, quantity, remaining, price)

    # -- values

    def worth(self, asset: int, position: int | None = None) -> float:
        """Signed market value of a position at the close."""
        return float(self.s.positions[asset] if position is None else position) * self.c.lot_size * float(self.r.close[asset])

    def marked(self) -> float:
        return float(self.s.positions @ self.r.close) * self.c.lot_size

    def gross(self, positions: np.ndarray) -> float:
        return float(np.abs(positions) @ self.r.close) * self.c.lot_size

    # -- before trading

    def roll_futures(self) -> None:
        n = len(self.r.close)
        for r in self.c.rolls:
            if r.ts != self.ts or not (0 <= r.from_asset < n and 0 <= r.to_asset < n) or not self.s.positions[r.from_asset]:
                continue
            moved = int(self.s.positions[r.from_asset])
            self.s.positions[r.from_asset] = 0
            self.s.positions[r.to_asset] += moved
            cost = abs(self.worth(r.to_asset, moved)) * r.slippage_bps * 1e-4
            self.s.cash -= cost
            self.s.total_fees += cost
            self.note("FUTURE_ROLL", cost, r.to_asset)

    def corporate_actions(self) -> None:
        s, lot = self.s, self.c.lot_size
        for asset, kind, amount in self.r.actions:
            held, close = int(s.positions[asset]), float(self.r.close[asset])
            if kind == "SPLIT" and amount > 0:
                grown = held * amount
                s.positions[asset] = int(math.copysign(math.floor(abs(grown) + 0.5), grown))
                s.adjustment[asset] /= amount
            elif kind == "DIVIDEND":
                paid = held * lot * amount
                units = math.floor(paid / (close * lot)) if self.c.dividend_reinvestment and paid > 0 and close > 0 else 0
                if units > 0:  # the remainder below a lot is forgone
                    s.positions[asset] += units
                    s.turnover += units * lot * close
                else:
                    s.cash += paid
            elif kind == "SPINOFF":
                s.cash += held * lot * amount
            elif kind == "DELISTING" and held:
                s.cash += self.worth(asset)
                s.turnover += abs(self.worth(asset))
                s.positions[asset] = 0
                s.pending.clear()
                self.note("FILL_APPLIED", close, asset)

    def carry(self) -> None:
        s = self.s
        if self.rules.borrow:
            cost = -float(np.minimum(s.positions, 0) @ self.r.close) * self.c.lot_size * self.rules.borrow
            earned = max(0.0, s.cash) * self.rules.earn
            s.cash += earned - cost
            s.total_borrow_cost += cost
            s.total_cash_yield += earned
        elif self.rules.earn:
            earned = max(0.0, s.cash) * self.rules.earn
            s.cash += earned
            s.total_cash_yield += earned

    def expire_options(self) -> None:
        for asset, kind in self.rules.options:
            held = int(self.s.positions[asset])
            source = kind.underlying if kind.underlying >= 0 else asset
            if kind.expiry_ts != self.ts or not held or source >= len(self.r.close):
                continue
            gap = float(self.r.close[source]) - kind.strike
            settled = max(0.0, gap if kind.kind == "option_call" else -gap) * held * self.c.lot_size
            self.s.cash += settled
            self.s.positions[asset] = 0
            self.note("OPTION_EXPIRY", settled, asset)

    def close_session(self) -> None:
        if self.r.tradable or not self.c.cancel_orders_outside_session:
            return
        for asset in sorted(self.s.pending):
            order = self.s.pending.pop(asset)
            self.both("ORDER_CANCELLED_SESSION", 0.0, -1, order.parent_id, remaining=order.remaining)

    # -- trading

    def place_orders(self) -> None:
        s, r, most_leverage = self.s, self.r, self.c.max_gross_leverage
        base = max(1.0, s.cash)
        wanted = np.clip(r.target, self.rules.least, self.rules.most)
        leverage = self.gross(wanted) / base
        here = np.arange(len(wanted)) if r.present is None else r.present
        if leverage > most_leverage:
            for asset in here.tolist():
                s.rejected_orders += 1
                gap = int(wanted[asset] - s.positions[asset])
                self.both("ORDER_REJECTED_LEVERAGE", leverage, asset, quantity=gap, remaining=gap)
            return
        held = self.gross(s.positions)
        moving = ((wanted != s.positions) | (wanted != r.target))[here]
        if s.pending:
            moving |= np.isin(here, list(s.pending))
        for asset in here[moving].tolist():
            target, order = int(wanted[asset]), s.pending.get(asset)
            if target != r.target[asset]:
                s.rejected_orders += 1
                self.both("ORDER_REJECTED_LIMIT", r.target[asset], asset, quantity=int(r.target[asset]))
            if order and order.target == target:
                continue
            gap = target - int(s.positions[asset])
            if gap:
                after = (held - abs(self.worth(asset)) + abs(self.worth(asset, target))) / base
                if after > most_leverage or abs(self.worth(asset, target)) > self.rules.notional[asset]:
                    s.rejected_orders += 1
                    self.both("ORDER_REJECTED_LEVERAGE", after, asset, quantity=gap, remaining=gap)
                    continue
            if order:
                self.both("ORDER_CANCELLED_REPLACE", 0.0, asset, order.parent_id, remaining=order.remaining)
                del s.pending[asset]
            if gap:
                limit = float(r.limit[asset])
                new = Order(
                    s.next_parent_id, target, gap, None if math.isnan(limit) else limit, LIMIT if r.limited[asset] else MARKET, self.row + max(0, self.c.latency_steps), self.ts, float(r.close[asset])
                )
                s.pending[asset] = new
                s.next_parent_id += 1
                s.submitted_orders += 1
                self.both("ORDER_SUBMITTED", target, asset, new.parent_id, quantity=gap, remaining=gap)

    def price_of(self, order: Order, size: int, asset: int) -> tuple[float, float]:
        """Price with slippage, and the same moved on by latency."""
        c, r, side = self.c, self.r, 1.0 if order.remaining > 0 else -1.0
        market = float((r.ask if side > 0 else r.bid)[asset]) if c.use_bid_ask_execution else float(r.close[asset])
        if order.order_type == LIMIT and order.limit_price is not None:
            market = min(market, order.limit_price) if side > 0 else max(market, order.limit_price)
        bps = 0.0 if c.slippage_model == "none" else c.slippage_bps
        if c.slippage_model == "volume_share":
            bps += 10_000.0 * c.volume_share_impact * min(1.0, size / float(r.volume[asset])) ** 2
        base = market * (1.0 + side * bps * 1e-4)
        latency = c.signal_to_order_latency_us + c.order_to_fill_latency_us
        if latency <= 0 and c.adverse_selection_penalty_bps == 0:
            return base, base
        high = float(r.high[asset])
        speed = abs(high - float(r.low[asset])) / high if high > 0 else 0.0
        if c.stochastic_latency and c.latency_jitter_sigma > 0:
            draw = np.random.default_rng((c.seed, self.row, asset)).standard_normal()
            latency = math.exp(math.log(max(1.0, latency)) + c.latency_jitter_sigma * draw)
        drift = side * speed * math.sqrt(max(latency / (1e6 * 86_400.0), 0.0))
        price = base
        if speed > 0 and c.latency_drift_model == "gbm":
            price = base * math.exp(drift)
        elif speed > 0 and c.latency_drift_model == "empirical":
            price = base * (1.0 + drift)
        if c.adverse_velocity_threshold > 0 and speed > c.adverse_velocity_threshold:
            price *= 1.0 + side * c.adverse_selection_penalty_bps * 1e-4
        return base, price

    def fill_orders(self) -> None:
        c, s, r = self.c, self.s, self.r
        here = None if r.present is None else set(r.present.tolist())
        for asset in sorted(s.pending):
            order = s.pending[asset]
            if order.ready > self.row or not order.remaining or (here is not None and asset not in here):
                continue
            if order.order_type == LIMIT:
                limit = order.limit_price
                if limit is None or (r.low[asset] > limit if order.remaining > 0 else r.high[asset] < limit):
                    continue
            volume = max(0.0, float(r.volume[asset]))
            capacity = max(0.0, volume * c.venue_volume_share_cap - volume * c.queue_ahead_fraction)
            most = math.floor(min(volume * c.max_participation_rate, capacity)) if capacity >= 1.0 else 0
            if most <= 0:
                self.both("ORDER_WAITING_QUEUE", capacity, asset, order.parent_id, remaining=order.remaining)
                continue
            size = min(abs(order.remaining), most)
            size = min(size, c.child_order_size) if c.child_order_size > 0 else size
            sign = 1 if order.remaining > 0 else -1
            base, price = self.price_of(order, size, asset)
            done, fees = self.split_over_venues(asset, order, size, sign, base, price)
            if not done:
                continue
            cash = s.cash - sign * done * c.lot_size * price - fees
            if cash < 0 and s.positions[asset] >= 0 and sign > 0:  # its fills stay on record
                s.rejected_orders += 1
                self.both("ORDER_REJECTED_CASH", cash, asset, order.parent_id, sign * size, order.remaining, price)
                del s.pending[asset]
                continue
            s.cash = cash
            s.positions[asset] += sign * done
            order.remaining -= sign * done
            s.turnover += done * c.lot_size * price
            s.total_fees += fees
            s.filled_orders += 1
            if self.watch(s.cash + self.marked(), c.max_drawdown_pct):
                return
            if not order.remaining or s.positions[asset] == order.target:
                del s.pending[asset]
            else:
                order.ready = self.row + c.child_slice_delay_steps + 1

    def split_over_venues(self, asset: int, order: Order, size: int, sign: int, base: float, price: float) -> tuple[int, float]:
        c, left, fees = self.c, size, 0.0
        venues = c.venues or (Venue(),)
        for place, venue in enumerate(venues):
            if left <= 0:
                break
            part = left if place == len(venues) - 1 else min(max(math.floor(size * max(0.0, venue.volume_share)), 0), left)
            part = math.floor(part * venue.probability(c.queue_ahead_fraction))
            if part <= 0:
                continue
            notional = part * c.lot_size * price
            cost = notional * (c.commission_bps + venue.taker_fee_bps - venue.maker_fee_bps) * 1e-4
            order_id, rest = self.s.next_child_id, order.remaining - sign * part
            self.s.next_child_id += 1
            self.out.fills.append({
                "ts": self.ts, "order_id": order_id, "parent_order_id": order.parent_id, "asset": asset, "price": price, "quantity": sign * part, "remaining_quantity": rest,
                "fee": cost, "venue_id": venue.venue_id, "gross_price": base, "maker_fee_bps": venue.maker_fee_bps, "taker_fee_bps": venue.taker_fee_bps,
                "net_price": price + cost / max(1, part * c.lot_size), "order_type": order.order_type, "arrival_ts": order.arrival_ts, "arrival_price": order.arrival_price,
                "close": float(self.r.close[asset]), "bid": float(self.r.bid[asset]), "ask": float(self.r.ask[asset]), "volume": float(self.r.volume[asset]),
            })
            self.note("FILL_APPLIED", price, asset, order.parent_id, order_id)
            self.enter("FILL_APPLIED", cost, asset, order.parent_id, order_id, sign * part, rest, price)
            left -= part
            fees += cost
        return size - left, fees

    # -- after trading

    def watch(self, equity: float, most: float) -> bool:
        """Update the peak; halt trading if the drawdown from it is too deep. True if that happened just now."""
        s = self.s
        s.peak_equity = max(s.peak_equity, equity)
        self.fallen = (s.peak_equity - equity) / s.peak_equity if s.peak_equity > 0 else 0.0
        if self.fallen <= most or s.halted:
            return False
        s.halted = True
        s.pending.clear()
        self.note("RISK_KILL_SWITCH", self.fallen)
        self.enter("RISK_KILL_SWITCH", self.fallen, equity=equity)
        return True

    def liquidate(self) -> None:
        if self.c.margin_limit <= 0:
            return
        sizes = np.abs(self.s.positions * self.r.close) * self.c.lot_size
        while float(sizes @ self.rules.ratio) > self.c.margin_limit and self.s.positions.any():
            asset = int(np.where(self.s.positions != 0, sizes, np.inf).argmin())
            self.s.cash += self.worth(asset)
            self.s.positions[asset] = 0
            self.note("MARGIN_LIQUIDATION", sizes[asset], asset)
            sizes[asset] = 0.0

    def run(self) -> tuple[Events, dict]:
        """All rules in order; the events and the row's curve point."""
        s = self.s
        self.roll_futures()
        self.corporate_actions()
        self.carry()
        self.expire_options()
        self.close_session()
        if self.r.tradable and not s.halted:
            self.place_orders()
        if self.r.tradable and not s.halted:
            self.fill_orders()
        s.equity = s.cash + (self.marked() if self.c.mark_to_market else 0.0)
        point = {"row_idx": self.row, "ts": self.ts, "equity": s.equity, "positions": s.positions.tolist(), "adjustment": s.adjustment.tolist()}
        self.liquidate()
        self.watch(s.equity, self.c.max_drawdown_pct)
        s.max_drawdown = max(s.max_drawdown, self.fallen)
        if s.last_entry is not None:
            s.last_entry["equity_after"] = s.equity
        point["cash"] = s.cash
        s.next_row += 1
        return self.out, point


def load_snapshot(text: str, config: Config, ts: int) -> State:
    """The state of a run to go on with, from its JSON; that it was loaded is on record in the log."""
    state = State.from_json(text)
    n = len(state.positions)
    step = Step(state, Rules(config, n), Row(ts, False, *(np.zeros(n) for _ in range(6)), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool), np.zeros(n)))
    state.last_entry = None
    step.enter("SNAPSHOT_LOADED", state.next_row, equity=state.peak_equity)
    return state


def fold(rows, config: Config, state: State | None = None):
    """Fold ``(ts, tradable, cells)`` rows; yields ``(events, curve point, state)`` per row, and last the open log entry."""
    rules = None
    for ts, tradable, cells in rows:
        if state is None:
            state = State.start(len(cells), config)
        rules = rules or Rules(config, len(cells))
        events, point = Step(state, rules, Row.of(ts, tradable, cells)).run()
        yield events, point, state


def finish(state: State) -> list[dict]:
    """The log's last entry, which only the end of the run finishes."""
    return [state.last_entry] if state.last_entry is not None else []


# ---- Spark adapter

_INTEGERS = ("asset", "sequence", "order_id", "parent_order_id", "quantity", "remaining_quantity", "venue_id", "arrival_ts", "trade", "row_fills")
_DOUBLES = ("price", "fee", "gross_price", "maker_fee_bps", "taker_fee_bps", "net_price", "cash_after", "equity_after", "value", "arrival_price", "close", "drawdown", "traded", "bid", "ask", "volume", "extra")
_TEXTS = ("type", "order_type")
FILL_COLUMNS = (
    "ts", "order_id", "parent_order_id", "asset", "price", "quantity", "remaining_quantity", "fee", "venue_id", "gross_price", "maker_fee_bps", "taker_fee_bps", "net_price", "order_type",
    "arrival_ts", "arrival_price", "close", "bid", "ask", "volume", "extra",
)
AUDIT_COLUMNS = ("ts", "order_id", "parent_order_id", "asset", "type", "value")
LEDGER_COLUMNS = ("sequence", "ts", "order_id", "parent_order_id", "asset", "type", "quantity", "remaining_quantity", "price", "cash_after", "equity_after", "value")
_CURVE = ("cash_after", "equity_after", "quantity", "trade", "close", "drawdown", "traded", "row_fills")
_OF_KIND = {"fill": FILL_COLUMNS, "audit": AUDIT_COLUMNS, "ledger": LEDGER_COLUMNS, "curve": _CURVE}
_KINDS = dict.fromkeys(_TEXTS, "string") | dict.fromkeys(_INTEGERS, "bigint") | dict.fromkeys(_DOUBLES, "double")
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64()}
_MARKET = ("close", "high", "low", "volume", "bid", "ask")
#: Rows that the first look for a stretch without events takes, and the most.
_SHORT, _LONG = 32, 65_536


def run_rows(
    panel: DataFrame, run: Column, order: str = "ts", *, asset: Column | None = None, target: str = "target", order_type: Column | None = None, limit_price: Column | None = None,
    actions: Column | None = None, tradable: Column | None = None, extra: Column | None = None,
) -> DataFrame:
    """Panel rows as ``backtest`` takes them, one row an asset and time. ``asset`` numbers the assets of a run from 0; without it every run
    has one. ``order`` (a column, such as the time) orders the rows of a run; assets of one time are stepped together. Fills of runs of one
    asset carry ``extra``, a number of their row, along."""
    return panel.select(
        run.cast("string").alias("run_id"),
        F.col(order).alias("ord"),
        F.col("ts").cast("bigint").alias("ts"),
        (F.lit(0) if asset is None else asset).cast("int").alias("asset"),
        F.coalesce(F.lit(True) if tradable is None else tradable, F.lit(False)).alias("tradable"),
        *(F.col(f).cast("double").alias(f) for f in _MARKET),
        F.coalesce(F.col(target), F.lit(0)).cast("bigint").alias("target"),
        F.coalesce((F.lit(MARKET) if order_type is None else order_type) == LIMIT, F.lit(False)).alias("limited"),
        F.coalesce((F.lit(None) if limit_price is None else limit_price).cast("double"), F.lit(float("nan"))).alias("limit_price"),
        (F.lit(None) if actions is None else F.when(F.size(actions) > 0, actions)).cast("array<struct<kind:string,amount:double>>").alias("actions"),
        (F.lit(None) if extra is None else extra).cast("double").alias("extra"),
    )


def backtest(rows: DataFrame, config: Config = Config(), keep: tuple[str, ...] = ("fill", "audit", "ledger", "curve"), shared: bool = False) -> DataFrame:
    """Fold every run of ``rows`` (see ``run_rows``); one table of events, told apart by ``kind``, with the columns that the kinds to ``keep`` have.

    Runs are hashed over the tasks and sorted; a task takes its rows in Arrow batches and holds one state. A run is as
    sequential as its cash; parallelism comes from the runs. With ``shared`` the assets of a run share cash and rules: rows of one time are
    stepped together, and an asset without a bar is carried at its last close, without trading, and is nothing before its first. A
    curve point's ``quantity`` is the sum of the positions, ``trade`` its change in the row; ``close`` is known for runs of one asset. An empty table gives no rows; rows without run or time are ignored, a price
    that is not finite raises.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = _Fold(config, keep, shared)
        for batch in batches:
            if batch.num_rows:
                yield from fold.take(batch)
        yield from fold.end()

    laid = rows.where("run_id is not null and ts is not null").repartition(python_tasks(rows), "run_id")
    laid = laid.sortWithinPartitions("run_id", "ord", "asset").drop("ord")
    return laid.mapInArrow(walk, "run_id string, kind string, row_idx bigint, ts bigint, " + ", ".join(f"{c} {_KINDS[c]}" for c in _columns_of(keep)))


def _columns_of(keep: tuple[str, ...]) -> list[str]:
    """The columns that events of some kinds have, besides run, kind, row and time."""
    return [c for c in _KINDS if any(c in _OF_KIND[kind] for kind in keep)]


class _Fold:
    """Runs folded batch by batch: the open run's state, the rows of its last time if assets share it, and the events not yet handed on."""

    def __init__(self, config: Config, keep: tuple[str, ...], shared: bool) -> None:
        self.config, self.keep, self.shared = config, keep, shared
        self.run: str | None = None
        self.held: dict[str, np.ndarray] | None = None
        self.events: list[tuple] = []
        self.points: list[tuple] = []
        self.size = 0

    def take(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("ts", "asset", "tradable", *_MARKET, "target", "limited", "limit_price", "extra")}
        data["actions"] = np.empty(batch.num_rows, dtype=object)
        due = batch.column("actions")
        if due.null_count < batch.num_rows:
            for i in np.flatnonzero(due.is_valid().to_numpy(zero_copy_only=False)).tolist():
                data["actions"][i] = tuple((x["kind"], x["amount"]) for x in due[i].as_py())
        for f in _MARKET:
            if not np.isfinite(data[f].astype(float)).all():
                raise ValueError("market data contains non-finite values")
        words = batch.column("run_id").dictionary_encode()
        code = words.indices.to_numpy()
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
            name = words.dictionary[int(code[a])].as_py()
            if name != self.run:
                self._close_run()
                self.run, self.state, self.rules = name, State.start(0 if self.shared else 1, self.config), Rules(self.config, 0 if self.shared else 1)
                self.last = {f: np.zeros(0) for f in (*_MARKET, "limit_price")} | {"target": np.zeros(0, dtype=np.int64), "limited": np.zeros(0, dtype=bool)}
            part = {c: v[a:b] for c, v in data.items()}
            if self.shared:
                self._step_together(part)
            else:
                self._step_alone(part)
            if self.size >= 50_000:
                yield self._flush()

    def end(self) -> Iterator[pa.RecordBatch]:
        self._close_run()
        if self.size:
            yield self._flush()

    def _close_run(self) -> None:
        if self.run is None:
            return
        if self.held is not None:
            held, self.held = self.held, None
            self._one_time(held)
        self._emit("ledger", finish(self.state), self.state.next_row - 1)

    # -- runs of one asset

    def _step_alone(self, d: dict[str, np.ndarray]) -> None:
        c, s, rules = self.config, self.state, self.rules
        n = len(d["ts"])
        wanted = np.clip(d["target"], rules.least[0], rules.most[0])
        busy = np.array([x is not None for x in d["actions"]]) | np.isin(d["ts"], rules.dated)
        busy |= d["tradable"] & (wanted != d["target"])
        breaks = np.flatnonzero(busy | np.r_[False, wanted[1:] != wanted[:-1]] | np.r_[False, d["tradable"][1:] != d["tradable"][:-1]])
        value, gross = c.lot_size * d["close"], np.abs(wanted) * c.lot_size * d["close"]
        t, width = 0, _SHORT
        while t < n:
            position = int(s.positions[0])
            if not s.pending and not busy[t] and not rules.earn and (s.halted or not d["tradable"][t] or wanted[t] == position):
                k = int(np.searchsorted(breaks, t, side="right"))
                end = min(int(breaks[k]) if k < len(breaks) else n, t + width)
                part = slice(t, end)
                cost = -min(position, 0) * value[part] * rules.borrow
                cash = s.cash - np.cumsum(cost) if rules.borrow and position < 0 else np.full(end - t, s.cash)
                equity = cash + position * value[part] if c.mark_to_market else cash
                peak = np.maximum(np.maximum.accumulate(equity), s.peak_equity)
                fallen = np.where(peak > 0, (peak - equity) / np.where(peak > 0, peak, 1.0), 0.0)
                event = np.zeros(end - t, dtype=bool)
                if not s.halted:
                    event |= fallen > c.max_drawdown_pct
                    event |= d["tradable"][part] & (gross[part] > c.max_gross_leverage * np.maximum(1.0, cash))
                if c.margin_limit > 0:
                    event |= abs(position) * value[part] * rules.ratio[0] > c.margin_limit
                calm = int(event.argmax()) if event.any() else end - t
                width = min(width * 2, _LONG) if calm == end - t else _SHORT
                if calm:
                    if "curve" in self.keep:
                        at = slice(t, t + calm)
                        self.points.append((self.run, np.arange(s.next_row, s.next_row + calm), d["ts"][at], cash[:calm], equity[:calm], np.full(calm, position), np.zeros(calm), d["close"][at], fallen[:calm], np.zeros(calm), np.zeros(calm)))
                        self.size += calm
                    s.cash, s.equity, s.peak_equity = float(cash[calm - 1]), float(equity[calm - 1]), float(peak[calm - 1])
                    s.max_drawdown = max(s.max_drawdown, float(fallen[:calm].max()))
                    s.total_borrow_cost += float(cost[:calm].sum())
                    s.next_row += calm
                    if s.last_entry is not None:
                        s.last_entry["equity_after"] = s.equity
                    t += calm
                    continue
            one = slice(t, t + 1)
            actions = tuple((0, kind, amount) for kind, amount in d["actions"][t] or ())
            self._step(Row(int(d["ts"][t]), bool(d["tradable"][t]), *(d[f][one] for f in _MARKET), d["target"][one], d["limited"][one], d["limit_price"][one], actions), d["extra"][t])
            t += 1

    # -- runs whose assets share cash

    def _step_together(self, d: dict[str, np.ndarray]) -> None:
        if self.held is not None:
            d = {c: np.concatenate([self.held[c], v]) for c, v in d.items()}
        edges = np.flatnonzero(np.r_[True, d["ts"][1:] != d["ts"][:-1]])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            self._one_time({c: v[a:b] for c, v in d.items()})
        self.held = {c: v[edges[-1] :] for c, v in d.items()}  # the next batch may have more of its last time

    def _one_time(self, d: dict[str, np.ndarray]) -> None:
        asset, last = d["asset"], self.last
        most = int(asset.max()) + 1
        if most > self.rules.assets:
            self.state.grow(most)
            self.rules = Rules(self.config, most)
            for f, v in last.items():
                last[f] = np.append(v, np.zeros(most - len(v), dtype=v.dtype))
        for f in last:
            last[f][asset] = d[f]
        s, rules, c = self.state, self.rules, self.config
        actions = tuple((int(i), kind, amount) for i, due in zip(asset, d["actions"]) for kind, amount in due or ())
        wanted = np.clip(last["target"], rules.least, rules.most)
        still = (wanted[asset] == s.positions[asset]) & (wanted[asset] == d["target"])
        if not (s.pending or actions or rules.borrow or rules.earn or len(rules.dated) or c.margin_limit > 0) and still.all():
            equity = s.cash + (float(s.positions @ last["close"]) * c.lot_size if c.mark_to_market else 0.0)
            peak = max(s.peak_equity, equity)
            fallen = (peak - equity) / peak if peak > 0 else 0.0
            if s.halted or (fallen <= c.max_drawdown_pct and float(np.abs(wanted) @ last["close"]) * c.lot_size <= c.max_gross_leverage * max(1.0, s.cash)):
                self._carried(int(d["ts"][0]), equity, peak, fallen)
                return
        self._step(Row(int(d["ts"][0]), bool(d["tradable"].all()), *(last[f] for f in _MARKET), last["target"], last["limited"], last["limit_price"], actions, np.unique(asset)))

    def _carried(self, ts: int, equity: float, peak: float, fallen: float) -> None:
        """A time at which nothing can happen but marking."""
        s = self.state
        if "curve" in self.keep:
            self.points.append((self.run, *(np.array([x]) for x in (s.next_row, ts, s.cash, equity, int(s.positions.sum()), 0, np.nan, fallen, 0.0, 0))))
            self.size += 1
        s.equity, s.peak_equity, s.max_drawdown = equity, peak, max(s.max_drawdown, fallen)
        s.next_row += 1
        if s.last_entry is not None:
            s.last_entry["equity_after"] = equity

    # -- events

    def _step(self, row: Row, extra: float | None = None) -> None:
        at, before = self.state.next_row, int(self.state.positions.sum())
        step = Step(self.state, self.rules, row)
        events, point = step.run()
        for f in events.fills:
            f["extra"] = None if extra is None or extra != extra else float(extra)
        self._emit("fill", events.fills, at)
        self._emit("audit", events.audit, at)
        self._emit("ledger", events.ledger, at)
        if "curve" in self.keep:
            now = sum(point["positions"])
            close = np.nan if self.shared else float(row.close[0])
            traded = sum(abs(f["quantity"]) * f["price"] for f in events.fills)
            self.points.append((self.run, *(np.array([x]) for x in (at, row.ts, point["cash"], point["equity"], now, now - before, close, step.fallen, traded, len(events.fills)))))
            self.size += 1

    def _emit(self, kind: str, records: list[dict], row: int) -> None:
        if kind in self.keep and records:
            self.events.extend((self.run, kind, row, r) for r in records)
            self.size += len(records)

    def _flush(self) -> pa.RecordBatch:
        events, points = self.events, self.points
        sizes = np.array([len(p[1]) for p in points], dtype=int)
        after = int(sizes.sum())
        joined = lambda i, kind: np.concatenate([p[i] for p in points]).astype(kind) if points else np.zeros(0, dtype=kind)
        whose = np.repeat(np.array([p[0] for p in points], dtype=object), sizes)
        columns = {
            "run_id": pa.concat_arrays([pa.array([e[0] for e in events], pa.string()), pa.array(whose, pa.string())]),
            "kind": pa.concat_arrays([pa.array([e[1] for e in events], pa.string()), pa.repeat(pa.scalar("curve"), after)]),
            "row_idx": pa.array(np.append(np.array([e[2] for e in events], dtype="int64"), joined(1, "int64"))),
            "ts": pa.array(np.append(np.array([e[3]["ts"] for e in events], dtype="int64"), joined(2, "int64"))),
        }
        for c in _columns_of(self.keep):
            kind = _ARROW[_KINDS[c]]
            own = pa.array([e[3].get(c) for e in events], kind)
            of_points = pa.array(joined(3 + _CURVE.index(c), "int64" if _KINDS[c] == "bigint" else "float64"), kind) if c in _CURVE else pa.nulls(after, kind)
            columns[c] = pa.concat_arrays([own, of_points])
        self.events, self.points, self.size = [], [], 0
        return pa.RecordBatch.from_pydict(columns)


def events_of(events: DataFrame, kind: str) -> DataFrame:
    """The fills, audit entries, ledger entries or curve points among events, with the columns of their kind."""
    columns = {"fill": FILL_COLUMNS, "audit": AUDIT_COLUMNS, "ledger": LEDGER_COLUMNS}.get(kind)
    rows = events.where(F.col("kind") == kind)
    if columns is None:
        return rows.select("run_id", "row_idx", "ts", F.col("equity_after").alias("equity"), F.col("cash_after").alias("cash"), F.col("quantity").alias("position"), "trade", "close", "drawdown", "traded", "row_fills")
    return rows.select("run_id", "row_idx", *columns)
