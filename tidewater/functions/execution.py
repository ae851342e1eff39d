"""Execution arithmetic as column expressions: clamps, slippage, reference prices, venues, latency, capacity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp_target(target: Column, default_max: int, asset_max: Column | None = None, allow_short: bool = True) -> Column:
    """The target within the asset's limit (where that is above zero, else the default); never short if not allowed."""
    most = F.lit(default_max) if asset_max is None else F.when(asset_max > 0, asset_max).otherwise(default_max)
    return F.least(F.greatest(target, -most if allow_short else F.lit(0)), most).cast("bigint")


def slippage_price(base: Column, quantity: Column, participation: Column, model: str, bps: float, impact: float = 0.05) -> Column:
    """``base`` moved against the order's side: ``none``, ``fixed`` bps, or bps growing with participation squared."""
    if model == "none":
        return base
    moved = F.lit(bps)
    if model == "volume_share":
        moved = moved + impact * 10_000.0 * participation * participation
    return F.when(quantity == 0, base).otherwise(base * (1.0 + F.signum(quantity.cast("double")) * moved * 1e-4))


def execution_price(order_type: Column, quantity: Column, close: Column, bid: Column, ask: Column, limit: Column, use_quotes: bool) -> Column:
    """Reference price of a fill: close or the quote on the other side; a limit order gets its limit if that is better."""
    buying = quantity > 0
    market = F.when(buying, ask).otherwise(bid) if use_quotes else close
    limited = F.when(buying, F.least(market, limit)).otherwise(F.greatest(market, limit))
    return F.when((order_type == "market") | limit.isNull(), market).otherwise(limited)


def limit_touched(quantity: Column, high: Column, low: Column, limit: Column) -> Column:
    """Whether the bar's range reaches the limit; without a limit price never."""
    return F.coalesce(F.when(quantity > 0, low <= limit).otherwise(high >= limit), F.lit(False))


def fee(notional: Column, bps: float) -> Column:
    return notional * bps * 1e-4


def daily_rate(annual_bps: float) -> float:
    """An annual rate in basis points per row, at 252 rows a year whatever the bars' length."""
    return annual_bps * 1e-4 / 252.0


def fill_probability(curve: Column, queue_ahead: Column | float) -> Column:
    """The curve's value at the queue's place, within 0 and 1; 1 without a curve."""
    place = F.floor(F.lit(queue_ahead) * (F.size(curve) - 1)).cast("int")
    place = F.greatest(F.lit(0), F.least(place, F.size(curve) - 1))
    value = F.least(F.greatest(F.get(curve, place), F.lit(0.0)), F.lit(1.0))
    return F.when(F.size(curve) > 0, value).otherwise(1.0)


def latency_price(price: Column, quantity: Column, volatility: Column, latency_us: int, drift: str = "gbm", threshold: float = 0.0, penalty_bps: float = 0.0) -> Column:
    """The price after the market moved on for ``latency_us``, against the order; plus a penalty in fast markets."""
    if latency_us <= 0 and penalty_bps == 0.0:
        return price
    side = F.when(quantity >= 0, 1.0).otherwise(-1.0)
    move = side * F.abs(volatility) * (max(latency_us / (1e6 * 86_400.0), 0.0) ** 0.5)
    out = price
    if drift == "gbm":
        out = F.when(volatility > 0, price * F.exp(move)).otherwise(price)
    elif drift == "empirical":
        out = F.when(volatility > 0, price * (1.0 + move)).otherwise(price)
    if threshold > 0:
        out = F.when(F.abs(volatility) > threshold, out * (1.0 + side * penalty_bps * 1e-4)).otherwise(out)
    return out


def venue_capacity(volume: Column, share_cap: float = 1.0, queue_ahead: float = 0.0) -> Column:
    v = F.greatest(volume, F.lit(0.0))
    return F.greatest(v * share_cap - v * queue_ahead, F.lit(0.0))


def most_fillable(volume: Column, participation: float = 0.25, share_cap: float = 1.0, queue_ahead: float = 0.0) -> Column:
    """Whole lots that a bar can fill: 0 if the venue's capacity is below one (the order waits)."""
    capacity = venue_capacity(volume, share_cap, queue_ahead)
    fill = F.floor(F.least(F.greatest(volume, F.lit(0.0)) * participation, capacity))
    return F.when(capacity < 1, 0).otherwise(fill).cast("bigint")
