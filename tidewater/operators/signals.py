"""Trading signals as windows over a symbol's bars, and ranks across the symbols of one bar time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.asknown import as_known_join
from tidewater.operators.panel import TICK_BUCKET_NS, simple_return, sliced_returns
from tidewater.operators.sliced import SLICE_ROWS, by_slice, own_rows, running, with_halo

#: Differences of averages below this are ties; sums of many doubles carry such noise.
TIE_DIGITS = 9


def _volatility(sliced: DataFrame, window: int, grown: bool = True) -> DataFrame:
    vol = F.stddev_pop("ret").over(by_slice().rowsBetween(-(window - 1), 0))
    if grown:
        vol = F.when(F.col("row_idx") >= window, vol).otherwise(0.0)
    return sliced_returns(sliced).withColumn("volatility", vol)


def _momentum(sliced: DataFrame, lookback: int, max_position: int) -> DataFrame:
    change = F.col("close") - F.lag("close", lookback).over(by_slice())
    return sliced.withColumn("target", (F.signum(F.coalesce(change, F.lit(0.0))) * max_position).cast("bigint"))


def crossover_in_slices(sliced: DataFrame, fast: int, slow: int, max_position: int = 1, series: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """``moving_average_crossover`` on a panel in slices; ``slow`` rows before a slice make the target right from the row before it on."""
    w = by_slice(*series)
    gap = crossover_target(F.avg("close").over(w.rowsBetween(1 - fast, 0)), F.avg("close").over(w.rowsBetween(1 - slow, 0)), max_position)
    return sliced.withColumn("target", F.when(F.col("row_idx") >= slow - 1, gap).otherwise(0))


def volatility_in_slices(sliced: DataFrame, window: int) -> DataFrame:
    """``expanding_volatility`` on a panel in slices."""
    return _volatility(sliced, max(2, window), grown=False)


def rolling_volatility(panel: DataFrame, window: int) -> DataFrame:
    """Adds ``ret`` and ``volatility``: population deviation of the last ``window`` returns, 0 before row ``window``."""
    return own_rows(_volatility(with_halo(panel, window), window))


def expanding_volatility(panel: DataFrame, window: int) -> DataFrame:
    """Adds ``volatility`` as cost analysis takes it: the frame grows to ``max(2, window)`` rows, first return included."""
    return own_rows(volatility_in_slices(with_halo(panel, max(2, window)), window))


def momentum(panel: DataFrame, lookback: int, max_position: int = 1) -> DataFrame:
    """Adds ``target``: the sign of the change over ``lookback`` rows times ``max_position``, 0 before."""
    return own_rows(_momentum(with_halo(panel, lookback), lookback, max_position))


def mean_reversion(panel: DataFrame, lookback: int, max_position: int = 1) -> DataFrame:
    """Momentum with the opposite sign."""
    return momentum(panel, lookback, -max_position)


def crossover_target(fast: Column, slow: Column, max_position: int) -> Column:
    """Sign of the gap of two averages; gaps within float noise are ties."""
    return (F.signum(F.round(fast - slow, TIE_DIGITS)) * max_position).cast("bigint")


def moving_average_crossover(panel: DataFrame, fast: int, slow: int, max_position: int = 1) -> DataFrame:
    """Adds ``target``: the sign of fast average minus slow average from row ``slow - 1`` on. Both share one sort."""
    if not 0 < fast < slow:
        raise ValueError("fast must be positive and less than slow")
    return own_rows(crossover_in_slices(with_halo(panel, slow - 1), fast, slow, max_position))


def volatility_filtered_momentum(panel: DataFrame, lookback: int, window: int, ceiling: float, max_position: int = 1) -> DataFrame:
    """Momentum, 0 where volatility exceeds ``ceiling``."""
    out = _momentum(_volatility(with_halo(panel, max(lookback, window)), window), lookback, max_position)
    return own_rows(out.withColumn("target", F.when(F.col("volatility") > ceiling, 0).otherwise(F.col("target"))))


def cross_sectional_rank(panel: DataFrame, value: str, descending: bool = True) -> DataFrame:
    """Adds ``rank``: 1 to N among the symbols with a bar at the same time; ties go by symbol."""
    key = F.col(value).desc() if descending else F.col(value).asc()
    return panel.withColumn("rank", F.row_number().over(Window.partitionBy("ts").orderBy(key, "symbol")))


def cross_sectional_momentum(panel: DataFrame, lookback: int, winners: int, losers: int, max_position: int = 1) -> DataFrame:
    """Adds ``target``: long the best and short the worst symbols of each time by return over ``lookback`` rows.

    The return is 0 before ``lookback`` rows, and such rows trade as well; ties go by symbol.
    """
    score = simple_return(F.lag("close", lookback).over(by_slice()), F.col("close"))
    best, worst = (Window.partitionBy("ts").orderBy(k, "symbol") for k in (F.col("score").desc(), F.col("score").asc()))
    out = own_rows(with_halo(panel, lookback).withColumn("score", score))
    target = F.when(F.row_number().over(best) <= winners, max_position).when(F.row_number().over(worst) <= losers, -max_position)
    return out.withColumn("target", target.otherwise(0).cast("bigint"))


def inverse_variance_weights(panel: DataFrame, window: int, ridge: float = 1e-6, leverage: float = 1.0) -> DataFrame:
    """Adds ``weight``: inverse variance, scaled so that the weights of one bar time sum to ``leverage``."""
    out = rolling_volatility(panel, window).withColumn("raw", 1.0 / F.greatest(F.col("volatility") * F.col("volatility"), F.lit(ridge)))
    return out.withColumn("weight", F.col("raw") / F.sum("raw").over(Window.partitionBy("ts")) * leverage).drop("raw")


def weights_to_positions(weight: Column, gross: float) -> Column:
    """Whole positions, halves to the even neighbour. Noise of the weights' sums is rounded off first."""
    return F.rint(F.round(weight * gross, TIE_DIGITS)).cast("bigint")


def fill_forward_intents(rows: DataFrame, intent: str = "intent") -> DataFrame:
    """Adds ``held``: the last non-null intent struct of the symbol, carried forward as a whole."""
    sliced = rows.withColumn("slice", F.floor(F.col("row_idx") / SLICE_ROWS).cast("bigint"))
    return running(sliced, ("symbol",), "slice", ("row_idx",), {"held": ("last", F.col(intent))}).drop("slice")


def carried_quotes(ticks: DataFrame) -> DataFrame:
    """Adds ``best_bid`` and ``best_ask``: the symbol's latest quotes, this tick's price before the first one."""
    sliced = ticks.withColumn("slice", F.floor(F.col("timestamp_ns") / F.lit(TICK_BUCKET_NS)).cast("bigint"))
    quotes = {f"best_{side}": ("last", F.when(F.col("side") == side.upper(), F.col("price"))) for side in ("bid", "ask")}
    out = running(sliced, ("symbol",), "slice", ("timestamp_ns", "src_order"), quotes).drop("slice")
    return out.withColumns({q: F.coalesce(q, "price") for q in quotes})


def adjustment_factors(panel: DataFrame, splits: DataFrame) -> DataFrame:
    """Adds ``adjustment``: the product of 1 / ratio over the symbol's splits gone ex by the bar's time.

    The running product after each split, one row a split, is joined as the attribute in force at each bar's time. Equal
    copies of a split count once.
    """
    each = splits.select("symbol", F.col("ex_date_timestamp").alias("ex"), F.col("ratio_or_amount").alias("ratio")).where("symbol is not null and ex is not null").distinct()
    steps = each.groupBy("symbol", "ex").agg(F.sum(-F.log("ratio")).alias("step"))
    so_far = F.sum("step").over(Window.partitionBy("symbol").orderBy("ex").rowsBetween(Window.unboundedPreceding, 0))
    states = steps.select("symbol", "ex", so_far.alias("log_factor"))
    known = as_known_join(panel, states, effective="ex", known="ex", tie="ex", attributes=("log_factor",)).select("symbol", "ts", "log_factor")
    return panel.join(known, ["symbol", "ts"], "left").withColumn("adjustment", F.exp(F.coalesce("log_factor", F.lit(0.0)))).drop("log_factor")


def target_in_slices(sliced: DataFrame, name: str, series: tuple[str, ...] = ("symbol",), **params) -> tuple[Column, int]:
    """The target of a policy that looks at one series only, as a column of a panel in slices with returns, and how many rows back it looks."""
    most, w, row = params.get("max_position", 1), by_slice(*series), F.col("row_idx")
    if name == "moving_average_crossover":
        fast, slow = params["fast"], params["slow"]
        gap = crossover_target(F.avg("close").over(w.rowsBetween(1 - fast, 0)), F.avg("close").over(w.rowsBetween(1 - slow, 0)), most)
        return F.when(row >= slow - 1, gap).otherwise(F.lit(0)).cast("bigint"), slow
    lookback = params["lookback"]
    moved = F.coalesce(F.col("close") - F.lag("close", lookback).over(w), F.lit(0.0))
    target = (F.signum(moved) * (-most if name == "mean_reversion" else most)).cast("bigint")
    if name == "volatility_filtered_momentum":
        window = params["window"]
        calm = F.when(row >= window, F.stddev_pop("ret").over(w.rowsBetween(1 - window, 0))).otherwise(0.0) <= params["ceiling"]
        return F.when(calm, target).otherwise(F.lit(0)).cast("bigint"), max(lookback, window + 1)
    return target, lookback


#: Policies that look at one series only.
OF_ONE_SERIES = ("momentum", "mean_reversion", "moving_average_crossover", "volatility_filtered_momentum")

POLICIES: dict[str, Callable[..., DataFrame]] = {
    "momentum": momentum,
    "mean_reversion": mean_reversion,
    "moving_average_crossover": moving_average_crossover,
    "volatility_filtered_momentum": volatility_filtered_momentum,
    "cross_sectional_momentum": cross_sectional_momentum,
}


def apply_policy(panel: DataFrame, name: str, **params) -> DataFrame:
    """The targets of a policy by name; ``minimum_variance`` takes ``gross_target`` besides the weights' parameters."""
    if name == "minimum_variance":
        gross = params.pop("gross_target", 1)
        out = inverse_variance_weights(panel, **params)
        return out.withColumn("target", weights_to_positions(F.col("weight"), gross))
    if name not in POLICIES:
        raise ValueError(f"unknown policy {name!r}; known are {', '.join(sorted([*POLICIES, 'minimum_variance']))}")
    return POLICIES[name](panel, **params)
