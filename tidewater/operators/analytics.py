"""Equity curves, risk and performance figures, attribution, trade statistics and reports, all as aggregations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.panel import BUCKET_SECONDS
from tidewater.operators.sliced import running

YEAR_SECONDS = 365.25 * 86_400.0
#: Rows up to which a group's distinct values are ordered whole.
SMALL_GROUP = 10_000
#: Accuracy of the sketch that brackets a percentile; its error, one in so many, must be within the margin.
ACCURACY = 20_000
#: Means and deviations of returns within this are none.
NOISE = 1e-12
#: Times below this number steps instead of seconds.
STEP_NUMBERS = 10_000_000


def equity_from_ledger(ledger: DataFrame) -> DataFrame:
    """Last ``equity_after`` per symbol and time, and the gain since the first."""
    curve = ledger.groupBy("symbol", "ts").agg(F.max_by("equity_after", "sequence").alias("equity"))
    start = curve.groupBy("symbol").agg(F.min_by("equity", "ts").alias("start"))
    return curve.join(start, "symbol").withColumn("pnl", F.col("equity") - F.col("start")).drop("start")


def daily_equity(curve: DataFrame) -> DataFrame:
    """Last equity per symbol and UTC day: ``symbol, epoch_day, equity``.

    Times are epoch numbers whose unit their magnitude tells (``timestamp_scale``); those of a symbol that are all below STEP_NUMBERS are
    steps, of which each is a day of its own.
    """
    curve = curve.join(curve.groupBy("symbol").agg(F.max(F.abs("ts")).alias("largest_ts")), "symbol")
    largest = F.col("largest_ts")
    day = F.when(largest < STEP_NUMBERS, F.col("ts")).otherwise(F.floor(F.col("ts") / (86_400 * timestamp_scale(largest)))).cast("bigint").alias("epoch_day")
    return curve.groupBy("symbol", day).agg(F.max_by("equity", "ts").alias("equity"))


def drawdowns(curve: DataFrame, by: str = "symbol", order: str = "ts") -> DataFrame:
    """Adds the running ``peak`` and the ``drawdown`` from it, 0 where the peak is 0."""
    sliced = curve.withColumn("slice", F.floor(F.col(order) / BUCKET_SECONDS).cast("bigint"))
    out = running(sliced, (by,), "slice", (order,), {"peak": ("max", F.col("equity"))}).drop("slice")
    return out.withColumn("drawdown", F.coalesce(F.try_divide(F.col("peak") - F.col("equity"), F.col("peak")), F.lit(0.0)))


def _ratio(mean: Column, deviation: Column) -> Column:
    """Mean over deviation a year; infinite with the mean's sign where nothing deviates, 0 without either."""
    inf = F.lit(float("inf"))
    flat = F.when(mean > NOISE, inf).when(mean < -NOISE, -inf).otherwise(0.0)
    return F.when(deviation > NOISE, F.try_divide(mean, deviation) * (252.0**0.5)).otherwise(flat)


def sharpe_and_sortino(ret: Column) -> tuple[Column, Column]:
    """Both ratios as aggregations of returns a day, 0 without returns. Deviations within float noise are none."""
    zero = F.lit(0.0)
    mean, deviation, below = F.avg(ret), F.stddev_pop(ret), F.sqrt(F.avg(F.pow(F.least(ret, zero), F.lit(2.0))))
    return F.coalesce(_ratio(mean, deviation), zero), F.coalesce(_ratio(mean, below), zero)


def sharpe_sortino(daily: DataFrame, by: tuple[str, ...] = ("symbol",), order: str = "epoch_day") -> DataFrame:
    """Sharpe and Sortino ratio of the returns of a daily equity curve, 0 without returns."""
    w = Window.partitionBy(*by).orderBy(order)
    ret = F.coalesce(F.try_divide(F.col("equity"), F.lag("equity").over(w)) - 1, F.lit(0.0))
    rows = daily.withColumn("n", F.row_number().over(w)).withColumn("ret", F.when(F.col("n") > 1, ret))
    sharpe, sortino = sharpe_and_sortino(F.col("ret"))
    return rows.groupBy(*by).agg(sharpe.alias("sharpe"), sortino.alias("sortino"))


def timestamp_scale(largest: Column) -> Column:
    """Units a second of epoch numbers, guessed from their magnitude."""
    return F.when(largest > 1e17, 1e9).when(largest > 1e14, 1e6).when(largest > 1e11, 1e3).otherwise(1.0)


def years_of(first: Column, last: Column, largest: Column, rows: Column) -> Column:
    """Years a curve spans: small numbers are steps of 252 a year, others epoch numbers; at least one step."""
    day = F.lit(1.0 / 252.0)
    steps, elapsed = (last - first) / 252.0, (last - first) / timestamp_scale(largest) / YEAR_SECONDS
    by_rows = F.when(rows > 1, (rows - 1) / 252.0).otherwise(day)
    return F.when(last > first, F.greatest(F.when(largest < STEP_NUMBERS, steps).otherwise(elapsed), day)).otherwise(by_rows)


def cagr(start: Column, end: Column, years: Column) -> Column:
    """Yearly growth, 0 where either end is not positive."""
    return F.when((start <= 0) | (end <= 0), 0.0).otherwise(F.pow(end / start, 1.0 / years) - 1.0)


def calmar(growth: Column, drawdown: Column) -> Column:
    """Growth over the largest drawdown; without one infinite if there is growth, else 0."""
    return F.when(drawdown == 0, F.when(growth > 0, F.lit(float("inf"))).otherwise(0.0)).otherwise(F.try_divide(growth, drawdown))


def summarize(curve: DataFrame, fills: DataFrame) -> DataFrame:
    """Per symbol: CAGR, largest drawdown, Calmar, turnover a year, gain, ending equity, fills, Sharpe and Sortino.

    ``curve`` is the ledger's or the full equity curve (``symbol, ts, equity``), as asked.
    """
    start, end = F.min_by("equity", "ts"), F.max_by("equity", "ts")
    stats = drawdowns(curve).groupBy("symbol").agg(
        start.alias("start_equity"),
        end.alias("ending_equity"),
        F.max("drawdown").alias("max_drawdown"),
        F.avg(F.abs("equity")).alias("mean_equity"),
        years_of(F.min("ts"), F.max("ts"), F.max(F.abs("ts")), F.count(F.lit(1))).alias("years"),
    )
    traded = fills.groupBy("symbol").agg(F.sum(F.abs(F.col("quantity") * F.col("price"))).alias("gross"), F.count(F.lit(1)).alias("fill_count"))
    out = stats.join(traded, "symbol", "left").join(sharpe_sortino(daily_equity(curve)), "symbol")
    out = out.withColumn("cagr", cagr(F.col("start_equity"), F.col("ending_equity"), F.col("years")))
    return out.select(
        "symbol",
        "sharpe",
        "sortino",
        "cagr",
        "max_drawdown",
        calmar(F.col("cagr"), F.col("max_drawdown")).alias("calmar"),
        (F.coalesce(F.try_divide("gross", "mean_equity"), F.lit(0.0)) / F.col("years")).alias("turnover_per_year"),
        F.coalesce("fill_count", F.lit(0)).alias("fill_count"),
        (F.col("ending_equity") - F.col("start_equity")).alias("pnl"),
        "ending_equity",
    )


def pnl_attribution(fills: DataFrame) -> DataFrame:
    """Cash that each symbol's fills brought in: no mark of open positions."""
    return fills.groupBy("symbol").agg(F.sum(-F.col("quantity") * F.col("price") - F.col("fee")).alias("pnl"))


def trade_stats(fills: DataFrame) -> DataFrame:
    """Win rate, average win and loss and profit factor per symbol, by matching fills in order at average cost.

    The opening fee is not counted, the closing fee is; a flip opens at the fill's price. Fills stream through a task in order, which holds one
    symbol's position and sums at a time.
    """

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, held, cost, sums = None, 0.0, 0.0, [0.0, 0.0, 0, 0, 0]
        for pdf in batches:
            done = []
            for name, q, price, fee in zip(*(pdf[c] for c in ("symbol", "quantity", "price", "fee"))):
                if name != symbol:
                    if symbol is not None:
                        done.append((symbol, *sums))
                    symbol, held, cost, sums = name, 0.0, 0.0, [0.0, 0.0, 0, 0, 0]
                if held * q >= 0:
                    cost = (abs(held) * cost + abs(q) * price) / (abs(held) + abs(q))
                else:
                    gain = min(abs(held), abs(q)) * (price - cost) * (1 if held > 0 else -1) - fee
                    sums = [sums[0] + max(gain, 0.0), sums[1] + max(-gain, 0.0), sums[2] + (gain > 0), sums[3] + (gain < 0), sums[4] + 1]
                    if abs(q) > abs(held):
                        cost = price
                held += q
            if done:
                yield pd.DataFrame(done, columns=_MATCHED)
        if symbol is not None:
            yield pd.DataFrame([(symbol, *sums)], columns=_MATCHED)

    ordered = fills.where("symbol is not null and quantity != 0").repartition("symbol").sortWithinPartitions("symbol", "order_id")
    s = ordered.select("symbol", F.col("quantity").cast("double").alias("quantity"), "price", "fee").mapInPandas(match, "symbol string, won double, lost double, wins bigint, losses bigint, closed bigint")
    return s.select(
        "symbol",
        "closed",
        F.coalesce(F.try_divide("wins", "closed"), F.lit(0.0)).alias("win_rate"),
        F.coalesce(F.try_divide("won", "wins"), F.lit(0.0)).alias("avg_win"),
        F.coalesce(-F.try_divide("lost", "losses"), F.lit(0.0)).alias("avg_loss"),
        F.when(F.col("lost") > 0, F.try_divide("won", "lost")).when(F.col("won") > 0, F.lit(float("inf"))).otherwise(0.0).alias("profit_factor"),
    )


_MATCHED = ["symbol", "won", "lost", "wins", "losses", "closed"]


def replay_ledger(ledger: DataFrame) -> DataFrame:
    """Per symbol: entries, distinct orders and parents, fills, last cash and equity of the log. The ids themselves: ``replayed_ids``."""
    return ledger.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("entries"),
        F.countDistinct(F.when(F.col("order_id") != 0, F.col("order_id"))).alias("orders"),
        F.countDistinct(F.when(F.col("parent_order_id") != 0, F.col("parent_order_id"))).alias("parents"),
        F.count_if(F.upper("type").contains("FILL_APPLIED")).alias("fills"),
        F.max_by("cash_after", "sequence").alias("final_cash"),
        F.max_by("equity_after", "sequence").alias("final_equity"),
    )


def replayed_ids(ledger: DataFrame) -> DataFrame:
    """The order and parent ids of each symbol's log, a row an id, with the entry at which each is seen first: ``symbol, kind, id, first_seen``."""
    ids = F.explode(F.array(F.struct(F.lit("order").alias("kind"), F.col("order_id").alias("id")), F.struct(F.lit("parent").alias("kind"), F.col("parent_order_id").alias("id"))))
    return ledger.select("symbol", "sequence", ids.alias("i")).where("i.id != 0").groupBy("symbol", "i.kind", "i.id").agg(F.min("sequence").alias("first_seen"))


def exact_percentiles(df: DataFrame, by: list[str], value: str, quantiles: tuple[float, ...], margin: float = 2e-4) -> DataFrame:
    """Exact, linearly interpolated percentiles per group, without holding a group in one task.

    A sketch brackets each percentile to a share of ``2 * margin`` of the rows; one pass counts the values below each bracket, and only
    distinct values inside, with their counts, are ordered. Groups of at most SMALL_GROUP rows need no bracket. Null and NaN values are left out.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*(F.col(b).alias(f"by_{i}") for i, b in enumerate(by)), F.col(value).alias("v"))
    names, by = by, [f"by_{i}" for i in range(len(by))]
    edges = [e for q in quantiles for e in (max(q - margin, 0.0), min(q + margin, 1.0))]
    sketch = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", edges, ACCURACY).alias("edges"), F.min("v").alias("least"), F.max("v").alias("most"))
    small = F.col("n") <= SMALL_GROUP
    ends = {}
    for i in range(len(quantiles)):
        ends[f"lo_{i}"] = F.when((F.lit(edges[2 * i]) <= 0) | small, F.col("least")).otherwise(F.get("edges", F.lit(2 * i)))
        ends[f"hi_{i}"] = F.when((F.lit(edges[2 * i + 1]) >= 1) | small, F.col("most")).otherwise(F.get("edges", F.lit(2 * i + 1)))
    wanted = sketch.select(*by, "n", *(e.alias(c) for c, e in ends.items()))
    on = F.lit(True)
    for b in by:
        on = on & F.col(f"r.{b}").eqNullSafe(F.col(f"w.{b}"))
    met = rows.alias("r").join(wanted.alias("w"), on)
    keys = [F.col(f"w.{b}").alias(b) for b in by]
    under = met.groupBy(*keys, "n").agg(*(F.count_if(F.col("v") < F.col(f"lo_{i}")).alias(f"under_{i}") for i in range(len(quantiles))))
    under = under.select(*by, "n", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(q).alias("q"), F.col(f"under_{i}").alias("under")) for i, q in enumerate(quantiles)))).alias("u")).select(*by, "n", "u.*")
    inside = F.array_compact(F.array(*(F.when((F.col("v") >= F.col(f"lo_{i}")) & (F.col("v") <= F.col(f"hi_{i}")), F.lit(i)) for i in range(len(quantiles)))))
    counted = met.where(F.size(inside) > 0).select(*keys, F.explode(inside).alias("i"), F.col("v").alias("x")).groupBy(*by, "i", "x").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy(*by, "i").orderBy("x")
    counted = counted.withColumn("within", F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    same = F.lit(True)
    for b in [*by]:
        same = same & F.col(f"c.{b}").eqNullSafe(F.col(f"u.{b}"))
    counted = counted.alias("c").join(under.alias("u"), same & (F.col("c.i") == F.col("u.i"))).select(*(F.col(f"c.{b}").alias(b) for b in by), F.col("c.i").alias("i"), "x", (F.col("within") + F.col("under")).alias("upto"), (F.col("q") * (F.col("n") - 1)).alias("rank"))
    low = F.min(F.when(F.col("x").isNotNull() & (F.col("upto") > F.floor("rank")), F.col("x")))
    high = F.min(F.when(F.col("x").isNotNull() & (F.col("upto") > F.ceil("rank")), F.col("x")))
    each = counted.groupBy(*by, "i", "rank").agg(low.alias("a"), high.alias("b"))
    values = each.withColumn("p", F.col("a") + (F.coalesce("b", "a") - F.col("a")) * (F.col("rank") - F.floor("rank")))
    out = values.groupBy(*by).agg(*(F.max(F.when(F.col("i") == i, F.col("p"))).alias("p" + f"{q * 100:g}".replace(".", "_")) for i, q in enumerate(quantiles)))
    return out.withColumnsRenamed(dict(zip(by, names)))


def curve_stats(curve: DataFrame, by: str = "symbol") -> DataFrame:
    """Count, mean, deviation, least, median, 95th and 99th percentile and greatest equity per run."""
    basic = curve.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("equity").alias("mean"),
        F.stddev_pop("equity").alias("std"),
        F.min("equity").alias("least"),
        F.max("equity").alias("greatest"),
    )
    return basic.join(exact_percentiles(curve, [by], "equity", (0.5, 0.95, 0.99)), by)


def performance(path: DataFrame, ledger: DataFrame, starting_cash: float) -> DataFrame:
    """Per symbol: starting and ending equity, gain and return, peak and largest drawdown of the path, and from the log turnover, entries, orders
    submitted, filled and rejected, fills on record and the fill rate (fills that counted over orders submitted, 0 without orders)."""
    curve = path.groupBy("symbol").agg(F.max_by("equity", "row_idx").alias("ending_equity"), F.greatest(F.max("equity"), F.lit(starting_cash)).alias("peak_equity"), F.max("drawdown").alias("max_drawdown"))
    of = lambda kind: F.count_if(F.col("type").startswith(kind))
    value = F.abs(F.col("quantity") * F.col("price"))
    log = ledger.groupBy("symbol").agg(
        F.sum(F.when(F.col("type") == "FILL_APPLIED", value).when(F.col("type") == "ORDER_REJECTED_CASH", -value).otherwise(0.0)).alias("turnover"),
        F.count(F.lit(1)).alias("entries"),
        of("ORDER_SUBMITTED").alias("submitted_orders"),
        (of("FILL_APPLIED") - of("ORDER_REJECTED_CASH")).alias("filled_orders"),
        of("ORDER_REJECTED").alias("rejected_orders"),
        of("FILL_APPLIED").alias("fill_count"),
    )
    out = curve.join(log, "symbol", "left").fillna(0, ["turnover", "entries", "submitted_orders", "filled_orders", "rejected_orders", "fill_count"])
    gain = F.col("ending_equity") - starting_cash
    return out.select(
        "symbol", F.lit(starting_cash).alias("starting_equity"), "ending_equity", gain.alias("pnl"), (gain / starting_cash).alias("return_pct"), "peak_equity", "max_drawdown", "turnover", "entries",
        "submitted_orders", "filled_orders", "rejected_orders", "fill_count", F.coalesce(F.try_divide("filled_orders", "submitted_orders"), F.lit(0.0)).alias("fill_rate"),
    )


def audit_counts(ledger: DataFrame) -> DataFrame:
    """Entries of the log by type."""
    return ledger.groupBy("type").agg(F.count(F.lit(1)).alias("events"))


def asset_execution(fills: DataFrame) -> DataFrame:
    """Fills, quantities and fees by symbol."""
    return fills.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("fills"),
        F.sum("quantity").alias("net_quantity"),
        F.sum(F.abs("quantity")).alias("gross_quantity"),
        F.sum("fee").alias("fees"),
    )


def latency_summary(samples: DataFrame) -> DataFrame:
    """Per stage the count, mean, exact percentiles, maximum and total of the finite elapsed times of distinct samples."""
    v = F.col("elapsed_seconds")
    good = samples.where(v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v != float("inf"))).groupBy("run_id", "sample_no", "stage").agg(F.min(v).alias("elapsed_seconds"))
    basic = good.groupBy("stage").agg(
        F.count(F.lit(1)).alias("n"), F.avg("elapsed_seconds").alias("mean"), F.max("elapsed_seconds").alias("greatest"), F.sum("elapsed_seconds").alias("total")
    )
    p = exact_percentiles(good, ["stage"], "elapsed_seconds", (0.5, 0.95, 0.99)).withColumnRenamed("stage", "of_stage")
    return basic.join(p, F.col("stage").eqNullSafe(F.col("of_stage"))).drop("of_stage")
