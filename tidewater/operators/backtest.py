"""Frictionless execution in closed form: positions, fills, cash and equity as windows, with the guard that allows it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.execution import fee, most_fillable, slippage_price
from tidewater.operators.sliced import by_slice, with_halo


@dataclass(frozen=True)
class Costs:
    """Costs and limits of a run."""

    starting_cash: float = 1_000_000.0
    commission_bps: float = 0.1
    slippage_bps: float = 0.2
    max_participation: float = 0.25
    max_gross_leverage: float = 10.0
    max_drawdown: float = 1.0
    max_position: int = 5


#: What a path has besides the rows' own columns.
PATH_COLUMNS = ("row_idx", "ts", "close", "position", "trade", "cash", "equity", "drawdown", "traded", "row_fills")


def closed_form(panel: DataFrame, costs: Costs = Costs(), run: tuple[str, ...] = ("symbol",), sliced: bool = False) -> DataFrame:
    """The run's path when every order is a market order that fills at once: adds ``position, trade, price, fee_paid,
    traded, row_fills, nth, cash_before, cash, equity, peak, drawdown, holds`` to rows with ``row_idx, target, close, volume``.

    Position is the target, the trade its change, cash the running sum of what trades and fees cost, ``nth`` the trades so
    far. ``run`` names the columns of a run, each run holding one asset. ``holds`` says whether no rule that depends on the path fires in
    this row; the first row where it does not is where the closed form stops being the engine's result.

    Runs are worked in slices of rows (``sliced`` panels come with ``slice``, ``own`` and at least one row before each slice): one sort
    gives what a slice spends and its greatest equity by itself; what came before a slice is one row a slice.
    """
    w = by_slice(*run)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    out = panel if sliced else with_halo(panel, 1)
    out = out.withColumn("position", F.col("target").cast("bigint"))
    held = F.coalesce(F.lag("position").over(w), F.lit(0))
    out = out.withColumn("trade", F.when(F.col("row_idx") == 0, F.col("position")).otherwise(F.col("position") - held)).where("own").drop("own")
    price = slippage_price(F.col("close"), F.col("trade"), F.lit(0.0), "fixed", costs.slippage_bps)
    out = out.withColumn("price", price).withColumn("fee_paid", fee(F.abs("trade") * F.col("price"), costs.commission_bps))
    out = out.withColumns({"traded": F.abs("trade") * F.col("price"), "row_fills": (F.col("trade") != 0).cast("bigint"), "paid": F.col("trade") * F.col("price") + F.col("fee_paid")})
    out = out.withColumns({"spent": F.sum("paid").over(so_far), "nth": F.sum("row_fills").over(so_far)})
    out = out.withColumn("gained", F.col("position") * F.col("close") - F.col("spent"))
    out = out.withColumn("most_gained", F.max("gained").over(so_far))

    # what the slices before have spent, and the greatest equity they reached
    before = Window.partitionBy(*run).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = out.groupBy(*run, "slice").agg(F.sum("paid").alias("paid"), F.sum("row_fills").alias("trades"), F.max("gained").alias("gained"))
    carried = totals.withColumns({"spent_before": F.coalesce(F.sum("paid").over(before), F.lit(0.0)), "nth_before": F.coalesce(F.sum("trades").over(before), F.lit(0))})
    carried = carried.withColumn("gained_before", F.max(F.col("gained") - F.col("spent_before")).over(before))
    out = out.join(carried.select(*run, "slice", "spent_before", "nth_before", "gained_before"), [*run, "slice"], "left")

    start = F.lit(costs.starting_cash)
    out = out.withColumn("nth", F.col("nth") + F.col("nth_before"))
    out = out.withColumn("cash", start - F.col("spent_before") - F.col("spent")).withColumn("cash_before", F.col("cash") + F.col("paid"))
    out = out.withColumn("equity", F.col("cash") + F.col("position") * F.col("close"))
    out = out.withColumn("peak", F.greatest(start, F.col("equity"), start + F.col("most_gained") - F.col("spent_before"), start + F.col("gained_before")))
    out = out.withColumn("drawdown", F.when(F.col("peak") > 0, (F.col("peak") - F.col("equity")) / F.col("peak")).otherwise(0.0))
    leverage = F.abs(F.col("target") * F.col("close")) / F.greatest("cash_before", F.lit(1.0))
    holds = (
        (leverage <= costs.max_gross_leverage)
        & (F.abs("trade") <= F.when(F.col("trade") == 0, 0).otherwise(most_fillable(F.col("volume"), costs.max_participation)))
        & ((F.col("cash") >= 0) | (F.col("trade") <= 0))
        & (F.col("drawdown") <= costs.max_drawdown)
        & (F.abs("target") <= costs.max_position)
    )
    gone = ("slice", "paid", "spent", "gained", "most_gained", "spent_before", "nth_before", "gained_before")
    return out.withColumn("holds", F.coalesce(holds, F.lit(False))).drop(*gone)


def fills_of(path: DataFrame, *more: Column) -> DataFrame:
    """The fills of a closed-form run, numbered per symbol: ``symbol, ts, row_idx, parent_order_id, order_id, quantity,
    price, fee, arrival_ts, arrival_price, close, bid, ask, volume`` and ``more`` columns of the path. Orders fill in the row they are made in."""
    n = F.col("nth")
    return path.where("trade != 0").select(
        "symbol",
        "ts",
        "row_idx",
        n.cast("bigint").alias("parent_order_id"),
        (n + 999_999).cast("bigint").alias("order_id"),
        F.col("trade").alias("quantity"),
        "price",
        F.col("fee_paid").alias("fee"),
        F.col("ts").alias("arrival_ts"),
        F.col("close").alias("arrival_price"),
        "close",
        "bid",
        "ask",
        "volume",
        *more,
    )


def ledger_of(path: DataFrame) -> DataFrame:
    """The ledger of a closed-form run: a submission and a fill per trade, as ``symbol, sequence, ts, order_id,
    parent_order_id, type, quantity, price, cash_after, equity_after``.

    Both entries carry the cash before the fill. The last entry of the log is revalued in every row until the next one
    comes, so a fill's equity is the equity of the row before the next trade, or of the run's last row.
    """
    held = path.where("nth > 0").groupBy("symbol", "nth").agg(
        F.min_by(F.struct("ts", "trade", "price", "cash_before"), "row_idx").alias("f"), F.max_by("equity", "row_idx").alias("held")
    )
    entries = F.array(
        F.struct((F.col("nth") * 2 - 1).alias("sequence"), F.lit(0).cast("bigint").alias("order_id"), F.lit("ORDER_SUBMITTED").alias("type"), F.lit(0.0).alias("price"), F.lit(0.0).alias("equity_after")),
        F.struct((F.col("nth") * 2).alias("sequence"), (F.col("nth") + 999_999).cast("bigint").alias("order_id"), F.lit("FILL_APPLIED").alias("type"), F.col("f.price").alias("price"), F.col("held").alias("equity_after")),
    )
    return held.select("symbol", "nth", "f", F.explode(entries).alias("e")).select(
        "symbol",
        "e.sequence",
        F.col("f.ts").alias("ts"),
        "e.order_id",
        F.col("nth").cast("bigint").alias("parent_order_id"),
        "e.type",
        F.col("f.trade").alias("quantity"),
        "e.price",
        F.col("f.cash_before").alias("cash_after"),
        "e.equity_after",
    )
