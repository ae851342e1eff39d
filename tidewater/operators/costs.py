"""Transaction-cost analysis, cost calibration and reconciliation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.analytics import exact_percentiles
from tidewater.operators.engine import Config


def calibrate(samples: DataFrame) -> DataFrame:
    """Linear impact model of all samples (``arrival_mid, fill_price, side, participation, quoted_spread_bps``):
    ``impact_bps = fixed_bps + impact * 10,000 * participation squared``, neither below 0, and the spread in bps: the median of the quoted spreads
    that are numbers, or without any twice the median size of the impact."""
    rows = samples.withColumn("impact", F.col("side") * (F.col("fill_price") / F.col("arrival_mid") - 1.0) * 1e4)
    rows = rows.withColumns({"y": F.abs("impact"), "x": F.col("participation") * F.col("participation")})
    fit = rows.agg(
        F.count(F.lit(1)).alias("samples"),
        F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"),
        F.avg("y").alias("mean_y"),
        F.avg("x").alias("mean_x"),
    )
    both = rows.select(F.explode(F.array(F.struct(F.lit("spread").alias("what"), F.col("quoted_spread_bps").cast("double").alias("v")), F.struct(F.lit("impact").alias("what"), F.col("y").alias("v")))).alias("m")).select("m.*")
    medians = exact_percentiles(both, ["what"], "v", (0.5,)).agg(F.max(F.when(F.col("what") == "spread", F.col("p50"))).alias("spread"), F.max(F.when(F.col("what") == "impact", F.col("p50"))).alias("half"))
    one = F.lit(1).alias("one")  # two tables of one row
    fit = fit.select("*", one).join(medians.select("*", one), "one")
    constant = F.col("mean_y") / (1.0 + F.col("mean_x") * F.col("mean_x"))  # the least-norm fit where x does not vary
    return fit.select(
        "samples",
        F.greatest(F.coalesce("intercept", constant), F.lit(0.0)).alias("fixed_bps"),
        F.greatest(F.coalesce("slope", F.col("mean_x") * constant) / 1e4, F.lit(0.0)).alias("impact"),
        F.coalesce(F.col("spread"), 2.0 * F.col("half")).alias("spread_bps"),
    )


def calibrated_config(model: DataFrame, config: Config = Config()) -> Config:
    """``config`` with the slippage of a calibrated model (the one row of ``calibrate``): its fixed cost and its impact by share of volume."""
    row = model.first()
    return replace(config, slippage_bps=float(row["fixed_bps"]), volume_share_impact=float(row["impact"]))


def fill_costs(fills: DataFrame, assets: DataFrame | None = None, total_borrow: float = 0.0, impact_coefficient: float = 1.0, bucket_seconds: int = 3600) -> DataFrame:
    """Costs of each fill: half spread, impact, financing share, shortfall against the price at which its order came in.

    fills: ``Simulation.fills`` with the ``volatility`` of their bars; ``assets`` gives a symbol's ``asset`` (null without). Financing is a
    symbol's share of ``total_borrow`` by traded value.
    """
    size = F.abs("quantity").cast("double")
    side = F.signum(F.col("quantity").cast("double"))
    rows = fills.withColumn("asset", F.lit(None).cast("bigint")) if assets is None else fills.join(assets.select("symbol", "asset"), "symbol", "left")
    rows = rows.withColumn("arrival_price", F.coalesce("arrival_price", "close")).withColumn("spread", F.greatest(F.col("ask") - F.col("bid"), F.lit(0.0)))
    rows = rows.withColumn("participation", F.least(size / F.greatest("volume", F.lit(1.0)), F.lit(1.0)))
    out = rows.select(
        "symbol",
        "asset",
        "ts",
        "parent_order_id",
        "order_id",
        F.when(F.col("quantity") >= 0, "buy").otherwise("sell").alias("direction"),
        "quantity",
        size.alias("abs_quantity"),
        "bid",
        "ask",
        "arrival_price",
        F.col("price").alias("fill_price"),
        ((F.col("bid") + F.col("ask")) * 0.5).alias("mid_price"),
        "spread",
        (F.col("spread") * size * 0.5).alias("spread_cost"),
        "participation",
        "volatility",
        F.greatest(size * F.col("price") * F.col("volatility") * F.sqrt("participation") * impact_coefficient, F.lit(0.0)).alias("impact_cost"),
        F.greatest(side * (F.col("price") - F.col("arrival_price")) * size, F.lit(0.0)).alias("implementation_shortfall"),
        (side * (F.col("price") - F.col("arrival_price")) <= 0).alias("at_or_better_arrival"),
        (F.floor(F.pmod(F.col("ts"), F.lit(86_400)) / max(1, bucket_seconds)) * bucket_seconds).cast("bigint").alias("time_bucket"),
        (size * F.col("price")).alias("notional"),
    )
    if total_borrow:
        whole = F.sum("notional").over(Window.partitionBy("symbol"))
        out = out.withColumn("financing_cost", F.coalesce(F.try_divide(F.col("notional") * total_borrow, whole), F.lit(0.0)))
    else:
        out = out.withColumn("financing_cost", F.lit(0.0))
    return out.withColumn("total_cost", F.col("spread_cost") + F.col("impact_cost") + F.col("financing_cost")).drop("notional")


def aggregate_costs(costs: DataFrame, by: tuple[str, ...] = ("symbol", "direction", "time_bucket")) -> DataFrame:
    """Fills, sums of the cost columns and the share of fills at or better than arrival, by group."""
    sums = ("abs_quantity", "spread_cost", "impact_cost", "financing_cost", "implementation_shortfall", "total_cost")
    return costs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("fills"), *(F.sum(c).alias(c) for c in sums), F.avg(F.col("at_or_better_arrival").cast("int")).alias("fill_quality")
    )


def arrival_times(ledger: DataFrame) -> DataFrame:
    """The first submission of each parent order."""
    return (
        ledger.where((F.col("type") == "ORDER_SUBMITTED") & (F.col("parent_order_id") != 0))
        .groupBy("symbol", "parent_order_id")
        .agg(F.min_by("ts", "sequence").alias("arrival_ts"))
    )


def reconcile(engine: DataFrame, broker: DataFrame, tolerance: float = 0.0, auto: bool = False) -> DataFrame:
    """Positions of both sides (``symbol, position``), missing ones 0, where they differ by more than ``tolerance``.

    ``action`` is ``submit_order`` with ``auto``, else ``mismatch_detected``; the order would be for ``+delta``.
    """
    e, b = engine.withColumnRenamed("position", "engine_position"), broker.withColumnRenamed("position", "broker_position")
    both = e.join(b, "symbol", "full_outer").fillna(0, ["engine_position", "broker_position"])
    both = both.withColumn("delta", (F.col("broker_position") - F.col("engine_position")).cast("double"))
    return both.where(F.abs("delta") > tolerance).withColumn("action", F.lit("submit_order" if auto else "mismatch_detected"))


def submit_corrections(submit: Callable[[str, float], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that hands every ``submit_order`` row of a micro-batch to ``submit``."""

    def handle(batch: DataFrame, _: int) -> None:
        for row in batch.where("action = 'submit_order'").select("symbol", "delta").toLocalIterator():
            submit(row["symbol"], row["delta"])

    return handle
