"""Fan-out over runs: parameter grids, sweeps, walk-forward validation and resampled paths, each in one job."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from tidewater.operators import signals
from tidewater.operators.analytics import cagr, calmar, sharpe_and_sortino, years_of
from tidewater.operators.engine import Config
from tidewater.operators.panel import simple_return
from tidewater.operators.simulation import Simulation
from tidewater.operators.sliced import by_slice, with_halo


def param_grid(spark: SparkSession, grid: dict[str, list]) -> DataFrame:
    """Every combination of the listed values with its ``combo_idx``; an empty grid has one empty combination."""
    rows = [(i, *values) for i, values in enumerate(itertools.product(*grid.values()))]
    kinds = {int: "bigint", float: "double", str: "string", bool: "boolean"}
    schema = ", ".join(["combo_idx int", *(f"{k} {kinds[type(v[0])]}" for k, v in grid.items())])
    return spark.createDataFrame(rows, schema)


#: One run of a grid: its number, the policy's name (or a function from a panel to one with ``target``) and its parameters.
Combo = tuple[int, str | Callable[..., DataFrame], dict]
_BAR = ("ts", "row_idx", "close", "high", "low", "volume", "bid", "ask")


def policy_paths(panel: DataFrame, combos: list[Combo], config: Config, series: tuple[str, ...] = ("symbol",), hot: DataFrame | None = None) -> DataFrame:
    """The path of every combination over every series: ``combo_idx``, ``series`` and what ``Simulation.path`` has.

    Targets of policies that look at one series are windows over one sort of its bars; each bar is then exploded into its combinations,
    whose number the grid fixes. Policies across symbols, and functions, make their targets by themselves. ``row_idx`` starts from 0 in each series.
    """
    paths, one = [], [c for c in combos if c[1] in signals.OF_ONE_SERIES]
    if one:
        reach = max(signals.target_in_slices(panel, name, series, **params)[1] for _, name, params in one)
        sliced = with_halo(panel.select(*series, *_BAR), reach + 1)
        sliced = sliced.withColumn("ret", simple_return(F.lag("close").over(by_slice(*series)), F.col("close")))
        targets = sliced.withColumns({f"target_{i}": signals.target_in_slices(sliced, name, series, **params)[0] for i, name, params in one})
        each = F.explode(F.array(*(F.struct(F.lit(i).alias("combo_idx"), F.col(f"target_{i}").alias("target")) for i, _, _ in one))).alias("run")
        targets = targets.select(*series, *_BAR, "slice", "own", each).select(*series, *_BAR, "slice", "own", "run.*")
        paths.append(Simulation(targets, config, ("combo_idx", *series), sliced=True, hot=hot).path)
    for i, name, params in combos:
        if name not in signals.OF_ONE_SERIES:
            made = name(panel, **params) if callable(name) else signals.apply_policy(panel, name, **params)
            targets = made.select(F.lit(i).alias("combo_idx"), *series, *_BAR, "target")
            paths.append(Simulation(targets, config, ("combo_idx", *series), hot=hot).path)
    return reduce(DataFrame.unionByName, paths)


def sweep(panel: DataFrame, combos: list[Combo], config: Config, hot: DataFrame | None = None) -> DataFrame:
    """``rated`` figures of every combination and symbol; ``hot`` as ``Simulation`` takes it."""
    return rated(policy_paths(panel, combos, config, hot=hot), ("combo_idx", "symbol"), config.starting_cash)


def rated(paths: DataFrame, runs: tuple[str, ...], starting_cash: float) -> DataFrame:
    """Sharpe, Sortino (of daily equity), CAGR, largest drawdown, Calmar, turnover a year, fills and gain of every run of ``paths``.

    Rows meet once, in days; everything else is taken from a row a day.
    """
    day = F.floor(F.col("ts") / 86_400).cast("bigint").alias("epoch_day")
    first, last = F.struct("row_idx", "ts", "equity"), F.struct("row_idx", "ts", "equity")
    daily = paths.groupBy(*runs, day).agg(
        F.min(first).alias("first"), F.max(last).alias("last"), F.max("drawdown").alias("drawdown"), F.sum("row_fills").alias("fills"), F.sum("traded").alias("traded"),
        F.sum(F.abs("equity")).alias("absolute"), F.count(F.lit(1)).alias("rows"),
    ).withColumn("equity", F.col("last.equity"))
    w = Window.partitionBy(*runs).orderBy("epoch_day")
    rows = daily.withColumn("before", F.lag("equity").over(w))
    rows = rows.withColumn("ret", F.when(F.col("before").isNotNull(), F.coalesce(F.try_divide("equity", "before") - 1, F.lit(0.0))))
    sharpe, sortino = sharpe_and_sortino(F.col("ret"))
    out = rows.groupBy(*runs).agg(
        sharpe.alias("sharpe"), sortino.alias("sortino"), F.max("drawdown").alias("max_drawdown"), F.sum("fills").alias("fill_count"), F.sum("traded").alias("gross"),
        F.try_divide(F.sum("absolute"), F.sum("rows")).alias("mean_equity"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("rows").alias("rows"),
    )
    years = years_of(F.col("first.ts"), F.col("last.ts"), F.greatest(F.abs("first.ts"), F.abs("last.ts")), F.col("rows"))
    out = out.withColumn("years", years).withColumn("cagr", cagr(F.col("first.equity"), F.col("last.equity"), F.col("years")))
    return out.select(
        *runs, "sharpe", "sortino", "cagr", "max_drawdown", calmar(F.col("cagr"), F.col("max_drawdown")).alias("calmar"),
        (F.coalesce(F.try_divide("gross", "mean_equity"), F.lit(0.0)) / F.col("years")).alias("turnover_per_year"), "fill_count", (F.col("last.equity") - starting_cash).alias("pnl"),
    )


def grid_order(df: DataFrame, metric: str) -> list[Column]:
    """Best first; undefined values last; ties in grid order."""
    value = F.when(~F.isnan(metric), F.col(metric))
    return [value.desc_nulls_last(), F.col("combo_idx").asc()]


def top_k(results: DataFrame, k: int, metric: str = "sharpe", by: str | None = "symbol") -> DataFrame:
    """The ``k`` best combinations, per ``by`` or overall."""
    order = grid_order(results, metric)
    if by is None:
        return results.orderBy(*order).limit(k)
    return results.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("bigint")).where(F.col("place") <= k)


def heatmap(results: DataFrame, rows: str, columns: str, values: list, metric: str = "sharpe") -> DataFrame:
    """Mean of a metric by one parameter down and another across."""
    return results.groupBy(rows).pivot(columns, values).agg(F.avg(metric))


def fold_spans(sizes: DataFrame, folds: int, train_fraction: float = 0.7, anchored: bool = False) -> DataFrame:
    """Walk-forward windows of every symbol from its ``rows``: evenly cut folds, each split into training and test by ``train_fraction``.
    Folds of under three rows are left out; both parts have at least one row; ``anchored`` trainings start at the first row."""
    k = F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold")
    out = sizes.select("symbol", "rows", k)
    edge = lambda i: F.floor(F.col("rows") * i / folds + 1e-9).cast("bigint")
    out = out.withColumn("train_start", edge(F.col("fold"))).withColumn("test_end", edge(F.col("fold") + 1))
    length = F.col("test_end") - F.col("train_start")
    out = out.where(length >= 3)
    taken = F.least(F.greatest(F.floor(length * train_fraction + 1e-9), F.lit(1)), length - 1)
    out = out.withColumn("train_end", (F.col("train_start") + taken).cast("bigint")).withColumn("test_start", F.col("train_end"))
    if anchored:
        out = out.withColumn("train_start", F.lit(0).cast("bigint"))
    return out.select("symbol", "fold", "train_start", "train_end", "test_start", "test_end")


_SLICE = ("symbol", "fold", "part")


def walk_forward_paths(panel: DataFrame, combos: list[Combo], config: Config, spans: DataFrame, stride: int = 1, hot: DataFrame | None = None) -> DataFrame:
    """Runs of every combination over each fold's training (``is``) and test (``oos``) rows, keyed by ``(symbol, fold, part, combo_idx)``.

    Every part is a run of its own: warm-up, position and cash start anew and rows count from 0. With ``stride`` over 1 the
    part ``strided`` holds every so-many-th row of the training.
    """
    part = lambda name, a, b, step: F.struct(F.lit(name).alias("part"), F.col(a).alias("from_row"), F.col(b).alias("to_row"), F.lit(step).alias("step"))
    parts = [part("is", "train_start", "train_end", 1), part("oos", "test_start", "test_end", 1)]
    parts += [part("strided", "train_start", "train_end", stride)] if stride > 1 else []
    cuts = spans.select(F.col("symbol").alias("of_symbol"), "fold", F.explode(F.array(*parts)).alias("p")).select("of_symbol", "fold", "p.*")
    place = F.col("row_idx") - F.col("from_row")
    held = (F.col("symbol") == F.col("of_symbol")) & (F.col("row_idx") >= F.col("from_row")) & (F.col("row_idx") < F.col("to_row")) & (place % F.col("step") == 0)
    rows = panel.join(cuts, held).withColumn("row_idx", F.floor(place / F.col("step")).cast("bigint"))
    if any(name not in signals.OF_ONE_SERIES for _, name, _ in combos):
        raise ValueError("folds are cut by symbol; policies across symbols have none")
    return policy_paths(rows.select(*_SLICE, *_BAR), combos, config, series=_SLICE, hot=hot)


def walk_forward_folds(
    panel: DataFrame, combos: list[Combo], config: Config, folds: int = 3, train_fraction: float = 0.7,
    anchored: bool = False, stride: int = 1, shortlist: int | None = None, hot: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Walk-forward validation with every training and test part run anew: the folds, and the out-of-sample curve.

    Per symbol and fold the best combination in training, its Sharpe and largest drawdown in and out of sample, a warning where the first is
    over twice a positive second, and per symbol the means of the finite Sharpes and their ratio ``efficiency`` (0 where the mean in training is 0). ``anchored`` trainings start
    at the first row. With ``stride`` the training is ranked on every so-many-th row; ``shortlist`` then ranks that many of the
    best anew on all training rows. The curve is the best combinations' equity over the test rows, fold after fold, not rebased.
    """
    spans = fold_spans(panel.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows")), folds, train_fraction, anchored)
    paths = walk_forward_paths(panel, combos, config, spans, stride, hot)
    figures = rated(paths, ("combo_idx", *_SLICE), config.starting_cash)
    of = lambda part, name: F.max(F.when(F.col("part") == part, F.col(name)))
    ranked_on = "strided" if stride > 1 else "is"
    wide = figures.groupBy("symbol", "fold", "combo_idx").agg(
        *(of(p, m).alias(f"{p}_{m}") for p in ("is", "oos") for m in ("sharpe", "max_drawdown")), *(of(ranked_on, m).alias(f"ranked_{m}") for m in ("sharpe", "max_drawdown"))
    )
    fold = Window.partitionBy("symbol", "fold")
    best = wide.withColumn("place", F.row_number().over(fold.orderBy(*grid_order(wide, "ranked_sharpe")))).where(F.col("place") <= (shortlist or 1))
    if shortlist:
        best = best.withColumn("place", F.row_number().over(fold.orderBy(grid_order(wide, "is_sharpe")[0], "place"))).where("place = 1")
    else:
        best = best.withColumns({"is_sharpe": F.col("ranked_sharpe"), "is_max_drawdown": F.col("ranked_max_drawdown")})
    best = best.drop("place", "ranked_sharpe", "ranked_max_drawdown")
    of_symbol = Window.partitionBy("symbol")
    best = best.withColumn("overfit_warning", overfit(F.col("is_sharpe"), F.col("oos_sharpe")))
    means = best.withColumns({f"mean_{m}": finite_mean(F.col(m), of_symbol) for m in ("is_sharpe", "oos_sharpe")})
    efficiency = F.when(F.col("mean_is_sharpe") != 0, F.col("mean_oos_sharpe") / F.col("mean_is_sharpe")).otherwise(0.0)
    curve = paths.where("part = 'oos'").join(best.select("symbol", "fold", "combo_idx"), ["symbol", "fold", "combo_idx"])
    return means.withColumn("efficiency", efficiency).join(spans, ["symbol", "fold"]), curve.select("symbol", "fold", "combo_idx", "ts", "row_idx", "equity")


def overfit(inside: Column, outside: Column) -> Column:
    """Whether the Sharpe in sample is over twice the one out of sample, where that is positive."""
    return F.coalesce((outside > 0) & (inside > 2 * outside), F.lit(False))


def sweep_out_of_sample(panel: DataFrame, combos: list[Combo], config: Config, train_fraction: float = 0.7, hot: DataFrame | None = None) -> DataFrame:
    """Every combination over the first rows of each symbol (all ``rated`` figures) and over the rest, run anew: ``oos_sharpe, oos_max_drawdown,
    overfit_warning``."""
    spans = fold_spans(panel.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows")), 1, train_fraction)
    figures = rated(walk_forward_paths(panel, combos, config, spans, hot=hot), ("combo_idx", *_SLICE), config.starting_cash)
    outside = figures.where("part = 'oos'").select("combo_idx", "symbol", F.col("sharpe").alias("oos_sharpe"), F.col("max_drawdown").alias("oos_max_drawdown"))
    both = figures.where("part = 'is'").drop("part", "fold").join(outside, ["combo_idx", "symbol"])
    return both.withColumn("overfit_warning", overfit(F.col("sharpe"), F.col("oos_sharpe")))


def finite_mean(column: Column, over: WindowSpec | None = None) -> Column:
    """Mean of the finite values, 0 if there are none."""
    mean = F.avg(F.when(~F.isnan(column) & (F.abs(column) != float("inf")), column))
    return F.coalesce(mean.over(over) if over is not None else mean, F.lit(0.0))


def monte_carlo(spark: SparkSession, returns: np.ndarray, n_sims: int = 200, method: str = "bootstrap", block: int = 10, seed: int = 0, parts: int = 8, years: float | None = None) -> DataFrame:
    """Sharpe, largest drawdown and yearly growth of resampled return paths: ``sim_id, sharpe, max_drawdown, cagr``.

    ``years`` is the time that the returns span, 252 of them a year unless given.

    ``bootstrap`` joins blocks that start anywhere, ``shuffle`` permutes; other methods raise. Every path has its own
    random stream from ``(seed, sim_id)``, so the result doesn't depend on how simulations are spread. The returns are one
    run's daily series, shipped with the task.
    """
    if method not in ("bootstrap", "shuffle"):
        raise ValueError(f"unknown resampling method {method!r}")
    returns = np.asarray(returns, dtype=float)
    n = len(returns)
    span = max(years if years is not None else n / 252.0, 1.0 / 252.0)
    length = max(1, min(block, n))

    def simulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for sim in pdf["id"]:
                rng = np.random.default_rng((seed, int(sim)))
                if method == "shuffle":
                    path = rng.permutation(returns)
                else:
                    starts = rng.integers(0, n - length + 1, -(-n // length))
                    path = returns[(starts[:, None] + np.arange(length)).ravel()[:n]]
                wealth = np.concatenate([[1.0], np.cumprod(1.0 + path)])
                peak = np.maximum.accumulate(wealth)
                deviation = path.std()
                sharpe = path.mean() / deviation * np.sqrt(252.0) if deviation > 0 else 0.0
                rows.append((int(sim), float(sharpe), float((1 - wealth / peak).max()), float(wealth[-1] ** (1.0 / span) - 1.0) if wealth[-1] > 0 else 0.0))
            yield pd.DataFrame(rows, columns=["sim_id", "sharpe", "max_drawdown", "cagr"])

    ids = spark.range(0, n_sims if n else 0, 1, parts)
    return ids.mapInPandas(simulate, "sim_id bigint, sharpe double, max_drawdown double, cagr double")


def simulation_report(sims: DataFrame, base_sharpe: float) -> DataFrame:
    """Percentiles 5, 25, 50, 75, 95 of each figure, and the share of paths whose Sharpe exceeds the real one."""
    q = F.array(*(F.lit(x) for x in (0.05, 0.25, 0.5, 0.75, 0.95)))
    cols = ("sharpe", "max_drawdown", "cagr")
    return sims.agg(*(F.percentile(c, q).alias(c) for c in cols), F.avg((F.col("sharpe") > base_sharpe).cast("double")).alias("p_proxy"))
