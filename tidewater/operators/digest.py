"""Percentiles of very large columns by merging centroid digests, with certified rank errors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Clusters that a digest has at most, apart from heavily tied values, which get clusters of their own.
DELTA = 400
#: Digests that are merged at a time.
FAN_IN = 64

_DIGEST = "grp string, day date, mean array<double>, weight array<double>, low array<double>, high array<double>"


def cluster(mean: np.ndarray, weight: np.ndarray, low: np.ndarray, high: np.ndarray, delta: int = DELTA) -> tuple[np.ndarray, ...]:
    """Cluster values sorted by ``mean`` under the arcsine size function: a cluster spans at most one of ``delta`` steps.

    Steps are narrow near both ends, so extreme percentiles keep their resolution. A value whose own weight spans more
    than half a step stays alone, so that ties are never blurred with their neighbours.
    """
    total = weight.sum()
    right = np.cumsum(weight) / total
    left = np.clip(right - weight / total, 0.0, 1.0)
    k_left = np.arcsin(2 * left - 1) * (delta / np.pi)
    k_right = np.arcsin(2 * np.clip(right, 0.0, 1.0) - 1) * (delta / np.pi)
    heavy = (k_right - k_left) > 0.5
    step = np.floor(k_left)
    new = np.ones(len(mean), dtype=bool)
    new[1:] = (step[1:] != step[:-1]) | heavy[1:] | heavy[:-1]
    at = np.flatnonzero(new)
    w = np.add.reduceat(weight, at)
    m = np.add.reduceat(mean * (weight / total), at) / (w / total)
    lo, hi = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
    return np.clip(m, lo, hi), w, lo, hi


def digest_of(values: np.ndarray, delta: int = DELTA) -> tuple[np.ndarray, ...]:
    """The digest of raw values."""
    v, n = np.unique(values, return_counts=True)
    return cluster(v, n.astype(float), v, v, delta)


def merge(parts: list[tuple[np.ndarray, ...]], delta: int = DELTA) -> tuple[np.ndarray, ...]:
    """One digest of several: their clusters in order of value, equal single values joined, clustered anew."""
    mean, weight, low, high = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((high, low, mean))
    mean, weight, low, high = mean[order], weight[order], low[order], high[order]
    new = np.ones(len(mean), dtype=bool)
    new[1:] = (mean[1:] != mean[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    at = np.flatnonzero(new)
    return cluster(mean[at], np.add.reduceat(weight, at), low[at], high[at], delta)


def quantile(digest: tuple[np.ndarray, ...], q: float) -> float:
    """The value at rank ``q * n``: a single value's cluster gives that value, others are interpolated within their
    own least and greatest value."""
    mean, weight, low, high = digest
    right = np.cumsum(weight)
    rank = q * right[-1]
    i = min(int(np.searchsorted(right, rank, side="left")), len(mean) - 1)
    if low[i] == high[i]:
        return float(mean[i])
    inside = (rank - (right[i] - weight[i])) / weight[i]
    below, above = low[i], high[i]
    value = below + (mean[i] - below) * 2 * inside if inside < 0.5 else mean[i] + (above - mean[i]) * (2 * inside - 1)
    return float(min(max(value, below), above))


def partial_digests(df: DataFrame, group: str, day: str, value: str, delta: int = DELTA) -> DataFrame:
    """A digest per partition, group and day; no rows are moved."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf in batches:
            held.append(pdf)
            size += len(pdf)
            if size >= 500_000:  # a partition of any size is digested piece by piece
                yield _digest_frame(pd.concat(held), delta)
                held, size = [], 0
        if held:
            yield _digest_frame(pd.concat(held), delta)

    return df.select(F.col(group).alias("grp"), F.col(day).alias("day"), F.col(value).alias("value")).mapInPandas(build, _DIGEST)


def _digest_frame(pdf: pd.DataFrame, delta: int) -> pd.DataFrame:
    rows = []
    for (grp, day), values in pdf.groupby(["grp", "day"], dropna=False, sort=False)["value"]:
        rows.append((_none(grp), _none(day), *digest_of(values.to_numpy(), delta)))
    return pd.DataFrame(rows, columns=["grp", "day", "mean", "weight", "low", "high"])


def _none(x):
    return None if pd.isna(x) else x


def merged_digests(parts: DataFrame, keys: list[str], quantiles: tuple[float, ...] = (), delta: int = DELTA) -> DataFrame:
    """One digest per ``keys`` (``["grp", "day"]`` or ``["grp"]``) with its ``estimates`` of ``quantiles``.

    Digests of a key come to one task in a stream; whenever FAN_IN are at hand they become one, so a task holds few
    clusters however many partitions or days there are.
    """

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []
        for pdf in batches:
            out = []
            for grp, day, *part in zip(*(pdf[c] for c in ("grp", "day", "mean", "weight", "low", "high"))):
                now = (_none(grp), _none(day) if "day" in keys else None)
                if held and now != key:
                    out.append(_finished(key, held, quantiles, delta))
                    held = []
                key = now
                held.append(tuple(part))
                if len(held) >= FAN_IN:
                    held = [merge(held, delta)]
            if out:
                yield pd.DataFrame(out, columns=_MERGED_COLUMNS)
        if held:
            yield pd.DataFrame([_finished(key, held, quantiles, delta)], columns=_MERGED_COLUMNS)

    laid = parts.repartition(*keys).sortWithinPartitions(*keys).select("grp", "day", "mean", "weight", "low", "high")
    return laid.mapInPandas(join, _MERGED)


_MERGED = "grp string, day date, mean array<double>, weight array<double>, low array<double>, high array<double>, estimates array<double>"
_MERGED_COLUMNS = [c.split()[0] for c in _MERGED.split(", ")]


def _finished(key: tuple, held: list[tuple], quantiles: tuple[float, ...], delta: int) -> tuple:
    out = merge(held, delta) if len(held) > 1 else tuple(np.asarray(x) for x in held[0])
    return (*key, *out, [quantile(out, q) for q in quantiles])


def _name(q: float) -> str:
    return "p" + f"{q * 100:g}".replace(".", "_")


def certified_percentiles(
    df: DataFrame,
    *,
    sample_key: tuple[str, ...] = ("run_id", "sample_no"),
    group: str = "stage",
    day: str = "run_date",
    value: str = "elapsed_seconds",
    quantiles: tuple[float, ...] = (0.5, 0.95, 0.99),
    delta: int = DELTA,
    max_rank_error: float = 0.01,
) -> DataFrame:
    """Percentiles of ``value`` per group and day and per group over all days, each with its certified rank error.

    Samples are deduplicated on ``sample_key`` (of differing copies the one with the least value, then group, then day counts; a
    sample whose key is null in any part has no copies). Null, NaN, infinite and negative values are no measurements. Each
    partition is digested where it lies; partial digests merge per group and day, and daily digests per group, so a group's samples
    never meet one task and digests of other days or partitions can be combined later. A second pass over the same exchange counts,
    for both levels at once, the values below and up to each estimate: ``rank_error_<p>`` is the distance of ``q * n`` from that
    interval as a share of ``n``, exact; ``certified`` says whether all are within ``max_rank_error``.

    Result: ``level`` (``group_day`` or ``group``), the group, the day (null at level ``group``), ``n``, ``p50`` ...,
    ``rank_error_p50`` ..., ``certified``. Null groups and days form groups of their own. No rows for an empty table.
    """
    samples = measurements(df, sample_key, group, day, value)
    daily = merged_digests(partial_digests(samples, "grp", "day", "value", delta), ["grp", "day"], quantiles, delta)
    names = [_name(q) for q in quantiles]

    def estimates(digests: DataFrame, prefix: str) -> DataFrame:
        return digests.select(F.col("grp").alias(f"{prefix}_grp"), F.col("day").alias(f"{prefix}_day"), *(F.get("estimates", F.lit(i)).alias(f"{prefix}_{n}") for i, n in enumerate(names)))

    x = F.col("value")
    per_day, per_group = estimates(daily, "d"), estimates(merged_digests(daily, ["grp"], quantiles, delta), "g")
    asked = per_day.join(per_group, F.col("d_grp").eqNullSafe(F.col("g_grp")))  # a row a group and day
    met = samples.join(asked, F.col("grp").eqNullSafe(F.col("d_grp")) & F.col("day").eqNullSafe(F.col("d_day")))
    found = [f"{level}_{n}" for level in "dg" for n in names]
    counts = [F.count(F.lit(1)).alias("n")]
    for c in found:
        counts += [F.count_if(x < F.col(c)).alias(f"lt_{c}"), F.count_if(x <= F.col(c)).alias(f"le_{c}")]
    counted = met.groupBy("grp", "day").agg(*counts, *(F.first(c).alias(c) for c in found))
    whole = counted.groupBy("grp").agg(
        F.lit(None).cast("date").alias("day"),
        F.sum("n").alias("n"),
        *(F.first(f"g_{n}").alias(f"g_{n}") for n in names),
        *(F.sum(f"{side}_g_{n}").alias(f"{side}_g_{n}") for n in names for side in ("lt", "le")),
    )

    def finished(df: DataFrame, level: str, prefix: str) -> DataFrame:
        errors = []
        for q, n in zip(quantiles, names):
            rank = F.col("n") * q
            errors.append((F.greatest(F.lit(0.0), F.col(f"lt_{prefix}_{n}") - rank, rank - F.col(f"le_{prefix}_{n}")) / F.col("n")).alias(f"rank_error_{n}"))
        out = df.select(F.lit(level).alias("level"), F.col("grp").alias(group), F.col("day").alias(day), "n", *(F.col(f"{prefix}_{n}").alias(n) for n in names), *errors)
        worst = F.greatest(*(F.col(f"rank_error_{n}") for n in names)) if len(names) > 1 else F.col(f"rank_error_{names[0]}")
        return out.withColumn("certified", worst <= max_rank_error)

    return finished(counted, "group_day", "d").unionByName(finished(whole, "group", "g"))


def measurements(df: DataFrame, sample_key: tuple[str, ...], group: str, day: str, value: str) -> DataFrame:
    """``grp, day, value`` of the usable samples, copies of one sample once."""
    v = F.col(value).cast("double")
    usable = v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v != F.lit(float("inf")))
    keys = [F.col(k).alias(f"key_{i}") for i, k in enumerate(sample_key)]
    named = F.lit(True)
    for k in sample_key:
        named = named & F.col(k).isNotNull()
    lone = F.when(~named, F.monotonically_increasing_id()).alias("lone")
    rows = df.where(usable).select(*keys, lone, F.struct(v.alias("value"), F.col(group).alias("grp"), F.col(day).cast("date").alias("day")).alias("s"))
    of_sample = [*(f"key_{i}" for i in range(len(sample_key))), "lone"]
    return rows.repartition(*of_sample).groupBy(*of_sample).agg(F.min("s").alias("s")).select("s.grp", "s.day", "s.value")


def day_digests(
    df: DataFrame,
    *,
    sample_key: tuple[str, ...] = ("run_id", "sample_no"),
    group: str = "stage",
    day: str = "run_date",
    value: str = "elapsed_seconds",
    delta: int = DELTA,
) -> DataFrame:
    """The digest of every group and day, to be stored: ``grp, day, mean, weight, low, high``. Digests of further days, or of other parts of
    a day's samples, can be appended to the same table; ``combined_percentiles`` merges whatever is there."""
    samples = measurements(df, sample_key, group, day, value)
    return merged_digests(partial_digests(samples, "grp", "day", "value", delta), ["grp", "day"], (), delta).drop("estimates")


def _under(x: Column, side: str, equal: bool, cluster: Column) -> Column:
    return cluster[side] <= x if equal else cluster[side] < x


def combined_percentiles(digests: DataFrame, period: Column, quantiles: tuple[float, ...] = (0.5, 0.95, 0.99), delta: int = DELTA) -> DataFrame:
    """Percentiles per group and ``period`` (an expression of ``day`` that gives a date) out of stored digests, without the samples.

    Result: ``grp, period, n, p50`` ..., and ``rank_bound_p50`` ...: how far the rank of the estimate can be from ``q * n`` at most, as a
    share of ``n``, which the least and greatest values of the clusters tell. Null groups and periods form groups of their own.
    """
    parts = digests.withColumn("day", period.cast("date"))
    merged = merged_digests(parts, ["grp", "day"], quantiles, delta)
    names = [_name(q) for q in quantiles]
    n = F.aggregate("weight", F.lit(0.0), lambda a, w: a + w)
    out = merged.withColumn("n", n)
    clusters = F.arrays_zip("low", "high", "weight")
    columns = [F.col("grp"), F.col("day").alias("period"), F.col("n").cast("bigint").alias("n")]
    columns += [F.get("estimates", F.lit(i)).alias(name) for i, name in enumerate(names)]

    def weight(of: Callable[[Column], Column]) -> Column:
        return F.aggregate(clusters, F.lit(0.0), lambda a, c: a + F.when(of(c), c["weight"]).otherwise(0.0))

    for i, (q, name) in enumerate(zip(quantiles, names)):
        x = F.get("estimates", F.lit(i))
        surely_up_to, perhaps_below = weight(partial(_under, x, "high", True)), weight(partial(_under, x, "low", False))
        columns.append((F.greatest(perhaps_below - F.col("n") * q, F.col("n") * q - surely_up_to, F.lit(0.0)) / F.col("n")).alias(f"rank_bound_{name}"))
    return out.select(*columns)
