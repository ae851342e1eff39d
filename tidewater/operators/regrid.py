"""Irregular readings onto a regular grid of minutes by a continuous-time Kalman smoother."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators.hmm import SIDE, SPIKE_AT, deviation
from tidewater.sources.tables import is_number

#: Cells (series times minutes) that are smoothed in one batch.
BATCH_CELLS = 200_000
MINUTE_NS = 60_000_000_000
MINUTES_A_DAY = 1_440

_OUT = "symbol string, minute_start bigint, missing boolean, n_readings bigint, last_price double, total_size double, fill_price double, fill_sd double"


def _moved(level, slope, p00, p01, p11, dt, level_q, slope_q):
    """Level and slope, and their covariance, ``dt`` minutes later."""
    return (
        level + dt * slope,
        slope,
        p00 + dt * (2 * p01 + dt * p11) + level_q * dt + slope_q * dt**3 / 3,
        p01 + dt * p11 + slope_q * dt**2 / 2,
        p11 + slope_q * dt,
    )


def minute_summaries(x: np.ndarray, at: np.ndarray, counts: np.ndarray, level_q: np.ndarray, slope_q: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """All readings of each minute in 14 numbers that give the same posterior as the readings one by one.

    x, at: readings in order of time and their places within the minute (0..1], minute after minute; counts: readings of
    each minute. Given the state s at its start, the state at its end is normal with mean A s + b and covariance C, and
    the readings' likelihood is exp(e's - s'Js/2). Rows: A (00, 01, 10, 11), b, C (00, 01, 11), J (00, 01, 11), e.
    """
    order = np.argsort(-counts, kind="stable")
    many, begin = counts[order], (np.cumsum(counts) - counts)[order]
    lq, sq, r = level_q[order], slope_q[order], noise[order]
    m = np.zeros((14, len(counts)))
    m[0] = m[3] = 1.0
    now = np.zeros(len(counts))

    def move(n: int, dt: np.ndarray) -> None:
        m[0, :n] += dt * m[2, :n]
        m[1, :n] += dt * m[3, :n]
        m[4:9, :n] = _moved(*m[4:9, :n], dt, lq[:n], sq[:n])

    for k in range(int(many[0]) if len(many) else 0):
        n = int(np.searchsorted(-many, -k, side="left"))  # minutes with more than k readings
        here = begin[:n] + k
        move(n, at[here] - now[:n])
        now[:n] = at[here]
        a00, a01, a10, a11, b0, b1, c00, c01, c11 = m[:9, :n]
        s = c00 + r[:n]
        gap = x[here] - b0
        g0, g1 = c00 / s, c01 / s
        m[9:14, :n] += a00 * a00 / s, a00 * a01 / s, a01 * a01 / s, a00 * gap / s, a01 * gap / s
        m[:9, :n] = (1 - g0) * a00, (1 - g0) * a01, a10 - g1 * a00, a11 - g1 * a01, b0 + g0 * gap, b1 + g1 * gap, (1 - g0) * c00, (1 - g0) * c01, c11 - g1 * c01
    move(len(counts), 1.0 - now)
    out = np.empty_like(m)
    out[:, order] = m
    return out


def smooth_summaries(summaries: np.ndarray, series: np.ndarray, step: np.ndarray, steps: int, first: np.ndarray, level_q: np.ndarray, slope_q: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed level and its variance at the end of each grid step, for many series at once.

    summaries: those of the minutes with readings, at ``(series, step)`` of the grid; first: the first reading of each series. A
    Kalman filter runs over the minutes, a Rauch-Tung-Striebel pass runs back over them.
    """
    g = len(first)
    el = np.zeros((14, steps, g))
    el[0], el[1], el[3] = 1.0, 1.0, 1.0  # a minute without readings only moves on
    el[6], el[7], el[8] = level_q + slope_q / 3, slope_q / 2, slope_q
    el[:, step, series] = summaries
    start, end = np.empty((steps, 5, g)), np.empty((steps, 5, g))
    level, slope = first.copy(), np.zeros(g)
    p00, p01, p11 = noise + level_q, np.zeros(g), slope_q + 1e-12
    for t in range(steps):
        a00, a01, a10, a11, b0, b1, c00, c01, c11, j00, j01, j11, e0, e1 = el[:, t]
        m00, m01, m10, m11 = 1 + p00 * j00 + p01 * j01, p00 * j01 + p01 * j11, p01 * j00 + p11 * j01, 1 + p01 * j01 + p11 * j11
        det = m00 * m11 - m01 * m10
        p00, p01, p11 = (m11 * p00 - m01 * p01) / det, (m11 * p01 - m01 * p11) / det, (m00 * p11 - m10 * p01) / det
        d0, d1 = e0 - j00 * level - j01 * slope, e1 - j01 * level - j11 * slope
        level, slope = level + p00 * d0 + p01 * d1, slope + p01 * d0 + p11 * d1
        start[t] = level, slope, p00, p01, p11
        level, slope = a00 * level + a01 * slope + b0, a10 * level + a11 * slope + b1
        x0, x1, y0, y1 = a00 * p00 + a01 * p01, a00 * p01 + a01 * p11, a10 * p00 + a11 * p01, a10 * p01 + a11 * p11
        p00, p01, p11 = x0 * a00 + x1 * a01 + c00, x0 * a10 + x1 * a11 + c01, y0 * a10 + y1 * a11 + c11
        end[t] = level, slope, p00, p01, p11
    out, var = np.empty((g, steps)), np.empty((g, steps))
    s0, s1, v00, v01, v11 = end[-1]
    for t in range(steps - 1, -1, -1):
        out[:, t], var[:, t] = s0, v00
        a00, a01, a10, a11 = el[:4, t]
        f0, f1, f00, f01, f11 = start[t]
        n0, n1, b00, b01, b11 = end[t]
        x00, x01 = f00 * a00 + f01 * a01, f00 * a10 + f01 * a11  # covariance of the state with its successor
        x10, x11 = f01 * a00 + f11 * a01, f01 * a10 + f11 * a11
        det = np.maximum(b00 * b11 - b01 * b01, 1e-300)
        c00, c01 = (x00 * b11 - x01 * b01) / det, (x01 * b00 - x00 * b01) / det
        c10, c11 = (x10 * b11 - x11 * b01) / det, (x11 * b00 - x10 * b01) / det
        d0, d1 = s0 - n0, s1 - n1
        e00, e01, e11 = v00 - b00, v01 - b01, v11 - b11
        s0, s1 = f0 + c00 * d0 + c01 * d1, f1 + c10 * d0 + c11 * d1
        t00, t01 = c00 * e00 + c01 * e01, c00 * e01 + c01 * e11
        t10, t11 = c10 * e00 + c11 * e01, c10 * e01 + c11 * e11
        v00, v01, v11 = f00 + t00 * c00 + t01 * c01, f01 + t00 * c10 + t01 * c11, f11 + t10 * c10 + t11 * c11
    return out, np.maximum(var, 0.0)


def smooth_on_grid(y: np.ndarray, at: np.ndarray, seen: np.ndarray, level_q: np.ndarray, slope_q: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``smooth_summaries`` of series with one reading a step at most.

    y, at, seen: (series, steps) reading, its place within the step (0..1], whether there is one.
    """
    g, steps = y.shape
    series, step = np.nonzero(seen)
    first = y[np.arange(g), np.argmax(seen, axis=1)]
    summaries = minute_summaries(y[seen] - first[series], at[seen], np.ones(len(series), dtype=int), level_q[series], slope_q[series], noise[series])
    out, var = smooth_summaries(summaries, series, step, steps, np.zeros(g), level_q, slope_q, noise)
    return out + first[:, None], var


def _noise_levels(x: np.ndarray, t: np.ndarray) -> tuple[float, float, float]:
    """Level and slope noise a minute and reading noise, from the changes between all readings.

    A change over ``dt`` minutes has variance ``q dt + 2 r`` and covariance ``-r`` with the next one, at any spacing. Both are
    weighted by what they tell and far changes are clipped, so q and r are found in a few rounds.
    """
    if len(x) < 3:
        return 1e-8, 1e-12, 1e-8
    d, dt = np.diff(x), np.maximum(np.diff(t), 1e-9)
    span = float(dt.mean())
    total = max(float(np.mean(np.minimum(d * d, np.quantile(d * d, 0.98)))), 1e-12)
    q, r = 0.5 * total / span, 0.25 * total
    for _ in range(6):
        v = q * dt + 2 * r
        far = 3 * np.sqrt(v)
        c = np.clip(d, -far, far)
        pair = 1.0 / (v[1:] * v[:-1])
        r = float(-np.sum(c[1:] * c[:-1] * pair) / np.sum(pair))
        r = float(np.clip(r, 0.02 * total, 0.5 * np.mean(c * c)))
        w = dt / (v * v)
        q = max(float(np.sum(w * (c * c - 2 * r)) / np.sum(w * dt)), 0.001 * total / span)
    return q, 1e-4 * (q + r), r


def _grid_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    rows = 0
    for pdf in batches:
        if not len(pdf):
            continue
        held.append(pdf)
        rows += len(pdf) + int(pdf["n_readings"].sum()) // 8
        if rows >= BATCH_CELLS // 2:
            pdf = pd.concat(held, ignore_index=True)
            last = (pdf["symbol"] == pdf["symbol"].iloc[-1]) & (pdf["day"] == pdf["day"].iloc[-1])
            ready = pdf[~last]
            if len(ready):
                yield from _smooth_frame(ready)
            held = [pdf[last]]
            rows = len(held[0]) + int(held[0]["n_readings"].sum()) // 8
    if held:
        yield from _smooth_frame(pd.concat(held, ignore_index=True))


def _smooth_frame(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    symbol, day = pdf["symbol"].to_numpy(), pdf["day"].to_numpy()
    minute = pdf["minute"].to_numpy()
    good = pdf["good_ns"].map(len).to_numpy("int64")
    price, ns = np.concatenate(pdf["good_price"].to_numpy()).astype(float), np.concatenate(pdf["good_ns"].to_numpy()).astype("int64")
    begin = np.append(0, np.cumsum(good))
    starts = np.flatnonzero(np.r_[True, (symbol[1:] != symbol[:-1]) | (day[1:] != day[:-1])])
    ends = np.append(starts[1:], len(pdf))
    length = (minute[ends - 1] - minute[starts] + 1).astype(int)
    order = np.argsort(length, kind="stable")
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and length[order[hi]] * (hi + 1 - lo) <= BATCH_CELLS:
            hi += 1
        ids = order[lo:hi]
        lo = hi
        g, steps = len(ids), int(length[ids].max())
        first, known = np.zeros(g), np.zeros(g, dtype=bool)
        level_q, slope_q, noise = np.empty(g), np.empty(g), np.empty(g)
        present = np.full((g, steps), -1)
        used: list[tuple[np.ndarray, ...]] = []
        for i, s in enumerate(ids):
            a, b = starts[s], ends[s]
            present[i, (minute[a:b] - minute[a]).astype(int)] = np.arange(a, b)
            x = np.log(price[begin[a] : begin[b]])
            when, slot = ns[begin[a] : begin[b]], np.repeat((minute[a:b] - minute[a]).astype(int), good[a:b])
            if len(x) > 2 * SIDE:  # readings that leave both sides don't steer the smoother
                step = np.abs(np.diff(x))
                away = np.abs(deviation(x))
                scale = max(np.median(step[step > 0]) if (step > 0).any() else 0.0, np.quantile(away, 0.95) / 1.25)
                fine = away <= SPIKE_AT * scale if scale > 0 else np.ones(len(x), dtype=bool)
                x, when, slot = x[fine], when[fine], slot[fine]
            at = (when - (minute[a] + slot) * MINUTE_NS + 1) / MINUTE_NS
            level_q[i], slope_q[i], noise[i] = _noise_levels(x, slot + at)
            if len(x):
                first[i], known[i] = x[0], True
                used.append((x - x[0], at, slot, np.full(len(x), i)))
        x, at, slot, series = (np.concatenate(c) for c in zip(*used)) if used else (np.zeros(0), np.zeros(0), np.zeros(0, int), np.zeros(0, int))
        cell, counts = np.unique(series * steps + slot, return_counts=True)
        series, slot = np.divmod(cell, steps)
        summaries = minute_summaries(x, at, counts, level_q[series], slope_q[series], noise[series])
        level, var = smooth_summaries(summaries, series, slot, steps, np.zeros(g), level_q, slope_q, noise)
        level += first[:, None]
        row, step = np.nonzero(np.arange(steps)[None, :] < length[ids][:, None])
        source = present[row, step]
        missing = source < 0
        pick = np.maximum(source, 0)
        known = known[row]
        fill = np.where(known, np.exp(level[row, step]), np.nan)
        start = starts[ids][row]
        out = pd.DataFrame(
            {
                "symbol": symbol[start],
                "minute_start": (minute[start] + step) * 60,
                "missing": missing,
                "n_readings": np.where(missing, 0, pdf["n_readings"].to_numpy()[pick]),
                "last_price": np.where(missing, np.nan, pdf["last_price"].to_numpy(float)[pick]),
                "total_size": np.where(missing, 0.0, pdf["total_size"].to_numpy(float)[pick]),
                "fill_price": fill,
                "fill_sd": np.where(known, fill * np.sqrt(var[row, step]), np.nan),
            }
        )
        for k in range(0, len(out), 50_000):
            yield out.iloc[k : k + 50_000]


def minute_readings(ticks: DataFrame) -> DataFrame:
    """Per symbol and minute with a reading: readings, last price, all usable prices and their times, total size.

    A reading is a tick with a symbol and a price that is neither null nor NaN; ticks sent twice count once. One exchange
    on ``(symbol, minute)`` serves the deduplication and the grouping, and spreads a hot symbol over its minutes.
    """
    good = (F.col("price") > 0) & (F.col("price") != F.lit(float("inf")))
    return (
        ticks.where(F.col("symbol").isNotNull() & F.col("timestamp_ns").isNotNull() & is_number("price"))
        .select("symbol", "timestamp_ns", "price", "size")
        .withColumn("minute", F.expr(f"(timestamp_ns - pmod(timestamp_ns, {MINUTE_NS}L)) div {MINUTE_NS}L"))
        .repartition("symbol", "minute")
        .groupBy("symbol", "minute", "timestamp_ns")
        .agg(F.max("price").alias("price"), F.max("size").alias("size"))
        .groupBy("symbol", "minute")
        .agg(
            F.count(F.lit(1)).alias("n_readings"),
            F.max_by("price", "timestamp_ns").alias("last_price"),
            F.sort_array(F.collect_list(F.when(good, F.struct("timestamp_ns", "price")))).alias("good"),
            F.coalesce(F.sum(F.when(~F.isnan("size"), F.col("size"))), F.lit(0.0)).alias("total_size"),
        )
        .withColumns({"good_price": F.col("good.price"), "good_ns": F.col("good.timestamp_ns")})
        .drop("good")
    )


def minute_grid(ticks: DataFrame) -> DataFrame:
    """A regular series of whole minutes per symbol and UTC day, from its first to its last minute with a reading.

    A symbol's day has at most 1,440 rows, which hold all usable readings of their minutes; the smoother takes every one of
    them at its own time.
    ``fill_price`` and ``fill_sd`` are the smoothed price at the minute's end and its standard deviation, for every
    minute; ``missing`` marks the minutes without a reading (``n_readings`` 0, ``last_price`` null, ``total_size`` 0). Prices
    that are not positive or infinite are readings but don't steer the smoother, nor do lone readings far off their
    surroundings; where a day has no usable price the fill is null. Ticks without symbol, time or price are ignored.
    """
    minutes = minute_readings(ticks).withColumn("day", F.expr(f"(minute - pmod(minute, {MINUTES_A_DAY})) div {MINUTES_A_DAY}"))
    laid = minutes.repartition("symbol", "day").sortWithinPartitions("symbol", "day", "minute")
    grid = laid.mapInPandas(_grid_batches, _OUT)
    null_nan = {c: F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("last_price", "fill_price", "fill_sd")}
    return grid.withColumns(null_nan)
