"""Implausible readings of every source, found by a hidden Markov model over range-partitioned series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators.hmm import NORMS, bad_readings
from tidewater.runtime import cut_lineage

#: Rows of a range partition (the unit that one task holds), and readings on each side of a partition's border that
#: are decided with both sides at hand.
PARTITION_ROWS, HALO = 250_000, 2_048

_OUT = "kind tinyint, piece int, border int, own boolean, field tinyint, symbol string, ts bigint, value double, bad boolean, state tinyint, p_bad double, " + ", ".join(f"{n} double" for n in NORMS)
_FLAG, _OPEN = 0, 1


def series_of(df: DataFrame, field: int, source: str, ts: str, value: str, impossible, order: str) -> DataFrame:
    """Rows of one series field in the common form ``(field, symbol, ts, ord, value, bad)``."""
    return df.select(
        F.lit(field).cast("tinyint").alias("field"),
        F.col(source).alias("symbol"),
        F.col(ts).alias("ts"),
        F.col(order).alias("ord"),
        F.col(value).cast("double").alias("value"),
        F.coalesce(impossible, F.lit(False)).alias("bad"),
    )


def flag_readings(series: DataFrame, amounts: tuple[int, ...] = (), partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """The bad readings of ``series`` (see ``series_of``): ``field, symbol, ts, value, state, p_bad``.

    Of several rows with one ``(field, symbol, ts)`` the one with the largest ``ord`` is valid; null and NaN values are
    missing and no readings, rows without symbol or time are ignored. ``amounts`` lists the fields that hold amounts, for
    which zero is legal.

    One range partitioning on ``(field, symbol, ts)`` orders and deduplicates the series and splits a hot symbol over
    as many tasks as its rows need; the number of partitions follows the number of rows, which the files' footers tell. Each task
    scores its series; the readings within HALO of a border at which a series is cut are decided in a second, small step that
    holds both sides (about 4 * HALO rows a border) and takes what is normal from the longer of the two pieces. Every reading is
    decided exactly once. Series of at most SIDE usable readings have no normal behaviour to judge by; of them only impossible
    values and frozen runs are found. An empty table gives no rows.
    """
    rows = series.count()  # no column is needed for it, so no data are read
    series = series.where("symbol is not null and ts is not null")
    parts = max(1, -(-rows // partition_rows))
    if parts > 1:
        ordered = series.repartitionByRange(parts, "field", "symbol", "ts")
    else:
        ordered = series.coalesce(1)
    ordered = ordered.sortWithinPartitions("field", "symbol", "ts", F.desc("ord")).select("field", "symbol", "ts", "value", "bad")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [b for b in batches if b.num_rows]
        if kept:
            yield from _score_partition(pa.Table.from_batches(kept), TaskContext.get().partitionId(), parts, amounts)

    found = cut_lineage(ordered.mapInArrow(score, _OUT))

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable").reset_index(drop=True)
        pieces = pdf.groupby("piece")["readings"].first()
        norms = None
        if len(pdf) < pieces.sum():  # else the series is here whole
            norms = pdf.loc[[pdf["readings"].idxmax()], list(NORMS)].to_numpy(float)
        state, p, _ = bad_readings(pdf["value"].to_numpy(), pdf["bad"].to_numpy(bool), np.array([0]), np.array([pdf["field"].iloc[0] in amounts]), norms)
        out = pdf[["field", "symbol", "ts", "value"]].assign(state=state.astype("int8"), p_bad=p)
        return out[(state != 0) & pdf["own"].to_numpy(bool)]

    columns = ["field", "symbol", "ts", "value", "state", "p_bad"]
    at_borders = (
        found.where(F.col("kind") == _OPEN)
        .groupBy("field", "symbol", "border")
        .applyInPandas(settle, "field tinyint, symbol string, ts bigint, value double, state tinyint, p_bad double")
    )
    return found.where(F.col("kind") == _FLAG).select(*columns).unionByName(at_borders)


def _score_partition(t: pa.Table, pid: int, parts: int, amounts: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    field = t["field"].to_numpy()
    words = t["symbol"].combine_chunks().dictionary_encode()
    words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    code = words.indices.to_numpy()
    ts = t["ts"].to_numpy()
    value = pc.fill_null(t["value"], float("nan")).to_numpy()
    bad = t["bad"].to_numpy(zero_copy_only=False)

    same = (field[1:] == field[:-1]) & (code[1:] == code[:-1])
    first = np.r_[True, ~(same & (ts[1:] == ts[:-1]))]  # the valid row of each (symbol, ts)
    use = first & ~np.isnan(value)
    field, code, ts, value, bad = (x[use] for x in (field, code, ts, value, bad))
    n = len(ts)
    if not n:
        return
    starts = np.flatnonzero(np.r_[True, (field[1:] != field[:-1]) | (code[1:] != code[:-1])])
    ends = np.append(starts[1:], n)
    of = np.repeat(np.arange(len(starts)), ends - starts)
    state, p, norms = bad_readings(value, bad, starts, np.isin(field[starts], amounts))

    decided = np.ones(n, dtype=bool)
    opened: list[tuple[np.ndarray, int, np.ndarray]] = []  # rows, border, own

    def leave_open(lo: int, hi: int, own_lo: int, own_hi: int, border: int) -> None:
        at = np.arange(lo, hi)
        own = (at >= own_lo) & (at < own_hi)
        decided[at[own]] = False
        opened.append((at, border, own))

    lo, hi = int(starts[0]), int(ends[0])
    whole = hi - lo < 4 * HALO
    if pid > 0:
        leave_open(lo, hi if whole else lo + 2 * HALO, lo, hi if whole else lo + HALO, pid)
    last_lo, last_hi = int(starts[-1]), int(ends[-1])
    if pid < parts - 1:
        short = last_hi - last_lo < 4 * HALO
        taken = short and pid > 0 and len(starts) == 1  # already decided at the border before
        leave_open(
            last_lo if short else last_hi - 2 * HALO, last_hi, last_hi if taken else last_lo if short else last_hi - HALO, last_hi, pid + 1
        )

    at = np.flatnonzero(decided & (state != 0))
    picked = [(at, np.full(len(at), _FLAG), np.full(len(at), -1), np.ones(len(at), dtype=bool))]
    picked += [(a, np.full(len(a), _OPEN), np.full(len(a), b), own) for a, b, own in opened]
    at, kind, border, own = (np.concatenate(x) for x in zip(*picked))
    out = pa.table(
        {
            "kind": pa.array(kind, pa.int8()),
            "piece": pa.array(np.full(len(at), pid), pa.int32()),
            "border": pa.array(border, pa.int32()),
            "own": pa.array(own),
            "field": pa.array(field[at], pa.int8()),
            "symbol": words.dictionary.take(pa.array(code[at])).cast(pa.string()),
            "ts": pa.array(ts[at]),
            "value": pa.array(value[at]),
            "bad": pa.array(bad[at]),
            "state": pa.array(state[at].astype("int8"), pa.int8()),
            "p_bad": pa.array(p[at]),
        }
        | {name: pa.array(norms[of[at], i]) for i, name in enumerate(NORMS)}
    )
    yield from out.to_batches(max_chunksize=20_000)


CLOSE, VOLUME, PRICE = 0, 1, 2
FIELD_NAMES = ("close", "volume", "price")
STATE_NAMES = ("normal", "spike", "stuck", "out_of_range")


def close_series(bars: DataFrame) -> DataFrame:
    """The close series with its hard bounds."""
    close = F.col("close")
    outside = F.coalesce((close < F.col("low")) & ~F.isnan("low"), F.lit(False)) | F.coalesce(
        (close > F.col("high")) & ~F.isnan("high"), F.lit(False)
    )
    return series_of(bars, CLOSE, "symbol", "ts", "close", (close <= 0) | (close == F.lit(float("inf"))) | outside, "src_order")


def market_series(bars: DataFrame, ticks: DataFrame) -> DataFrame:
    """The close, volume and tick price series with their hard bounds.

    A close or price must be positive and finite, a close within its own row's low and high where these are known, and
    a volume finite and not negative.
    """
    inf = F.lit(float("inf"))
    volume, price = F.col("volume"), F.col("price")
    return (
        close_series(bars)
        .unionByName(series_of(bars, VOLUME, "symbol", "ts", "volume", (volume < 0) | (volume == inf), "src_order"))
        .unionByName(series_of(ticks, PRICE, "symbol", "timestamp_ns", "price", (price <= 0) | (price == inf), "src_order"))
    )


def bad_market_readings(bars: DataFrame, ticks: DataFrame) -> DataFrame:
    """Every bad reading of bars and ticks: ``record_kind, symbol, ts, field_name, value, verdict, p_bad``."""
    flagged = flag_readings(market_series(bars, ticks), amounts=(VOLUME,))
    name = F.element_at(F.array(*map(F.lit, FIELD_NAMES)), F.col("field").cast("int") + 1)
    verdict = F.element_at(F.array(*map(F.lit, STATE_NAMES)), F.col("state").cast("int") + 1)
    return flagged.select(
        F.when(F.col("field") == PRICE, "ticks").otherwise("bars").alias("record_kind"),
        "symbol",
        "ts",
        name.alias("field_name"),
        "value",
        verdict.alias("verdict"),
        "p_bad",
    )


def bad_closes(bars: DataFrame) -> DataFrame:
    """``symbol, ts`` of the closes that cannot be true."""
    return flag_readings(close_series(bars)).select("symbol", "ts")
