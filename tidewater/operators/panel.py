"""The long market panel: loading rules, regular grids, calendars, as-of lookups and validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.sliced import by_slice, numbered, own_rows, with_halo
from tidewater.sources.tables import latest_rows

FIELDS = ("close", "high", "low", "volume", "bid", "ask")


class PanelError(ValueError):
    """Market data that the engine can't run on."""


def assert_columns(df: DataFrame, required: Sequence[str], what: str = "table") -> None:
    """Raise if a required column is missing."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise PanelError(f"{what} lacks the columns {', '.join(missing)}")


#: Time buckets by which bars are hashed, so that a hot symbol is spread over them.
BUCKET_SECONDS = 7 * 86_400


def load_bars(bars: DataFrame, buckets: bool = False) -> DataFrame:
    """The valid row of each ``(symbol, ts)``; a null bid or ask is the close.

    With ``buckets`` rows are hashed by symbol and ``bucket`` of time, for callers that go on by these.
    """
    assert_columns(bars, ["ts", "symbol", "close", "high", "low", "volume"], "bars")
    for side in ("bid", "ask"):
        if side not in bars.columns:
            bars = bars.withColumn(side, F.lit(None).cast("double"))
    rows = bars.where("symbol is not null and ts is not null").select("symbol", "ts", "src_order", *FIELDS)
    keys = ["symbol", "ts"]
    if buckets:
        rows = rows.withColumn("bucket", F.floor(F.col("ts") / BUCKET_SECONDS).cast("bigint")).repartition("symbol", "bucket")
        keys = ["symbol", "bucket", "ts"]
    rows = latest_rows(rows, keys, "src_order", list(FIELDS))
    return rows.withColumns({side: F.coalesce(side, "close") for side in ("bid", "ask")})


def usable_panel(bars: DataFrame) -> DataFrame:
    """Valid bars with a positive finite close, other gaps filled from it, and their ``row_idx`` within the symbol."""
    inf = F.lit(float("inf"))

    def sound(name: str, other: Column) -> Column:
        c = F.col(name)
        return F.when((c > 0) & (c < inf), c).otherwise(other).alias(name)

    close = F.col("close")
    rows = load_bars(bars, buckets=True).where((close > 0) & (close < inf))
    rows = rows.select("symbol", "bucket", "ts", "close", sound("high", close), sound("low", close), sound("volume", F.lit(0.0)), sound("bid", close), sound("ask", close))
    return numbered(rows, "symbol", "bucket", "ts").drop("bucket")


def densify_days(bars: DataFrame) -> DataFrame:
    """One row per symbol and UTC day from its first to its last bar: the day's last close and total volume.

    Days without a bar are present with a null close and volume 0; the skeleton is exploded per symbol, not crossed.
    """
    day = F.floor(F.col("ts") / 86_400).cast("bigint")
    daily = (
        usable_panel(bars)
        .groupBy("symbol", day.alias("epoch_day"))
        .agg(F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))
    )
    skeleton = daily.groupBy("symbol").agg(F.min("epoch_day").alias("a"), F.max("epoch_day").alias("b"))
    skeleton = skeleton.select("symbol", F.explode(F.sequence("a", "b")).alias("epoch_day"))
    return skeleton.join(daily, ["symbol", "epoch_day"], "left").withColumn("volume", F.coalesce("volume", F.lit(0.0)))


def session_mask(ts: Column, start_minute: int, end_minute: int, weekdays: Sequence[int], holidays: Sequence[int] = ()) -> Column:
    """Whether a UTC epoch second lies in the session: minutes inclusive at both ends, Monday is weekday 0."""
    day = F.floor(ts / 86_400)
    minute = F.floor(F.pmod(ts, F.lit(86_400)) / 60)
    inside = F.pmod(day + 3, F.lit(7)).isin(*weekdays) & minute.between(start_minute, end_minute)
    return inside & ~day.isin(*holidays) if holidays else inside


def simple_return(previous: Column, current: Column) -> Column:
    """``current / previous - 1``, 0 where there is no previous value or it is 0."""
    return F.coalesce(F.try_divide(current - previous, previous), F.lit(0.0))


def with_returns(panel: DataFrame) -> DataFrame:
    """The panel with ``ret``, the simple return from the row before."""
    return own_rows(sliced_returns(with_halo(panel, 1)))


def sliced_returns(panel: DataFrame) -> DataFrame:
    """``with_returns`` on a panel in slices."""
    return panel.withColumn("ret", simple_return(F.lag("close").over(by_slice()), F.col("close")))


def dense_asset_ids(symbols: DataFrame) -> DataFrame:
    """``symbol, asset``: ids from 0 in order of symbol. Works on the distinct symbols only, a dimension."""
    distinct = symbols.where("symbol is not null").select("symbol").distinct()
    return distinct.withColumn("asset", (F.row_number().over(Window.orderBy("symbol")) - 1).cast("bigint"))


#: Time buckets by which ticks are hashed.
TICK_BUCKET_NS = 3_600 * 10**9


def load_ticks(ticks: DataFrame) -> DataFrame:
    """Ticks with a symbol and a time, dense asset ids and sides in ``BID``, ``ASK``, ``TRADE`` (anything else reads as TRADE).

    A tick sent twice counts once, as first received. Rows are hashed by symbol and ``hour``, so that a hot symbol is spread over its hours.
    """
    side = F.upper(F.trim("side"))
    hour = F.floor(F.col("timestamp_ns") / F.lit(TICK_BUCKET_NS)).cast("bigint").alias("hour")
    tick = F.struct("src_order", "price", "size", F.when(side.isin("BID", "ASK"), side).otherwise("TRADE").alias("side")).alias("t")
    rows = ticks.where("symbol is not null and timestamp_ns is not null").select("symbol", hour, "timestamp_ns", tick).repartition("symbol", "hour")
    rows = rows.groupBy("symbol", "hour", "timestamp_ns").agg(F.min("t").alias("t")).select("symbol", "hour", "timestamp_ns", "t.*")
    return rows.join(dense_asset_ids(ticks), "symbol")


def load_actions(actions: DataFrame, assets: DataFrame) -> DataFrame:
    """Corporate actions of known symbols and types, with the symbol's asset id."""
    kind = F.upper(F.trim("action_type"))
    rows = actions.where("symbol is not null and ex_date_timestamp is not null and ratio_or_amount is not null")
    rows = rows.select("action_id", "symbol", "ex_date_timestamp", kind.alias("action_type"), "ratio_or_amount", "known_at")
    return rows.where(F.col("action_type").isin("SPLIT", "DIVIDEND", "SPINOFF", "DELISTING")).join(assets.select("symbol", "asset"), "symbol")


def as_of_forward(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, value: str) -> DataFrame:
    """Each left row with the first right row at or after it, or else the last one: adds ``row_ts`` and ``row_value``.

    Time is cut into buckets: a lookup meets the right rows of its own bucket, and else takes the first row of the next
    bucket that has any, or the last row of all, from one row a bucket. Keys without right rows give nulls.
    """
    bucket = lambda c: F.floor(F.col(c) / BUCKET_SECONDS).cast("bigint")
    r = right.select(F.col(key).alias("k"), bucket(right_ts).alias("b"), F.struct(F.col(right_ts).alias("t"), F.col(value).alias("v")).alias("r"))
    asked = left.select(F.col(key).alias("k"), F.col(left_ts).alias("at"), bucket(left_ts).alias("b")).where("k is not null and at is not null").distinct()
    ends = r.groupBy("k", "b").agg(F.min("r").alias("first"), F.max("r").alias("last"))
    nothing = ends.schema["first"].dataType
    marks = ends.unionByName(asked.select("k", "b", F.lit(None).cast(nothing).alias("first"), F.lit(None).cast(nothing).alias("last")).distinct())
    marks = marks.groupBy("k", "b").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    w = Window.partitionBy("k").orderBy("b")
    later = F.first("first", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    final = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    marks = marks.select("k", "b", F.coalesce(later, final).alias("other"))
    near = asked.join(r, ["k", "b"]).where("r.t >= at").groupBy("k", "at").agg(F.min("r").alias("near"))
    found = asked.join(marks, ["k", "b"], "left").join(near, ["k", "at"], "left").select("k", "at", F.coalesce("near", "other").alias("found"))
    out = left.join(found, (left[key] == found["k"]) & (left[left_ts] == found["at"]), "left")
    return out.select(*(left[c] for c in left.columns), F.col("found.t").alias("row_ts"), F.col("found.v").alias("row_value"))


def non_finite_counts(bars: DataFrame) -> DataFrame:
    """Per symbol and field the valid rows whose value is null, NaN or infinite."""
    counts = [F.count_if(F.col(f).isNull() | F.isnan(f) | (F.abs(f) == float("inf"))).alias(f"bad_{f}") for f in FIELDS]
    return load_bars(bars).groupBy("symbol").agg(*counts)


def require_finite(panel: DataFrame) -> DataFrame:
    """The panel unchanged, or PanelError if any field of any row is not finite."""
    bad = panel.where(F.greatest(*(F.coalesce(F.isnan(f) | (F.abs(f) == float("inf")), F.lit(True)) for f in FIELDS))).limit(1).count()
    if bad:
        raise PanelError("market data contains non-finite values")
    return panel


def price_jumps(bars: DataFrame, actions: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Bars whose return exceeds ``threshold`` without a split or dividend of the symbol going ex on that UTC day."""
    moved = with_returns(usable_panel(bars)).where(F.abs("ret") > threshold)
    moved = moved.withColumn("epoch_day", F.floor(F.col("ts") / 86_400).cast("bigint"))
    kind = F.upper(F.trim("action_type"))
    explained = actions.where(kind.isin("SPLIT", "DIVIDEND")).select("symbol", F.floor(F.col("ex_date_timestamp") / 86_400).cast("bigint").alias("epoch_day"))
    return moved.join(explained, ["symbol", "epoch_day"], "left_anti").select("symbol", "ts", "close", "ret")
