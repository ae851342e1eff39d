"""File sources with explicit schemas: bars, ticks, corporate actions, cost samples, ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.operators.panel import PanelError, assert_columns

_BAR_FIELDS = "close double, high double, low double, volume double, bid double, ask double"


def _csv(spark: SparkSession, path: str, kinds: dict[str, str], required: tuple[str, ...], what: str) -> DataFrame:
    """CSV columns by name and of given types; the header alone decides which optional ones are there."""
    head = spark.read.option("header", True).csv(path)
    assert_columns(head, required, what)
    return head.select(*(F.expr(f"try_cast(nullif(trim(`{c}`), '') as {k})").alias(c) if c in head.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()))


def _densified(rows: DataFrame) -> DataFrame:
    """Last row wins per ``(ts, symbol)``; bid and ask default to close; every symbol has a row at every time of the file.

    Files are bounded by what one writer wrote; the grid of their times and symbols is an equi-join on both.
    """
    last = rows.withColumn("n", F.row_number().over(Window.partitionBy("ts", "symbol").orderBy(F.desc("src_order")))).where("n = 1").drop("n", "src_order")
    times = last.groupBy("ts").agg(F.lit(1).alias("one"))
    everyone = last.select("symbol").distinct().agg(F.sort_array(F.collect_list("symbol")).alias("symbols")).withColumn("one", F.lit(1))
    grid = times.join(everyone, "one").select("ts", F.explode("symbols").alias("symbol"))
    full = grid.join(last, ["ts", "symbol"], "left").withColumn("volume", F.coalesce("volume", F.lit(0.0)))
    return full.withColumns({s: F.coalesce(s, "close") for s in ("bid", "ask")})


def _kinds(fields: str) -> dict[str, str]:
    return dict(f.split() for f in fields.split(", "))


def read_bars_csv(spark: SparkSession, path: str) -> DataFrame:
    """One long CSV file with ``timestamp, symbol, close, high, low, volume`` and optional ``bid, ask``.

    Absent cells have null prices and volume 0. The file's row order decides among duplicates, so it is read as one split.
    """
    required = ("timestamp", "symbol", "close", "high", "low", "volume")
    rows = _csv(spark, path, {"timestamp": "bigint", "symbol": "string"} | _kinds(_BAR_FIELDS), required, "bars file")
    return _densified(rows.withColumnRenamed("timestamp", "ts").withColumn("src_order", F.monotonically_increasing_id()))


def read_bars_directory(spark: SparkSession, path: str) -> DataFrame:
    """A folder with a CSV file per symbol, the symbol being the file's name without its ending."""
    required = ("timestamp", "close", "high", "low", "volume")
    head = spark.read.option("header", True).csv(path)
    assert_columns(head, required, "bars folder")
    kinds = {"timestamp": "bigint"} | _kinds(_BAR_FIELDS)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]+$", 1)
    rows = head.select(*(F.expr(f"try_cast(nullif(trim(`{c}`), '') as {k})").alias(c) if c in head.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()), F.url_decode(name).alias("symbol"))
    return _densified(rows.withColumnRenamed("timestamp", "ts").withColumn("src_order", F.monotonically_increasing_id()))


def read_bars_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Bars from Parquet; absent bid or ask columns are the close, null or NaN cells stay as they are."""
    rows = spark.read.parquet(path)
    if "timestamp" in rows.columns and "ts" not in rows.columns:
        rows = rows.withColumnRenamed("timestamp", "ts")
    assert_columns(rows, ["ts", "symbol", "close", "high", "low", "volume"], "bars file")
    for side in ("bid", "ask"):
        if side not in rows.columns:
            rows = rows.withColumn(side, F.col("close"))
    return rows.select("ts", "symbol", *_kinds(_BAR_FIELDS))


def read_actions_csv(spark: SparkSession, path: str, assets: DataFrame) -> DataFrame:
    """Corporate actions ``symbol, ex_date, action_type, value``; unknown symbols and types are dropped."""
    kinds = {"symbol": "string", "ex_date": "date", "action_type": "string", "value": "double"}
    rows = _csv(spark, path, kinds, tuple(kinds), "actions file").withColumn("action_type", F.upper(F.trim("action_type")))
    rows = rows.where(F.col("action_type").isin("SPLIT", "DIVIDEND", "SPINOFF", "DELISTING"))
    out = rows.join(assets.select("symbol", "asset"), "symbol")
    return out.select("asset", "symbol", F.unix_seconds(F.col("ex_date").cast("timestamp")).alias("ex_date_timestamp"), "action_type", F.col("value").alias("ratio_or_amount"))


def read_cost_samples_csv(spark: SparkSession, path: str) -> DataFrame:
    """Cost samples ``arrival_mid, fill_price, side, participation`` and optional ``quoted_spread_bps``."""
    kinds = {"arrival_mid": "double", "fill_price": "double", "side": "int", "participation": "double", "quoted_spread_bps": "double"}
    return _csv(spark, path, kinds, ("arrival_mid", "fill_price", "side", "participation"), "cost file")


def read_ledger_csv(spark: SparkSession, path: str) -> DataFrame:
    """A ledger as it was written, every column a string."""
    return spark.read.option("header", True).csv(path)


def adjusted_closes(raw: DataFrame) -> DataFrame:
    """Vendor bars (``symbol, ts, close, adj_close``) with ``adjustment`` = adjusted over raw, 1 where that is undefined."""
    ratio = F.try_divide("adj_close", "close")
    sound = ratio.isNotNull() & ~F.isnan(ratio) & (F.abs(ratio) != float("inf"))
    out = raw.withColumn("adjustment", F.when(sound, ratio).otherwise(1.0))
    return out.withColumn("adjusted", F.col("close") * F.col("adjustment"))


class UnavailableFeed:
    """A named live feed that this build has no connector for; every call says so."""

    def __init__(self, name: str) -> None:
        self.name = name

    def _refuse(self, *_):
        raise NotImplementedError(f"no connector for {self.name}; stream files, Kafka or a Python data source instead")

    next_tick = fetch_positions = submit_order = _refuse


__all__ = [n for n in dir() if n.startswith("read_")] + ["adjusted_closes", "PanelError", "UnavailableFeed"]
