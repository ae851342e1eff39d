"""Queries of the time-series data problems, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators.asknown import as_known_join, usable_splits
from tidewater.operators.digest import certified_percentiles, combined_percentiles, day_digests
from tidewater.operators.readings import bad_market_readings
from tidewater.operators.regrid import minute_grid
from tidewater.operators.rolling import rolling_totals
from tidewater.runtime import cut_lineage
from tidewater.sources.tables import table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    bad = bad_market_readings(table(spark, root, "bars"), table(spark, root, "ticks"))
    return bad.select("record_kind", "symbol", "ts", "field_name")


def p1_verdicts(spark: SparkSession, root: str) -> DataFrame:
    return bad_market_readings(table(spark, root, "bars"), table(spark, root, "ticks"))


def p2_percentiles(spark: SparkSession, root: str) -> DataFrame:
    return certified_percentiles(table(spark, root, "latency_samples"))


def p1_out_of_range(spark: SparkSession, root: str) -> DataFrame:
    """The readings outside hard bounds, which SQL can tell as well."""
    return p1_verdicts(spark, root).where("verdict = 'out_of_range'").select("record_kind", "symbol", "ts", "field_name")


def p2_certified(spark: SparkSession, root: str) -> DataFrame:
    """Measurements of every stage and day, and whether all percentiles' exact rank errors are within the bound."""
    return certified_percentiles(table(spark, root, "latency_samples")).select("level", "stage", F.col("run_date").cast("string").alias("run_date"), "n", "certified")


def p2_day_digests(spark: SparkSession, root: str) -> DataFrame:
    """The digests of every stage and day as they are stored."""
    return day_digests(table(spark, root, "latency_samples"))


def p2_weeks(spark: SparkSession, root: str) -> DataFrame:
    """Percentiles per stage and week out of written day digests, with the bound that the digests give themselves."""
    stored = cut_lineage(p2_day_digests(spark, root))
    return combined_percentiles(stored, F.date_trunc("week", F.col("day"))).withColumnsRenamed({"grp": "stage", "period": "week"})


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return minute_grid(table(spark, root, "ticks")).where("missing").select("symbol", "minute_start")


def p3_grid(spark: SparkSession, root: str) -> DataFrame:
    return minute_grid(table(spark, root, "ticks"))


def p3_presence(spark: SparkSession, root: str) -> DataFrame:
    """The grid's counts, last prices and sizes, which SQL can tell as well."""
    return minute_grid(table(spark, root, "ticks")).select("symbol", "minute_start", "missing", "n_readings", "last_price", F.round("total_size", 4).alias("total_size"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    joined = as_known_join(
        table(spark, root, "bars"), usable_splits(table(spark, root, "corporate_actions")), keep_unmatched=False
    )
    return joined.select("symbol", "ts", "action_id")


def p4_as_known(spark: SparkSession, root: str) -> DataFrame:
    joined = as_known_join(table(spark, root, "bars"), usable_splits(table(spark, root, "corporate_actions")))
    return joined.select("symbol", "ts", "action_id", F.col("ratio_or_amount").alias("split_ratio"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return rolling_totals(table(spark, root, "bars")).where(~F.col("is_active")).select("symbol", "epoch_day")


def p5_rolling(spark: SparkSession, root: str) -> DataFrame:
    out = rolling_totals(table(spark, root, "bars"))
    columns = ["symbol", "epoch_day", "is_active"]
    for n in (7, 30):  # averages of the rounded totals, so that the order of summation doesn't show
        total, count = F.round(f"total_{n}d", 6), F.col(f"count_{n}d")
        columns += [total.alias(f"total_{n}d"), F.try_divide(total, count).alias(f"avg_{n}d"), count]
    return out.select(*columns)


_VALID = """valid AS (SELECT symbol, ts, arg_max_null(close, src_order) AS close FROM bars
  WHERE symbol IS NOT NULL AND ts IS NOT NULL GROUP BY symbol, ts)"""

_P3 = """WITH mins AS (SELECT DISTINCT symbol, timestamp_ns // 60000000000 AS m FROM ticks
  WHERE symbol IS NOT NULL AND price IS NOT NULL AND NOT isnan(price)),
spans AS (SELECT symbol, m // 1440 AS d, min(m) AS a, max(m) AS b FROM mins GROUP BY 1, 2),
grid AS (SELECT symbol, unnest(range(a, b + 1)) AS m FROM spans)
SELECT grid.symbol, grid.m * 60 AS minute_start FROM grid ANTI JOIN mins ON grid.symbol = mins.symbol AND grid.m = mins.m"""

_P4 = """WITH ev AS (SELECT DISTINCT symbol, ts FROM bars),
sp AS (SELECT * FROM corporate_actions WHERE upper(trim(action_type)) = 'SPLIT' AND ratio_or_amount > 0
  AND NOT isnan(ratio_or_amount) AND ex_date_timestamp IS NOT NULL AND known_at IS NOT NULL),
hit AS (SELECT ev.symbol, ev.ts, sp.action_id, sp.ratio_or_amount, row_number() OVER (PARTITION BY ev.symbol, ev.ts
  ORDER BY sp.ex_date_timestamp DESC, sp.known_at DESC, sp.action_id DESC) AS rn
  FROM ev JOIN sp ON ev.symbol = sp.symbol AND sp.ex_date_timestamp <= ev.ts AND sp.known_at <= ev.ts)
"""

_P5 = f"""WITH {_VALID},
days AS (SELECT symbol, ts // 86400 AS d, sum(close) AS s, count(*) AS n FROM valid
  WHERE close IS NOT NULL AND NOT isnan(close) GROUP BY 1, 2),
cal AS (SELECT symbol, unnest(range(min(d), max(d) + 1)) AS d FROM days GROUP BY symbol),
filled AS (SELECT cal.symbol, cal.d, days.s, days.n FROM cal LEFT JOIN days ON cal.symbol = days.symbol AND cal.d = days.d),
roll AS (SELECT symbol, d, n IS NOT NULL AS is_active,
  coalesce(sum(s) OVER w7, 0) AS t7, coalesce(sum(n) OVER w7, 0) AS n7,
  coalesce(sum(s) OVER w30, 0) AS t30, coalesce(sum(n) OVER w30, 0) AS n30
  FROM filled WINDOW w7 AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
  w30 AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
"""

QUERIES = {
    "p1_found": p1_found,
    "p1_verdicts": p1_verdicts,
    "p1_out_of_range": p1_out_of_range,
    "p2_percentiles": p2_percentiles,
    "p2_certified": p2_certified,
    "p2_day_digests": p2_day_digests,
    "p2_weeks": p2_weeks,
    "p3_found": p3_found,
    "p3_grid": p3_grid,
    "p3_presence": p3_presence,
    "p4_found": p4_found,
    "p4_as_known": p4_as_known,
    "p5_found": p5_found,
    "p5_rolling": p5_rolling,
}

_P1 = """WITH v AS (SELECT * FROM bars WHERE symbol IS NOT NULL AND ts IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY src_order DESC) = 1),
c AS (SELECT symbol, ts FROM v WHERE close IS NOT NULL AND NOT isnan(close) AND (close <= 0 OR isinf(close) OR (NOT isnan(low) AND close < low) OR (NOT isnan(high) AND close > high))),
t AS (SELECT * FROM ticks WHERE symbol IS NOT NULL AND timestamp_ns IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, timestamp_ns ORDER BY src_order DESC) = 1)
SELECT 'bars' AS record_kind, symbol, ts, 'close' AS field_name FROM c
UNION ALL SELECT 'bars', symbol, ts, 'volume' FROM v WHERE NOT isnan(volume) AND (volume < 0 OR isinf(volume))
UNION ALL SELECT 'ticks', symbol, timestamp_ns, 'price' FROM t WHERE NOT isnan(price) AND (price <= 0 OR isinf(price))"""

_P2 = """WITH s AS (SELECT arg_min({'stage': stage, 'run_date': run_date}, elapsed_seconds) AS k FROM latency_samples
  WHERE elapsed_seconds >= 0 AND NOT isnan(elapsed_seconds) AND NOT isinf(elapsed_seconds) GROUP BY run_id, sample_no)
SELECT 'group_day' AS level, k.stage AS stage, k.run_date::VARCHAR AS run_date, count(*) AS n, true AS certified FROM s GROUP BY ALL
UNION ALL SELECT 'group', k.stage, NULL, count(*), true FROM s GROUP BY ALL"""

_P3_PRESENCE = """WITH tk AS (SELECT symbol, timestamp_ns, max(price) AS price, max(size) AS size FROM ticks
  WHERE symbol IS NOT NULL AND timestamp_ns IS NOT NULL AND price IS NOT NULL AND NOT isnan(price) GROUP BY ALL),
mins AS (SELECT symbol, timestamp_ns // 60000000000 AS m, count(*) AS n, arg_max(price, timestamp_ns) AS p,
  coalesce(sum(size) FILTER (WHERE NOT isnan(size)), 0) AS z FROM tk GROUP BY ALL),
grid AS (SELECT symbol, unnest(range(min(m), max(m) + 1)) AS m FROM mins GROUP BY symbol, m // 1440)
SELECT grid.symbol, grid.m * 60 AS minute_start, n IS NULL AS missing, coalesce(n, 0) AS n_readings, p AS last_price, round(coalesce(z, 0), 4) AS total_size
FROM grid LEFT JOIN mins ON grid.symbol = mins.symbol AND grid.m = mins.m"""

ORACLES = {
    "p1_out_of_range": _P1,
    "p2_certified": _P2,
    "p3_presence": _P3_PRESENCE,
    "p3_found": _P3,
    "p4_found": _P4 + "SELECT symbol, ts, action_id FROM hit WHERE rn = 1",
    "p4_as_known": _P4
    + "SELECT ev.symbol, ev.ts, hit.action_id, hit.ratio_or_amount AS split_ratio FROM ev LEFT JOIN hit"
    " ON hit.symbol = ev.symbol AND hit.ts = ev.ts AND hit.rn = 1",
    "p5_found": _P5 + "SELECT symbol, d AS epoch_day FROM roll WHERE NOT is_active",
    "p5_rolling": _P5
    + """SELECT symbol, d AS epoch_day, is_active, round(t7, 6) AS total_7d,
  CASE WHEN n7 > 0 THEN round(t7, 6) / n7 END AS avg_7d, round(t30, 6) AS total_30d,
  CASE WHEN n30 > 0 THEN round(t30, 6) / n30 END AS avg_30d, n7::BIGINT AS count_7d, n30::BIGINT AS count_30d FROM roll""",
}
