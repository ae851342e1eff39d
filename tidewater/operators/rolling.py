"""Totals over trailing calendar periods for every entity and day, days without activity included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.sources.tables import is_number

SECONDS_A_DAY = 86_400
#: Days that one step of the calendar holds at once, so that a span of any length (one absurd time makes a long one) is never one array.
CHUNK_DAYS = 4_096


def daily_totals(df: DataFrame, entity: str, ts: str, value: str, order: str | None = None) -> DataFrame:
    """``(entity, epoch_day, day_total, day_count)`` of the valid, non-missing values.

    With ``order``, of several rows with one ``(entity, ts)`` only the one with the largest ``order`` is valid.
    Both groupings share one exchange on ``(entity, epoch_day)``, so a hot entity is spread over its days. Rows
    without entity or time, and null or NaN values, are no activity.
    """
    rows = df.select(
        F.col(entity).alias("entity"),
        F.floor(F.col(ts) / SECONDS_A_DAY).cast("bigint").alias("epoch_day"),
        F.col(ts).alias("ts"),
        F.col(value).cast("double").alias("value"),
        *([F.col(order).alias("ord")] if order else []),
    ).where(F.col("entity").isNotNull() & F.col("ts").isNotNull())
    rows = rows.repartition("entity", "epoch_day")
    if order:
        rows = rows.groupBy("entity", "epoch_day", "ts").agg(F.max_by("value", "ord").alias("value"))
    return (
        rows.where(is_number("value"))
        .groupBy("entity", "epoch_day")
        .agg(F.sum("value").alias("day_total"), F.count("value").alias("day_count"))
    )


def rolling_totals(
    df: DataFrame,
    entity: str = "symbol",
    ts: str = "ts",
    value: str = "close",
    order: str | None = "src_order",
    periods: tuple[int, ...] = (7, 30),
) -> DataFrame:
    """Totals, averages and counts of ``value`` over the trailing ``periods`` (calendar days, today included).

    One row per entity and UTC day from the entity's first to its last active day. Every calendar date is joined
    with the daily totals of its trailing bounds; coarse buckets as wide as the longest period make that range
    join an equi-join: a date looks into its own bucket and the one before it, so it meets at most two buckets of
    candidates, and a hot entity is spread over its buckets. The longest period bounds the candidates of a date.

    Result: ``entity, epoch_day, is_active, total_<n>d, avg_<n>d, count_<n>d``. A period without activity has count 0,
    total 0.0 and a null average. Entities without any activity have no rows; an empty table gives no rows; other
    columns of ``df`` are ignored, whatever their names.
    """
    longest = max(periods)
    days = daily_totals(df, entity, ts, value, order)
    calendar = (
        days.groupBy("entity")
        .agg(F.min("epoch_day").alias("first_day"), F.max("epoch_day").alias("last_day"))
        .select("entity", "first_day", "last_day", F.explode(F.sequence(F.floor(F.col("first_day") / CHUNK_DAYS), F.floor(F.col("last_day") / CHUNK_DAYS))).alias("chunk"))
        .select("entity", F.explode(F.sequence(F.greatest("first_day", F.col("chunk") * CHUNK_DAYS), F.least("last_day", F.col("chunk") * CHUNK_DAYS + (CHUNK_DAYS - 1)))).alias("date"))
        .withColumn("own", F.floor(F.col("date") / longest).cast("bigint"))
        .select("entity", "date", F.explode(F.array(F.col("own"), F.col("own") - 1)).alias("bucket"))
    )
    facts = days.withColumn("bucket", F.floor(F.col("epoch_day") / longest).cast("bigint"))
    joined = calendar.join(facts, ["entity", "bucket"], "left").withColumn("age", F.col("date") - F.col("epoch_day"))
    aggs = [F.max(F.coalesce(F.col("age") == 0, F.lit(False))).alias("is_active")]
    for n in periods:
        inside = F.col("age").between(0, n - 1)
        aggs += [
            F.coalesce(F.sum(F.when(inside, F.col("day_total"))), F.lit(0.0)).alias(f"total_{n}d"),
            F.coalesce(F.sum(F.when(inside, F.col("day_count"))), F.lit(0)).alias(f"count_{n}d"),
        ]
    out = joined.groupBy("entity", "date").agg(*aggs)
    columns = [F.col("entity").alias(entity), F.col("date").alias("epoch_day"), F.col("is_active")]
    for n in periods:
        columns += [
            F.col(f"total_{n}d"),
            F.try_divide(F.col(f"total_{n}d"), F.col(f"count_{n}d")).alias(f"avg_{n}d"),
            F.col(f"count_{n}d"),
        ]
    return out.select(*columns)
