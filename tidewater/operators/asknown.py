"""Attributes as they were in force and already known at each event's time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_known_join(
    events: DataFrame,
    changes: DataFrame,
    *,
    entity: str = "symbol",
    ts: str = "ts",
    effective: str = "ex_date_timestamp",
    known: str = "known_at",
    tie: str = "action_id",
    attributes: tuple[str, ...] = ("ratio_or_amount",),
    period: int = 7 * 86_400,
    keep_unmatched: bool = True,
) -> DataFrame:
    """Every distinct ``(entity, ts)`` of ``events`` with the attributes in force and known at that time.

    A change is visible from ``max(effective, known)`` on; of the visible ones the one with the latest ``effective``,
    then ``known``, then ``tie`` is in force. Instead of meeting all changes of its entity, an event meets the
    snapshot of what was in force when its period began, plus the change log of that period:

    1. per entity and period the strongest change (map-side combined) feeds a running maximum over the periods in
       which the entity has events: the periodic snapshots. A window row is a period, not a change or an event.
    2. snapshots and the changes of the period form one log, keyed by ``(entity, period)``; events join it on that
       key with ``visible <= ts`` and keep the strongest row. The final aggregation needs no further exchange.

    A hot entity is spread over its periods; adaptive skew handling splits what is left. Changes with a null entity,
    effective or known time are ignored; events with a null entity or time have no attributes (and are kept once if
    ``keep_unmatched``). Changes that tie in all three fields are equal copies. Other columns are ignored.
    """
    log = changes.select(
        F.col(entity).alias("entity"),
        F.struct(
            F.col(effective).cast("bigint").alias("effective"),
            F.col(known).cast("bigint").alias("known"),
            F.col(tie).alias("tie"),
            *(F.col(a).alias(f"attr_{i}") for i, a in enumerate(attributes)),
        ).alias("state"),
        F.greatest(F.col(effective), F.col(known)).cast("bigint").alias("visible"),
        (F.col(effective).isNotNull() & F.col(known).isNotNull() & F.col(entity).isNotNull()).alias("usable"),
    ).where("usable").drop("usable").withColumn("period", _period(F.col("visible"), period))

    happened = events.select(F.col(entity).alias("entity"), F.col(ts).cast("bigint").alias("ts")).withColumn(
        "period", _period(F.col("ts"), period)
    )
    needed = happened.where("entity is not null and ts is not null").select("entity", "period").distinct()
    strongest = log.groupBy("entity", "period").agg(F.max("state").alias("state"))
    before = Window.partitionBy("entity").orderBy("period").rangeBetween(Window.unboundedPreceding, -1)
    snapshots = (
        needed.select("entity", "period", F.lit(None).cast(strongest.schema["state"].dataType).alias("state"), F.lit(True).alias("asked"))
        .unionByName(strongest.withColumn("asked", F.lit(False)))
        .withColumn("state", F.max("state").over(before))
        .where(F.col("asked") & F.col("state").isNotNull())
        .select("entity", "period", F.lit(None).cast("bigint").alias("visible"), "state")
    )
    known_log = snapshots.unionByName(log.select("entity", "period", "visible", "state"))
    joined = (
        happened.alias("e")
        .join(
            known_log.alias("k"),
            (F.col("e.entity") == F.col("k.entity"))
            & (F.col("e.period") == F.col("k.period"))
            & (F.col("k.visible").isNull() | (F.col("k.visible") <= F.col("e.ts"))),
            "left" if keep_unmatched else "inner",
        )
        .groupBy(F.col("e.entity").alias("entity"), F.col("e.period").alias("period"), F.col("e.ts").alias("ts"))
        .agg(F.max("k.state").alias("state"))
    )
    return joined.select(
        F.col("entity").alias(entity),
        F.col("ts").alias(ts),
        F.col("state.tie").alias(tie),
        F.col("state.effective").alias(effective),
        F.col("state.known").alias(known),
        *(F.col(f"state.attr_{i}").alias(a) for i, a in enumerate(attributes)),
    )


def _period(column: Column, width: int) -> Column:
    return F.floor(column / width).cast("bigint")


def usable_splits(actions: DataFrame) -> DataFrame:
    """The split rows that can be in force: type SPLIT after trimming and upper-casing, ratio above zero."""
    ratio = F.col("ratio_or_amount")
    return actions.where(
        (F.upper(F.trim(F.col("action_type"))) == "SPLIT") & (ratio > 0) & ~F.isnan(ratio)
    )
