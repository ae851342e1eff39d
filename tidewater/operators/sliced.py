"""Windows over long series without holding a series in one task.

Rows of a series are numbered through counts per time bucket; windows of bounded reach then run in slices of rows with
copies of the rows before them; running aggregates combine what a slice has seen with the totals of the slices before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Rows of a slice.
SLICE_ROWS = 100_000


def numbered(rows: DataFrame, key: str, bucket: str, *order: str) -> DataFrame:
    """Adds ``row_idx``, each row's place from 0 in its series.

    Rows are numbered within ``(key, bucket)``; the buckets' counts, one row a bucket, give each bucket its first number.
    ``bucket`` must grow with ``order``; if ``rows`` are hashed by ``(key, bucket)``, the rows themselves move no more.
    """
    first = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(key, bucket).agg(F.count(F.lit(1)).alias("rows_of_bucket"))
    base = counts.select(key, bucket, F.coalesce(F.sum("rows_of_bucket").over(first), F.lit(0)).alias("first_of_bucket"))
    own = F.row_number().over(Window.partitionBy(key, bucket).orderBy(*order))
    out = rows.withColumn("place_in_bucket", own).join(base, [key, bucket])
    return out.withColumn("row_idx", (F.col("first_of_bucket") + F.col("place_in_bucket") - 1).cast("bigint")).drop("first_of_bucket", "place_in_bucket")


def with_halo(panel: DataFrame, back: int) -> DataFrame:
    """Adds ``slice`` and ``own``: each slice also gets copies (not ``own``) of the ``back`` rows before it."""
    if back >= SLICE_ROWS:
        raise ValueError("the window reaches further back than a slice")
    home = F.floor(F.col("row_idx") / SLICE_ROWS).cast("bigint")
    both = F.when(F.col("row_idx") % SLICE_ROWS >= SLICE_ROWS - back, F.array(home, home + 1)).otherwise(F.array(home))
    return panel.withColumn("slice", F.explode(both)).withColumn("own", F.col("slice") == home)


def own_rows(panel: DataFrame) -> DataFrame:
    """Without the copies and the columns that told them apart."""
    return panel.where("own").drop("own", "slice")


def by_slice(*key: str) -> WindowSpec:
    """The order of rows within a slice of a series."""
    return Window.partitionBy(*(key or ("symbol",)), "slice").orderBy("row_idx")


def running(df: DataFrame, key: tuple[str, ...], slice_: str, order: tuple[str, ...], aggs: dict[str, tuple[str, Column]]) -> DataFrame:
    """Adds running aggregates up to and including each row: ``{name: (kind, value)}``, kind being sum, max or last.

    ``last`` is the last non-null value. ``slice_`` must grow with ``order`` within ``key``. A slice's own part is a window over
    the slice; what came before is one row a slice, combined over the slices of the series and joined on (key, slice).
    """
    inside = Window.partitionBy(*key, slice_).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*key).orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*order)

    def over(kind: str, value: Column, w: WindowSpec) -> Column:
        return {"sum": F.sum(value), "max": F.max(value), "last": F.last(value, ignorenulls=True)}[kind].over(w)

    def total(kind: str, value: Column) -> Column:
        return {"sum": F.sum(value), "max": F.max(value), "last": F.max_by(value, F.when(value.isNotNull(), place))}[kind]

    laid = df.repartition(*key, slice_).withColumns({f"value_{n}": v for n, (_, v) in aggs.items()})
    totals = laid.groupBy(*key, slice_).agg(*(total(k, F.col(f"value_{n}")).alias(f"total_{n}") for n, (k, _) in aggs.items()))
    carried = totals.select(*key, slice_, *(over(k, F.col(f"total_{n}"), before).alias(f"before_{n}") for n, (k, _) in aggs.items()))
    out = laid.withColumns({n: over(k, F.col(f"value_{n}"), inside) for n, (k, _) in aggs.items()}).join(carried, [*key, slice_], "left")
    for n, (kind, _) in aggs.items():
        was, now = F.col(f"before_{n}"), F.col(n)
        both = {"sum": F.coalesce(was + now, was, now), "max": F.greatest(was, now), "last": F.coalesce(now, was)}[kind]
        out = out.withColumn(n, both)
    return out.drop(*(f"{p}_{n}" for n in aggs for p in ("value", "before")))
