"""Ordered operators: islands, merged intervals, stations, ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_intervals(df: DataFrame, group: list[str], low: str, high: str, value: str) -> DataFrame:
    """Overlapping intervals of a group as one, with the largest value: a new island starts where low exceeds all highs before.

    Null bounds come last; an interval without a low bound overlaps none. Equal intervals are one whatever their order.
    """
    w = Window.partitionBy(*group).orderBy(F.asc_nulls_last(low), F.asc_nulls_last(high))
    before = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col(low) <= before, 0).otherwise(1)
    rows = df.withColumn("_new", fresh).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return rows.groupBy(*group, "island").agg(F.min(low).alias(low), F.max(high).alias(high), F.max(value).alias(value))


def runs(df: DataFrame, group: list[str], order: list[str], key: str, length: str) -> DataFrame:
    """Runs of equal key along an ordered group, with their lengths."""
    w = Window.partitionBy(*group).orderBy(*order)
    change = F.when(F.lag(key).over(w).eqNullSafe(F.col(key)), 0).otherwise(1)
    rows = df.withColumn("_c", change).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return rows.groupBy(*group, "run", key).agg(F.sum(length).alias("total"))


def stations(df: DataFrame, group: list[str], order: list[str], length: str) -> DataFrame:
    """Each row with where it begins along its group."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("station", F.coalesce(F.sum(length).over(w), F.lit(0)).cast("long"))
