"""Incremental operators: watermarks and periods that are still open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def after_watermark(stored: DataFrame, source: DataFrame, key: str, at: str, floor: Column) -> DataFrame:
    """STR1: source rows later than their key's latest stored time (the floor where nothing is stored)."""
    mark = stored.groupBy(key).agg(F.max(at).alias("_mark"))
    return source.join(mark, key, "left").where(F.col(at) > F.coalesce(F.col("_mark"), floor)).drop("_mark")


def from_watermark(stored: DataFrame, source: DataFrame, key: str, at: str, item: str) -> DataFrame:
    """STR2: the same inclusively, without items already stored (same-day re-reads)."""
    mark = stored.groupBy(key).agg(F.max(at).alias("_mark"))
    late = source.join(mark, key, "left").where(F.col("_mark").isNull() | (F.col(at) >= F.col("_mark"))).drop("_mark")
    return late.join(stored.select(item).distinct(), item, "left_anti").select(*source.columns)


def open_or_missing(periods: DataFrame, done: DataFrame, current: Column) -> DataFrame:
    """STR4: the current period always, closed ones only if not done."""
    missing = periods.join(done, periods.columns, "left_anti")
    return missing.unionByName(periods.where(F.col("month") == current)).distinct()
