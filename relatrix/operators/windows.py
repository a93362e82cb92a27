"""Ordered analytics over windows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def top_per_group(rows: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """WIN1, WIN3, WIN7, TOP5: the first n rows of each group."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def change_from_previous(prices: DataFrame) -> DataFrame:
    """WIN4: change of each kept close against the one before, in percent; a value that comes with the row (``given``) wins.

    NULL closes drop out; a zero base, and the first close, give NULL.
    """
    w = Window.partitionBy("corp").orderBy("day", "seq")
    rows = prices.where("close is not null").withColumn("previous", F.lag("close").over(w))
    own = F.when(F.col("previous") != 0, (F.col("close") - F.col("previous")) / F.col("previous") * 100)
    return rows.withColumn("change", F.coalesce("given", own) if "given" in prices.columns else own)


def incremental_change(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """WIN5: changes within a batch, the first against the last stored close before it (as-of); zero closes are skipped.

    Where there is nothing to compare with, the source's own share (``share``: below 1 a fraction, else percent) is taken.
    """
    first = batch.groupBy("corp").agg(F.min("day").alias("from_day"))
    seed = stored.where("close is not null and close <> 0").join(first, "corp").where("day < from_day").groupBy("corp").agg(F.max_by("close", F.struct("day", "seq")).alias("seed"))
    w = Window.partitionBy("corp").orderBy("day", "seq")
    rows = batch.where("close is not null and close <> 0").join(seed, "corp", "left").withColumn("previous", F.coalesce(F.lag("close").over(w), F.col("seed")))
    own = F.when(F.col("previous") != 0, (F.col("close") - F.col("previous")) / F.col("previous") * 100)
    if "share" in batch.columns:
        own = F.coalesce(own, F.when(F.abs("share") < 1, F.col("share") * 100).otherwise(F.col("share")))
    return rows.withColumn("change", own).drop("seed")


def spark_line(prices: DataFrame, n: int = 30) -> DataFrame:
    """WIN6: the last n closes in order of time."""
    kept = top_per_group(prices.where("close is not null"), ["corp"], [F.desc("day"), F.desc("seq")], n)
    return kept.groupBy("corp").agg(F.array_sort(F.collect_list(F.struct("day", "seq", "close"))).alias("a")).select("corp", F.expr("transform(a, x -> x.close)").alias("line"))


def dropped_between_runs(snapshots: DataFrame, keys: list[str]) -> DataFrame:
    """WIN9, SET3: distinct keys of the run before the latest that the latest lacks; fewer than two runs give none."""
    runs = snapshots.select("corp", "run_ts").distinct().withColumn("age", F.dense_rank().over(Window.partitionBy("corp").orderBy(F.desc("run_ts")))).where("age <= 2")
    two = snapshots.join(runs, ["corp", "run_ts"])
    before, latest = two.where("age = 2"), two.where("age = 1")
    return before.select("corp", *keys).distinct().join(latest.select("corp", *keys).distinct(), ["corp", *keys], "left_anti")


def by_report_priority(rows: DataFrame, keys: list[str]) -> DataFrame:
    """WIN10: of equal keys the row of the highest report; arrival breaks ties."""
    prio = F.coalesce(*[F.when(F.col("report") == c, F.lit(p)) for c, p in S.REPORT_PRIORITY.items()], F.lit(0))
    return rows.groupBy(*keys).agg(F.min_by(F.struct("report", "value", "seq"), F.struct((-prio).alias("p"), "seq")).alias("r")).select(*keys, "r.*")


def year_on_year(series: DataFrame) -> DataFrame:
    """WIN12: change against the same quarter a year back, else against the quarter before."""
    w = Window.partitionBy("corp", "account").orderBy("year", "quarter")
    base = F.coalesce(F.lag("value", 4).over(w), F.lag("value", 1).over(w))
    return series.withColumn("base", base).withColumn("change", S.change_percent(F.col("value"), F.col("base")))


def within_budget(rows: DataFrame, by: str, order: list, size: str, limit: int) -> DataFrame:
    """WIN15: the leading rows of a group until the sum of sizes would pass the limit."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("held", F.sum(size).over(w)).where(F.col("held") <= limit)


def ring_layout(links: DataFrame) -> DataFrame:
    """WIN18: angle and ring of each neighbour by its rank in its group."""
    w = Window.partitionBy("src", "grp")
    rank = F.row_number().over(w.orderBy(F.desc("weight"), "dst"))
    angle = (F.col("rank") - 1) * F.lit(2 * math.pi) / F.count("*").over(w)
    return links.withColumn("rank", rank).withColumn("ring", F.floor((F.col("rank") - 1) / 8).cast("int")).withColumn("angle", angle)
