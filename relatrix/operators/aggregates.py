"""Aggregations: daily metrics, best rows, quarters, series, coverage, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def mention_daily(docs: DataFrame) -> DataFrame:
    """AGG1, STR7: documents of a company a day, with their sorted ids as lineage; undated ones are left out."""
    return docs.where("ts is not null").groupBy("corp", "day").agg(F.count("*").alias("mentions"), F.array_sort(F.collect_list("doc_id")).alias("doc_ids"))


def label_daily(docs: DataFrame, labels: list[str]) -> DataFrame:
    """AGG2: one counter a label."""
    return docs.groupBy("corp", "day").agg(*[F.count_if(F.col("label") == x).alias(x) for x in labels])


def best_row(rows: DataFrame, keys: list[str]) -> DataFrame:
    """AGG8: consolidated statements first, then the larger absolute value, then arrival; NULL values never."""
    order = F.struct((F.col("fs") != "CFS").alias("a"), (-F.abs("value")).alias("b"), F.col("seq").alias("c"))
    return rows.where("value is not null").groupBy(*keys).agg(F.min_by(F.struct("fs", "value", "seq"), order).alias("r")).select(*keys, "r.fs", "r.value", "r.seq")


def headline(rows: DataFrame) -> DataFrame:
    """AGG9: of each company and account the latest year's best row."""
    order = F.struct(F.col("year"), (F.col("fs") == "CFS").alias("cfs"), F.abs("value").alias("v"), (-F.col("seq")).alias("s"))
    return rows.where("value is not null").groupBy("corp", "account").agg(F.max_by(F.struct("year", "fs", "value"), order).alias("r")).select("corp", "account", "r.*")


def quarters(rows: DataFrame, stock_accounts: list[str]) -> DataFrame:
    """AGG10: quarter values; a flow account's fourth quarter is the year less the first three, or nothing."""
    best = best_row(rows, ["corp", "account", "year", "report"])
    wide = best.groupBy("corp", "account", "year").agg(*[F.max(F.when(F.col("report") == code, F.col("value"))).alias(f"q{q}") for code, q in S.REPORT_QUARTER.items()], F.max(F.when(F.col("fs") == "CFS", "CFS").otherwise("OFS")).alias("_fs"), F.max((F.col("fs") == "CFS")).alias("_cfs"))
    q4 = F.when(F.col("account").isin(stock_accounts), F.col("q4")).otherwise(F.col("q4") - (F.col("q1") + F.col("q2") + F.col("q3")))
    wide = wide.withColumn("q4", q4).withColumn("fs", F.when(F.col("_cfs"), "CFS").otherwise("OFS"))
    return wide.unpivot(["corp", "account", "year", "fs"], ["q1", "q2", "q3", "q4"], "quarter", "value").where("value is not null")


def shareholders(rows: DataFrame) -> DataFrame:
    """AGG6, FIL6: of each normalised holder the row with the larger stake; NULL loses, then arrival."""
    named = rows.withColumn("name", F.trim("holder")).where(~F.col("name").isin("계", "합계") & (F.length("name") >= 2)).withColumn("key", S.holder_key(F.col("name")))
    order = F.struct(F.coalesce("stake", F.lit(float("-inf"))).alias("s"), (-F.col("seq")).alias("o"))
    return named.groupBy("corp", "key").agg(F.max_by(F.struct("name", "stake"), order).alias("r")).select("corp", "key", "r.*")


def top_and_rest(rows: DataFrame, top: int = 6) -> DataFrame:
    """AGG7: the largest stakes of a company and one row that counts the others."""
    order = Window.partitionBy("corp").orderBy(F.coalesce("stake", F.lit(0.0)).desc(), "key")
    ranked = rows.withColumn("rank", F.row_number().over(order))
    head = ranked.where(F.col("rank") <= top).select("corp", F.col("key").alias("name"), "stake")
    rest = ranked.where(F.col("rank") > top).groupBy("corp").agg(F.count("*").alias("n")).select("corp", F.concat(F.lit("외 "), F.col("n").cast("string"), F.lit("인")).alias("name"), F.lit(None).cast("double").alias("stake"))
    return head.unionByName(rest)


def monthly_ohlc(prices: DataFrame) -> DataFrame:
    """AGG15: first and last close of a month by day, extremes, mean, change, volume; months without a close drop out.

    The mean volume is cut to a whole number; days without one do not count in it.
    """
    at = F.struct("day", "seq")
    shown = F.col("close").isNotNull()
    g = prices.withColumn("month", F.date_format("day", "yyyy-MM")).groupBy("corp", "month").agg(
        F.min_by("close", F.when(shown, at)).alias("open"), F.max_by("close", F.when(shown, at)).alias("close"), F.max("close").alias("high"), F.min("close").alias("low"), F.avg("close").alias("mean"), F.count("*").alias("rows_"), F.count("close").alias("priced"),
        *([F.sum("volume").alias("volume"), F.floor(F.avg("volume")).alias("mean_volume"), F.size(F.collect_set("day")).cast("long").alias("days")] if "volume" in prices.columns else []),
    )
    return g.where("priced > 0").withColumn("change", F.when(F.col("open") != 0, (F.col("close") - F.col("open")) / F.col("open") * 100).otherwise(0.0))


def series_summary(prices: DataFrame, last: int = 24) -> DataFrame:
    """AGG16: last, mean, extremes, count and the latest samples in order of time; samples are ranked before they are gathered."""
    rows = prices.where("close is not null")
    g = rows.groupBy("corp").agg(F.max_by("close", F.struct("day", "seq")).alias("last"), F.avg("close").alias("mean"), F.min("close").alias("low"), F.max("close").alias("high"), F.count("*").alias("n"))
    late = rows.withColumn("_r", F.row_number().over(Window.partitionBy("corp").orderBy(F.desc("day"), F.desc("seq")))).where(F.col("_r") <= last)
    late = late.groupBy("corp").agg(F.array_sort(F.collect_list(F.struct("day", "seq", "close"))).alias("a"))
    return g.join(late, "corp").withColumn("samples", F.expr("transform(a, x -> x.close)")).drop("a")


def names_and_rest(rows: DataFrame, group: str, name: str, top: int = 5) -> DataFrame:
    """AGG17: the first names of a group and the count of the others."""
    own = rows.select(group, name).where(F.col(name).isNotNull()).distinct()
    own = own.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(name)))
    g = own.groupBy(group).agg(F.count("*").alias("_n"), F.array_sort(F.collect_list(F.when(F.col("_r") <= top, F.col(name)))).alias("_a"))
    more = F.col("_n") - top
    return g.select(group, F.concat(F.array_join("_a", ", "), F.when(more > 0, F.concat(F.lit(" 외 "), more.cast("string"), F.lit("명"))).otherwise("")).alias("names"))


def page_buckets(rows: DataFrame, group: str, at: str, text: str, size: int) -> DataFrame:
    """AGG17: texts of a group joined in order, ``size`` places in a bucket."""
    g = rows.withColumn("bucket", F.floor(F.col(at) / size)).groupBy(group, "bucket").agg(F.array_sort(F.collect_list(F.struct(at, text))).alias("a"))
    return g.select(group, "bucket", F.array_join(F.expr(f"transform(a, x -> x.`{text}`)"), "\n").alias("content"))


def coverage(rows: DataFrame, expected: DataFrame, by: str, cells: list[str]) -> DataFrame:
    """AGG19: share of the expected grid that each group has, with the verdict of its thresholds."""
    total = expected.count()
    have = rows.select(by, *cells).distinct().join(expected.distinct(), cells, "left_semi").groupBy(by).agg(F.count("*").alias("have"))
    rate = F.col("have") / F.lit(total)
    return have.select(by, "have", rate.alias("rate"), F.when(rate < 0.5, "FAIL").when(rate < 0.8, "WARN").otherwise("PASS").alias("status"))


def outliers(counts: DataFrame, n: str = "n") -> DataFrame:
    """AGG20: groups under 0.3 or over 3 times the mean."""
    mean = counts.agg(F.avg(n).alias("mean"))
    return counts.crossJoin(F.broadcast(mean)).where((F.col(n) < 0.3 * F.col("mean")) | (F.col(n) > 3 * F.col("mean"))).drop("mean")


def prf(gold: DataFrame, found: DataFrame, by: str, item: str) -> DataFrame:
    """AGG24, SET4: true, false and missing items of each group, with precision, recall and F1."""
    g = gold.select(by, item).distinct().withColumn("g", F.lit(1))
    p = found.select(by, item).distinct().withColumn("p", F.lit(1))
    c = g.join(p, [by, item], "full_outer").groupBy(by).agg(F.count(F.expr("case when g = 1 and p = 1 then 1 end")).alias("tp"), F.count(F.expr("case when g is null then 1 end")).alias("fp"), F.count(F.expr("case when p is null then 1 end")).alias("fn"))
    pr = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    rc = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    return c.withColumn("precision", pr).withColumn("recall", rc).withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def retrieval_metrics(ranked: DataFrame, expected: DataFrame, k: int = 10) -> DataFrame:
    """AGG25: capped recall@k, reciprocal rank and nDCG@k of each query; no hit is 0."""
    want = expected.groupBy("qid").agg(F.count("*").alias("want"))
    hits = ranked.where(F.col("rank") <= k).join(expected, ["qid", "item"]).groupBy("qid").agg(F.count("*").alias("hits"), F.min("rank").alias("best"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    cap = F.least(F.col("want"), F.lit(k))
    ideal = F.aggregate(F.sequence(F.lit(1), cap.cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0))
    j = want.join(hits, "qid", "left")
    return j.select("qid", F.coalesce(F.col("hits") / cap, F.lit(0.0)).alias("recall"), F.coalesce(1 / F.col("best"), F.lit(0.0)).alias("mrr"), F.coalesce(F.col("dcg") / ideal, F.lit(0.0)).alias("ndcg"))


def pivot_counts(rows: DataFrame, by: str, status: str, values: list[str]) -> DataFrame:
    """AGG27: counter manifest."""
    return rows.groupBy(by).agg(*[F.count_if(F.col(status) == v).alias(v) for v in values], F.count("*").alias("total"))
