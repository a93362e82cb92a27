"""Diagnostics of a graph and of its stores: every check gives one verdict for each scope (a run, a tenant, a region).

A verdict is (scope, check, status, bad, total). Each check is one aggregation by scope, so scopes are checked side by side.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Accepted values, and the (year, report) cells that a company is expected to have.
STATEMENT_SCOPES, REPORT_CODES = ("CFS", "OFS"), ("11011", "11012", "11013", "11014")


def verdict(sums: DataFrame, check: str, bad: Column, total: Column, fail: Column, warn: Column | None = None) -> DataFrame:
    """Verdicts from one row of sums for each scope."""
    status = F.when(fail, "FAIL")
    status = status.when(warn, "WARN") if warn is not None else status
    return sums.select("scope", F.lit(check).alias("check"), status.otherwise("PASS").alias("status"), bad.cast("long").alias("bad"), total.cast("long").alias("total"))


def _n(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def wanted_exist(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """DIA1: every configured company (scope, code) is a node."""
    rows = wanted.join(nodes.select("code", F.lit(1).alias("there")).distinct(), "code", "left")
    return verdict(rows.groupBy("scope").agg(_n(F.col("there").isNull()).alias("m"), F.count("*").alias("t")), "C-01", F.col("m"), F.col("t"), F.col("m") > 0)


def required_attributes(nodes: DataFrame) -> DataFrame:
    """DIA2: name and ticker must be there, registration numbers should be."""
    empty = lambda *cs: reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit("")) == "" for c in cs])
    sums = nodes.groupBy("scope").agg(_n(empty("name", "ticker")).alias("m"), _n(empty("registration", "business")).alias("w"), F.count("*").alias("t"))
    return verdict(sums, "C-02", F.when(F.col("m") > 0, F.col("m")).otherwise(F.col("w")), F.col("t"), F.col("m") > 0, F.col("w") > 0)


def metrics_per_company(wanted: DataFrame, metrics: DataFrame) -> DataFrame:
    """DIA3, AGG20: companies without metrics fail, those far from the scope's mean (under 0.3, over 3 times) warn."""
    own = wanted.join(metrics.groupBy("code").agg(F.count("*").alias("n")), "code", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    own = own.withColumn("mean", F.avg("n").over(Window.partitionBy("scope")))
    far = (F.col("mean") > 0) & ((F.col("n") < F.col("mean") * 0.3) | (F.col("n") > F.col("mean") * 3))
    sums = own.groupBy("scope").agg(_n(F.col("n") == 0).alias("zero"), _n(far).alias("far"), F.count("*").alias("t"))
    return verdict(sums, "C-03", F.when(F.col("zero") > 0, F.col("zero")).otherwise(F.col("far")), F.col("t"), F.col("zero") > 0, F.col("far") > 0)


def coverage(wanted: DataFrame, metrics: DataFrame, cells: DataFrame) -> DataFrame:
    """DIA4, AGG19: share of the (year, report) cells that companies have: under half fails, under 0.8 warns. ``cells`` is a short list."""
    got = metrics.join(F.broadcast(cells), ["year", "report"], "left_semi").groupBy("code").agg(F.count_distinct("year", "report").alias("n"))
    sums = wanted.join(got, "code", "left").groupBy("scope").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.count("*").alias("c"))
    sums = sums.crossJoin(F.broadcast(cells.agg(F.count("*").alias("k")))).withColumn("t", F.col("c") * F.col("k"))
    share = F.when(F.col("t") > 0, F.col("n") / F.col("t")).otherwise(0.0)
    return verdict(sums, "C-04", F.col("t") - F.col("n"), F.col("t"), share < 0.5, share < 0.8)


def orphans(metrics: DataFrame, nodes: DataFrame) -> DataFrame:
    """DIA5: metrics of no company."""
    rows = metrics.join(nodes.select("code", F.lit(1).alias("there")).distinct(), "code", "left")
    return verdict(rows.groupBy("scope").agg(_n(F.col("there").isNull()).alias("m"), F.count("*").alias("t")), "C-05", F.col("m"), F.col("t"), F.col("m") > 0)


def expected_values(metrics: DataFrame, expected: dict[str, tuple]) -> DataFrame:
    """DIA6, AGG23: combinations with a value outside the expected ones warn; missing values are no matter."""
    combos = metrics.select("scope", *expected).distinct()
    odd = reduce(lambda a, b: a | b, [F.coalesce(~F.col(c).isin(*v) & (F.col(c) != ""), F.lit(False)) for c, v in expected.items()])
    sums = combos.groupBy("scope").agg(_n(odd).alias("m"), F.count("*").alias("t"))
    return verdict(sums, "C-06", F.col("m"), F.col("t"), F.lit(False), F.col("m") > 0)


def unique_ids(metrics: DataFrame) -> DataFrame:
    """DIA7."""
    sums = metrics.groupBy("scope", "metric").agg(F.count("*").alias("n")).groupBy("scope").agg(_n(F.col("n") > 1).alias("m"), F.count("*").alias("t"))
    return verdict(sums, "C-07", F.col("m"), F.col("t"), F.col("m") > 0)


def same_run(metrics: DataFrame) -> DataFrame:
    """DIA8: edge and node of one run, where both are known."""
    sums = metrics.groupBy("scope").agg(_n(F.col("edge_run") != F.col("run")).alias("m"), F.count("*").alias("t"))
    return verdict(sums, "C-08", F.col("m"), F.col("t"), F.col("m") > 0)


def provenance(metrics: DataFrame, filings: DataFrame) -> DataFrame:
    """DIA9, JON14, AGG22: receipts of at least 95 percent of the metrics; ``bad`` counts those without an edge to a filing."""
    rows = metrics.join(filings.select("receipt", F.lit(1).alias("linked")).distinct(), "receipt", "left")
    sums = rows.groupBy("scope").agg(F.count("receipt").alias("r"), F.count("linked").alias("e"), F.count("*").alias("t"))
    return verdict(sums, "C-09", F.col("t") - F.col("e"), F.col("t"), F.col("r") / F.col("t") < 0.95)


def links_per_company(wanted: DataFrame, edges: DataFrame, check: str, severe: bool) -> DataFrame:
    """DIA10 (officers, severe) and DIA11 (groups): companies without such an edge (code)."""
    rows = wanted.join(edges.groupBy("code").agg(F.count("*").alias("n")), "code", "left")
    sums = rows.groupBy("scope").agg(_n(F.col("n").isNull()).alias("m"), F.count("*").alias("t"))
    return verdict(sums, check, F.col("m"), F.col("t"), (F.col("m") > 0) & F.lit(severe), F.col("m") > 0)


def isolation(nodes: DataFrame) -> DataFrame:
    """DIA12: nodes read by a model (labels, code) are no registered company (8 digits) and no metric."""
    marked = F.array_contains("labels", "LLMExtracted")
    clash = marked & ((F.array_contains("labels", "Organization") & F.coalesce(F.col("code").rlike(r"^\d{8}$"), F.lit(False))) | F.array_contains("labels", "FinMetric"))
    sums = nodes.groupBy("scope").agg(_n(clash).alias("m"), _n(marked).alias("t"))
    return verdict(sums, "C-12", F.col("m"), F.col("t"), F.col("m") > 0)


def article_keys(articles: DataFrame) -> DataFrame:
    """DIA14: article keys must be there, legacy keys should be."""
    sums = articles.groupBy("scope").agg(_n(F.col("news_id").isNull()).alias("m"), _n(F.col("document_id").isNull()).alias("w"), F.count("*").alias("t"))
    return verdict(sums, "C-14", F.when(F.col("m") > 0, F.col("m")).otherwise(F.col("w")), F.col("t"), F.col("m") > 0, F.col("w") > 0)


def runs(metrics: DataFrame, most: int = 3) -> DataFrame:
    """DIA15: more than three runs side by side."""
    sums = metrics.groupBy("scope").agg(F.count_distinct(F.coalesce("run", F.lit(""))).alias("t"))
    return verdict(sums, "C-15", F.greatest(F.lit(0), F.col("t") - most), F.col("t"), F.lit(False), F.col("t") > most)


def ready_chunks(chunks: DataFrame) -> DataFrame:
    """DIA17: a scope has ready chunks; pending ones are counted as bad."""
    sums = chunks.groupBy("scope").agg(_n(F.col("status") == "ready").alias("r"), _n(F.col("status") == "pending").alias("p"), F.count("*").alias("t"))
    return verdict(sums, "I-01", F.col("p"), F.col("t"), F.col("r") == 0)


def same_counts(left: DataFrame, right: DataFrame, margin: float, check: str) -> DataFrame:
    """DIA18, DIA26: rows of two stores differ by no more than a share of the first."""
    count = lambda d, c: d.groupBy("scope").agg(F.count("*").alias(c))
    sums = count(left, "a").join(count(right, "b"), "scope", "full_outer").na.fill(0)
    return verdict(sums, check, F.abs(F.col("a") - F.col("b")), F.col("a"), F.abs(F.col("a") - F.col("b")) > F.col("a") * margin)


def stray_chunks(chunks: DataFrame, documents: DataFrame, share: float = 0.01) -> DataFrame:
    """DIA21, JON3: chunks whose (receipt, run) no document has are under one percent."""
    rows = chunks.join(documents.select("receipt", "run", F.lit(1).alias("there")).distinct(), ["receipt", "run"], "left")
    sums = rows.groupBy("scope").agg(_n(F.col("there").isNull()).alias("m"), F.count("*").alias("t"))
    return verdict(sums, "I-04", F.col("m"), F.col("t"), F.col("m") >= F.col("t") * share)


def matched_news(news: DataFrame) -> DataFrame:
    """DIA23: some of the news rows (companies: JSON list) are matched to a company."""
    sums = news.groupBy("scope").agg(_n(F.json_array_length("companies") > 0).alias("m"), F.count("*").alias("t"))
    return verdict(sums, "I-09", F.col("t") - F.col("m"), F.col("t"), F.col("m") == 0)


def complete_bodies(raw: DataFrame) -> DataFrame:
    """DIA24: every raw row has a body."""
    sums = raw.groupBy("scope").agg(F.count("body").alias("b"), F.count("*").alias("t"))
    return verdict(sums, "I-10", F.col("t") - F.col("b"), F.col("t"), F.col("b") < F.col("t"))


def roll_up(*verdicts: DataFrame) -> DataFrame:
    """DIA16, DIA25: verdicts of each scope by status, and whether none failed."""
    rows = reduce(DataFrame.unionByName, verdicts)
    sums = rows.groupBy("scope").agg(*(_n(F.col("status") == s).alias(s.lower()) for s in ("PASS", "WARN", "FAIL")), F.count("*").alias("checks"))
    return sums.withColumn("overall", F.when(F.col("fail") == 0, "PASS").otherwise("FAIL"))


def guarded(check: str, run: Callable[[], DataFrame], spark_scope: DataFrame) -> DataFrame:
    """DIA16: a check that cannot be planned (a column or table is missing) fails in every scope."""
    from pyspark.errors import AnalysisException

    try:
        return run()
    except AnalysisException:
        return verdict(spark_scope.select("scope").distinct(), check, F.lit(0), F.lit(0), F.lit(True))


def round_trip(left: DataFrame, right: DataFrame, key: str, fields: list[str], n: int, seed: str, check: str) -> DataFrame:
    """DIA26: ``n`` rows of each scope of one store, looked up in the other by their key and compared field by field (NULL equals NULL).

    The rows look drawn at random and are the same in every run: those with the least digests of seed and key. A key the other store has not is as bad as a
    different field; of several rows of a key there any may match.
    """
    mixed = F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")))
    drawn = left.withColumn("_r", F.row_number().over(Window.partitionBy("scope").orderBy(mixed, key))).where(F.col("_r") <= n)
    other = right.select(key, F.struct(*fields).alias("_other"))
    same = F.coalesce(F.struct(*fields).eqNullSafe(F.col("_other")), F.lit(False))
    found = drawn.select("scope", key, *fields).join(other, key, "left").groupBy("scope", key).agg(F.bool_or(same).alias("same"))
    sums = found.groupBy("scope").agg(F.count_if(~F.col("same")).alias("bad"), F.count("*").alias("total"))
    return verdict(sums, check, F.col("bad"), F.col("total"), F.col("bad") > 0)


def node_counts(companies: DataFrame, metrics: DataFrame) -> DataFrame:
    """DIA20: a scope has companies (scope, corp) and metrics (scope, corp, metric); ``bad`` counts the companies without any metric."""
    own = metrics.groupBy("scope", "corp").agg(F.count("*").alias("n"))
    sums = companies.select("scope", "corp").distinct().join(own, ["scope", "corp"], "left").groupBy("scope").agg(F.count("*").alias("orgs"), F.sum(F.coalesce("n", F.lit(0))).alias("metrics"), F.count_if(F.col("n").isNull()).alias("bare"))
    return verdict(sums, "I-03", F.col("bare"), F.col("orgs"), ~((F.col("orgs") > 0) & (F.col("metrics") > 0)))
