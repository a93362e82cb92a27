"""Property-graph operators on node and edge frames: traversal is joins, caps are windows.

An edge frame has src, dst, type, extracted_by, evidence_count, stake (and dates); provenance
``extracted_by`` set means read from news, NULL means from filings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Predicates of the display groups.
GROUPS = {
    "SUPPLIES": "supply", "CUSTOMER_OF": "supply",
    "COMPETES_WITH": "compete",
    "PARTNERS_WITH": "partner", "JV_WITH": "partner", "LICENSES": "partner",
    "INVESTS_IN": "invest", "ACQUIRES": "invest",
    "IS_SUBSIDIARY_OF": "govern", "IS_MAJOR_SHAREHOLDER_OF": "govern", "AFFILIATED_WITH": "govern",
    "LITIGATION": "dispute",
}
#: Predicates drawn with an arrow; words of a fund's name.
DIRECTED = ("SUPPLIES", "CUSTOMER_OF", "INVESTS_IN", "ACQUIRES", "IS_SUBSIDIARY_OF", "IS_MAJOR_SHAREHOLDER_OF")
FUND_WORDS = r"신기술투자조합|SVIC|투자조합|펀드"
ABBREVIATION = r"^[A-Za-z][A-Za-z0-9\-]{1,7}$"


def group_of(predicate: Column, default: str | None = None) -> Column:
    """PRJ3: display group of a predicate; unmapped ones are NULL or the default."""
    table = F.create_map(*[F.lit(x) for pair in GROUPS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, predicate), F.lit(default)) if default else F.try_element_at(table, predicate)


def visible_edges(edges: DataFrame, least: int = 2) -> DataFrame:
    """FIL1 to FIL3: news edges with enough evidence (NULL counts as 1), filing edges but investments without stake; one pass."""
    news = F.col("extracted_by").isNotNull()
    shown = F.when(news, F.coalesce("evidence_count", F.lit(1)) >= least).otherwise(~((F.col("type") == "INVESTS_IN") & (F.coalesce("stake", F.lit(0.0)) <= 0)))
    weight = F.when(news, F.col("evidence_count").cast("double")).otherwise(F.coalesce("stake", F.lit(1.0)).cast("double"))
    return edges.where(shown).withColumn("weight", weight).withColumn("source", F.when(news, "news").otherwise("filing"))


def around(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """JON9, JON11, PRJ2: one row per orientation seen from a seed; an edge between two seeds gives two rows."""
    end = lambda a, b: F.struct(F.col(a).alias("centre"), F.col(b).alias("neighbour"))
    ends = F.when(F.col("src") == F.col("dst"), F.array(end("src", "dst"))).otherwise(F.array(end("src", "dst"), end("dst", "src")))
    rows = edges.withColumn("_end", F.explode(ends)).select(*edges.columns, "_end.centre", "_end.neighbour")
    return rows.join(F.broadcast(seeds) if seeds.columns == ["centre"] and _small(seeds) else seeds, "centre", "left_semi")


def _small(seeds: DataFrame, limit: int = 100_000) -> bool:
    return seeds.limit(limit + 1).count() <= limit


def collapses(name: Column, known: Column) -> Column:
    """FIL5: fund words collapse; names of the dictionary, or with a logo, do not; else short Latin abbreviations do."""
    return F.when(name.rlike(FUND_WORDS), True).when(known, False).otherwise(name.rlike(ABBREVIATION))


def ego_graph(edges: DataFrame, seeds: DataFrame, known: DataFrame, cap: int = 12) -> DataFrame:
    """GRA1: links of each seed's map - capped groups, kept investments, and one collapse link to a meta node.

    ``known``: (name) of names in the dictionary or with a logo, which never collapse. Shown and hidden rows come from one
    window, so the edges are read once.
    """
    rows = around(visible_edges(edges), seeds).withColumn("grp", group_of(F.col("type"))).where(F.col("grp").isNotNull() & (F.col("neighbour") != F.col("centre")))
    rows = rows.where((S.own_name(F.col("neighbour")) == "") | (S.own_name(F.col("neighbour")) != S.own_name(F.col("centre"))))
    names = known.select(F.lower(S.own_name(F.col("name"))).alias("key")).distinct().withColumn("is_known", F.lit(True))
    rows = rows.withColumn("key", F.lower(S.own_name(F.col("neighbour")))).join(names, "key", "left")
    hidden = (F.col("grp") == "govern") | ((F.col("grp") == "invest") & collapses(F.col("neighbour"), F.coalesce("is_known", F.lit(False))))
    order = Window.partitionBy("centre", "grp", "hidden").orderBy(F.desc("weight"), "neighbour", "type", "source")
    rows = rows.withColumn("hidden", hidden).withColumn("rank", F.row_number().over(order))
    pair = Window.partitionBy("centre", "neighbour")
    rows = rows.withColumn("shown", ~F.col("hidden") & (F.col("rank") <= cap)).withColumn("seen", F.max("shown").over(pair))
    rows = rows.withColumn("first", F.row_number().over(pair.orderBy(F.desc("hidden"), "type", "source")) == 1)
    links = rows.where("shown").select("centre", "neighbour", "grp", "type", "source", "weight", "rank")
    meta = rows.where("hidden and not seen and first").groupBy("centre").agg(F.count("*").cast("double").alias("weight"))
    meta = meta.select("centre", F.concat(F.lit("__meta:govern:"), "centre").alias("neighbour"), F.lit("govern").alias("grp"), F.lit("META").alias("type"), F.lit("meta").alias("source"), "weight", F.lit(1).alias("rank"))
    return links.unionByName(meta)


def meta_members(edges: DataFrame, seeds: DataFrame, kinds: list[str], top: int = 30) -> DataFrame:
    """GRA2, WIN2: heaviest row of each governance neighbour, funds last, top rows and one row for the rest."""
    weight = F.coalesce(F.col("evidence_count").cast("double"), F.col("stake"), F.lit(1.0))
    rows = around(edges.where(F.col("type").isin(kinds)), seeds).withColumn("weight", F.when(weight == 0, 1.0).otherwise(weight))
    best = rows.groupBy("centre", "neighbour").agg(F.max("weight").alias("weight"))
    order = Window.partitionBy("centre").orderBy(F.col("neighbour").rlike(FUND_WORDS), F.desc("weight"), "neighbour")
    ranked = best.withColumn("rank", F.row_number().over(order))
    rest = ranked.where(F.col("rank") > top).groupBy("centre").agg(F.count("*").cast("double").alias("weight")).select("centre", F.lit("etc").alias("neighbour"), "weight", F.lit(top + 1).alias("rank"))
    return ranked.where(F.col("rank") <= top).unionByName(rest)


def merged_relations(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """AGG11: relations by (centre, group, predicate, neighbour): most evidence, news wins."""
    rows = around(edges, seeds).withColumn("grp", group_of(F.col("type"), "etc"))
    return rows.groupBy("centre", "grp", "type", "neighbour").agg(F.max(F.coalesce("evidence_count", F.lit(1))).alias("evidence"), F.max(F.col("extracted_by").isNotNull()).alias("news"))


def drill_down(facts: DataFrame, keep: int = 50) -> DataFrame:
    """GRA4, AGG12, AGG13: each edge's predicates with documents, first and last day, and the newest documents."""
    at = ["src", "dst", "type"]
    best = F.max_by("doc_id", F.struct(F.coalesce("stake", F.lit(-1.0)).alias("s"), (-F.col("doc_id")).alias("d")))
    sums = facts.groupBy(*at).agg(F.count_distinct("doc_id").alias("docs"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.max("stake").alias("stake"), best.alias("stake_doc"), F.max(F.col("extracted_by").isNotNull()).alias("news"))
    docs = facts.select(*at, "doc_id", "day").distinct().withColumn("rank", F.row_number().over(Window.partitionBy(*at).orderBy(F.desc_nulls_last("day"), "doc_id"))).where(F.col("rank") <= keep)
    lists = docs.groupBy(*at).agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("a")).select(*at, F.expr("transform(a, x -> x.doc_id)").alias("newest"))
    return sums.join(lists, at)


def degrees(edges: DataFrame) -> DataFrame:
    """AGG14: link ends and weight at each node; self-loops do not count."""
    ends = edges.where("src <> dst")
    both = ends.select(F.col("src").alias("node"), "evidence_count").unionByName(ends.select(F.col("dst").alias("node"), "evidence_count"))
    return both.groupBy("node").agg(F.count("*").alias("degree"), F.sum("evidence_count").alias("weight"))


def new_items(edges: DataFrame, asof: Column, days: int, least: int = 2) -> DataFrame:
    """AGG4, FIL8: edges whose first document falls in the last ``days`` days."""
    return edges.where((F.coalesce("evidence_count", F.lit(1)) >= least) & (F.col("first_day") >= F.date_sub(asof, days)))


def rewire(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """ENT6, SNK19: both ends moved to their survivors, self-loops dropped, edges merged.

    ``mapping``: (old, new). Evidence is the union of documents; each edge frame row is one document.
    """
    m = lambda end: mapping.select(F.col("old").alias(end), F.col("new").alias(f"_{end}"))
    moved = edges.join(m("src"), "src", "left").join(m("dst"), "dst", "left")
    moved = moved.select(F.coalesce("_src", "src").alias("src"), F.coalesce("_dst", "dst").alias("dst"), "type", "doc_id").where("src <> dst")
    return moved.groupBy("src", "dst", "type").agg(F.count_distinct("doc_id").alias("evidence_count"))


def survivors(nodes: DataFrame) -> DataFrame:
    """ENT6, SNK20: of nodes with one aggressive name the longest survives (first id on ties): (old, new)."""
    keyed = nodes.withColumn("key", S.aggressive_name(F.col("name"))).where("key <> ''")
    best = keyed.groupBy("key").agg(F.min_by("node", F.struct((-F.length("name")).alias("l"), "node")).alias("new"))
    return keyed.join(best, "key").where("node <> new").select(F.col("node").alias("old"), "new")


def fragments(nodes: DataFrame, known: DataFrame) -> DataFrame:
    """ENT7: all node ids sharing a canonical key, for keys the dictionary holds."""
    keyed = nodes.withColumn("key", S.aggressive_name(F.col("name")))
    return keyed.join(known.select(S.aggressive_name(F.col("name")).alias("key")).distinct(), "key", "left_semi").groupBy("key").agg(F.array_sort(F.collect_set("node")).alias("nodes"))


def subsidiaries(edges: DataFrame, least: float = 50.0) -> DataFrame:
    """ENT13: reverse edges of investments of at least half."""
    return edges.where((F.col("type") == "INVESTS_IN") & (F.col("stake") >= least)).select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("IS_SUBSIDIARY_OF").alias("type"), "stake")


def tier(validity: Column, confidence: Column, evidence: Column, many_sources: Column, event: Column) -> Column:
    """ENT10: event; without any trigger a plain edge; with two or more documents or sources a relation; else a statement."""
    strong = (F.coalesce(evidence, F.lit(1)) >= 2) | many_sources
    return F.when(event, "event").when(~(validity | confidence | strong), "edge").when(strong, "relation").otherwise("statement")
