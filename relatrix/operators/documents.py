"""Operators on documents, summaries and news: index rows, matches, sidecars, prefixes, metric rows, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import records as R
from ..functions import scalars as S

#: Fixed value: a chapter heading in a filing's body.
CHAPTER = r"^([IVXLCDM]+)\.\s*(.+)"
#: How a summary was made, and which of these are made again.
KEPT_METHODS, RETRIED = ("claude_temp", "qwen_local_v1"), ("pending", "llm_call_fail")


def page_index(body: Column) -> Column:
    """S40, TXT7: JSON object of the chapter headings of a text by their line number (from 1), titles cut at 50 characters."""
    lines = F.transform(F.split(F.coalesce(body, F.lit("")), "\n", -1), lambda x, i: F.struct((i + 1).cast("string").alias("line"), F.trim(x).alias("t")))
    heads = F.filter(lines, lambda x: x["t"].rlike(CHAPTER))
    title = lambda t: F.concat(F.regexp_extract(t, CHAPTER, 1), F.lit(". "), F.substring(F.trim(F.regexp_extract(t, CHAPTER, 2)), 1, 50))
    return F.to_json(F.map_from_entries(F.transform(heads, lambda x: F.struct(x["line"], F.array(title(x["t"]))))))


def document_rows(summaries: DataFrame, reports: DataFrame, bodies: DataFrame) -> DataFrame:
    """TXT7: index rows of summarised documents: report name without its mark (the summary's kind where there is no report), ISO day of 8 digits, headings, digest, length.

    ``summaries`` (receipt, kind, short, method, verified, facts), ``reports`` (receipt, name, received, filer), ``bodies`` (receipt, body). Missing texts are
    empty, a missing verdict is false, a document without a body has an empty digest.
    """
    rows = summaries.join(reports, "receipt", "left").join(bodies, "receipt", "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    raw = F.trim(blank("name"))
    close = F.locate("]", raw)
    name = F.when(raw.startswith("[") & (close > 1), F.trim(F.substr(raw, close + 1))).otherwise(raw)
    day = F.when(F.length("received") == 8, F.regexp_replace("received", r"^(.{4})(.{2})(.{2})$", "$1-$2-$3")).otherwise("")
    return rows.select(
        "receipt", F.when(name == "", blank("kind")).otherwise(name).alias("kind"), raw.alias("report"), name.alias("title"), day.alias("day"), blank("filer").alias("filer"), blank("short").alias("short"),
        blank("method").alias("method"), F.coalesce("verified", F.lit(False)).alias("verified"), F.coalesce("facts", F.array().cast("array<string>")).alias("facts"),
        F.when(F.col("body").isNull(), "").otherwise(F.substring(F.sha1("body"), 1, 16)).alias("hash16"), page_index(F.col("body")).alias("pages"), F.coalesce(F.length("body"), F.lit(0)).alias("chars"),
    )


def matched_news(news: DataFrame, rules: DataFrame, models: DataFrame) -> DataFrame:
    """TXT9: (news_id, companies, method) of news (news_id, title, body, old_method, old_companies, old_rules, old_models, recheck).

    Rows with a method and no need to be checked again keep what they have; empty texts are left out; else the
    rules' companies, and the model's where no rule hits. On a recheck only the rules run again: the model's old companies stay beside the
    rules', and a company that the rules did not find before changes the method. ``rules`` and ``models``: (news_id, company).
    """
    lists = lambda d, name: d.groupBy("news_id").agg(F.array_sort(F.collect_set("company")).alias(name))
    rows = news.join(lists(rules, "r"), "news_id", "left").join(lists(models, "m"), "news_id", "left")
    none = F.array().cast("array<string>")
    for c in ("r", "m", "old_companies", "old_rules", "old_models"):
        rows = rows.withColumn(c, F.coalesce(c, none))
    recheck = F.coalesce("recheck", F.lit(False))
    old = F.when(F.coalesce("old_method", F.lit("")) != "", F.col("old_method"))
    done = old.isNotNull() & ~recheck
    text = F.trim(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("body", F.lit(""))))
    any_rule, any_model, kept_model = F.size("r") > 0, F.size("m") > 0, F.size("old_models") > 0
    fresh = F.size(F.array_except("r", "old_rules")) > 0
    again = F.coalesce(old, F.when(any_rule, "rule").otherwise("none"))
    again = F.when(fresh, F.when(kept_model, F.concat(again, F.lit("+rule_recheck"))).otherwise("rule")).otherwise(again)
    first = F.when(any_rule, "rule").when(any_model, "llm").otherwise("none")
    found = F.when(recheck, F.array_sort(F.array_union("old_models", "r"))).when(any_rule, F.col("r")).otherwise(F.col("m"))
    return rows.where(done | (text != "")).select("news_id", F.when(done, F.array_sort("old_companies")).otherwise(found).alias("companies"), F.when(done, old).when(recheck, again).otherwise(first).alias("method"))


def to_summarise(chunks: DataFrame, sidecar: DataFrame, pending_only: bool = False, force: bool = False) -> DataFrame:
    """TXT11: chunks with what is to be done: keep the stored summary or make one.

    Summaries of a kept method stay; others are made again, with ``pending_only`` just the pending and failed ones; ``force`` makes all.
    """
    rows = chunks.join(sidecar.select("chunk", "method"), "chunk", "left")
    keep = F.col("method").isin(*KEPT_METHODS) | ((~F.col("method").isin(*RETRIED)) & F.lit(pending_only))
    return rows.withColumn("action", F.when(F.coalesce(keep, F.lit(False)) & F.lit(not force), "keep").otherwise("make"))


def prefixed(company: Column, kind: Column, headings: Column, content: Column) -> Column:
    """TXT8, TXT19: text to embed: company, document kind and headings in front of the content; parts that are missing leave no gap."""
    return F.concat(F.concat_ws(" ", *(F.when(F.trim(x) != "", F.trim(x)) for x in (company, kind, F.array_join(headings, " > ")))), F.lit("\n\n"), content)


def to_reembed(chunks: DataFrame) -> DataFrame:
    """SNK24: table chunks whose text does not yet begin with their prefix, with the text that does."""
    rows = chunks.withColumn("_new", F.concat(F.col("prefix"), F.lit("\n"), F.col("text")))
    return rows.where((F.col("kind") == "table_nl") & ~F.startswith("text", "prefix")).withColumn("text", F.col("_new")).drop("_new")


def metric_rows(rows: DataFrame) -> DataFrame:
    """ENT14: metric rows of statement rows (corp, year, indicator, amount, fs, sj, report, account_id): kept indicators with a value, and their id."""
    rows = rows.withColumn("indicator", F.trim(F.coalesce("indicator", F.lit("")))).withColumn("value", S.parse_amount(F.col("amount")))
    rows = rows.where(R.statement_ok(F.col("indicator"), F.col("value")))
    account = F.trim(F.coalesce("account_id", F.lit("")))
    return rows.withColumn("account_id", F.when(account == "-표준계정코드 미사용-", "").otherwise(account)).withColumn("metric", R.metric_id(*(F.col(c) for c in ("corp", "year", "indicator", "fs", "sj", "report")))).drop("amount")


def snapshot(edges: DataFrame, seeds: DataFrame, run_at: Column, groups: Column) -> DataFrame:
    """SNK16, STR9: rows to append for a run: each seed's relations read from news in both directions, self-loops aside."""
    from .graph import around

    rows = around(edges.where(F.col("extracted_by").isNotNull() & (F.col("src") != F.col("dst"))), seeds)
    return rows.select(run_at.alias("run_ts"), F.col("centre").alias("corp"), groups.alias("grp"), F.col("type").alias("predicate"), F.col("neighbour").alias("target")).where("grp is not null")


def preferred(nodes: DataFrame) -> DataFrame:
    """SNK20: of nodes with one normalised name the survivor by the pattern of its id: 8 digits, then X codes, then others; ids break ties."""
    keyed = nodes.withColumn("key", S.aggressive_name(F.col("name"))).where("key <> ''")
    rank = F.when(F.col("node").rlike(r"^\d{8}$"), 0).when(F.col("node").rlike(r"^X"), 1).otherwise(2)
    best = keyed.groupBy("key").agg(F.min_by("node", F.struct(rank.alias("p"), "node")).alias("new"))
    return keyed.join(best, "key").where("node <> new").select(F.col("node").alias("old"), "new")


def manifest(rows: DataFrame, by: str, status: str) -> DataFrame:
    """SNK17: counters of a run by group, statuses as a JSON object in order of their names, and the total."""
    g = rows.groupBy(by, status).agg(F.count("*").alias("n"))
    return g.groupBy(by).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(status), "n"))))).alias("counts"), F.sum("n").alias("total"))


def class_summary(rows: DataFrame, by: str, kind: Column, top: int = 6) -> DataFrame:
    """AGG7: the named rows of each company's best stakes and a row for each kind of the rest, as the profile shows them.

    ``kind``: "fund", "overseas" or "other"; names of others are taken once, with their largest stake (NULL counts as 0 in the order).
    """
    rows = rows.where(F.trim(F.coalesce("name", F.lit(""))) != "").withColumn("name", F.trim("name")).withColumn("kind", kind)
    best = rows.where("kind = 'other'").groupBy(by, "name").agg(F.max("stake").alias("stake"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(F.coalesce("stake", F.lit(0.0))), "name")))
    shown = ranked.where(F.col("rank") <= top).select(by, "name", "stake", "rank")
    rest = ranked.where(F.col("rank") > top).groupBy(by).agg(F.count("*").alias("n")).select(by, F.format_string("기타 출자 %d건", "n").alias("name"), F.lit(None).cast("double").alias("stake"), F.lit(top + 3).alias("rank"))
    label = F.when(F.col("kind") == "overseas", F.format_string("해외 출자법인 %d건", "n")).otherwise(F.format_string("투자조합·펀드 %d건", "n"))
    counted = rows.where("kind <> 'other'").groupBy(by, "kind").agg(F.count("*").alias("n"))
    counted = counted.select(by, label.alias("name"), F.lit(None).cast("double").alias("stake"), F.when(F.col("kind") == "overseas", top + 1).otherwise(top + 2).alias("rank"))
    return shown.unionByName(counted).unionByName(rest)
