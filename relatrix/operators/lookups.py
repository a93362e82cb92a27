"""Joins that bring records of several stores together, and small relational steps of the read queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def documents_of(edges: DataFrame, documents: DataFrame, ids: str = "doc_ids") -> DataFrame:
    """JON7, JON15: one row for each document of an edge's id list that the store has; the list is joined, never collected."""
    return edges.select("*", F.posexplode(ids).alias("pos", "doc_id")).drop(ids).join(documents, "doc_id")


def first_found(ids: DataFrame, key: str, first: DataFrame, second: DataFrame, fields: list[str]) -> DataFrame:
    """JON8: fields of each id from the first store, from the second where the first has no such row, with the store's name."""
    a = first.select(key, F.struct(*fields).alias("_a"))
    b = second.select(key, F.struct(*fields).alias("_b"))
    rows = ids.join(a, key, "left").join(b, key, "left")
    got = F.coalesce("_a", "_b")
    return rows.where(got.isNotNull()).select(key, got.alias("_r"), F.when(F.col("_a").isNotNull(), "first").otherwise("second").alias("store")).select(key, "_r.*", "store")


def related(edges: DataFrame, kinds: dict[str, str], by: str = "dst") -> DataFrame:
    """JON10: ends of each company's edges of the given types in one direction, as one row for each role."""
    table = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return edges.where(F.col("type").isin(*kinds)).select(F.col(by).alias("centre"), F.col("src" if by == "dst" else "dst").alias("other"), F.try_element_at(table, F.col("type")).alias("role"))


def patched(base: DataFrame, patch: DataFrame, keys: list[str]) -> DataFrame:
    """JON26: rows of both, the base's first for a key that both have."""
    both = base.withColumn("_p", F.lit(0)).unionByName(patch.withColumn("_p", F.lit(1)))
    rest = [c for c in base.columns if c not in keys]
    return both.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col("_p")).alias("r")).select(*keys, "r.*")


def linked_only(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, groups: list[str], least: float) -> tuple[DataFrame, DataFrame]:
    """FIL23: (nodes, edges) of a view: edges of shown groups with enough weight, nodes that they touch, and the seeds."""
    shown = edges.where(F.col("grp").isin(*groups) & (F.col("weight") >= least))
    touched = shown.select(F.col("src").alias("node")).union(shown.select(F.col("dst").alias("node"))).union(seeds.select("node")).distinct()
    return nodes.join(touched, "node", "left_semi"), shown


def contexts(chunks: DataFrame, links: DataFrame, most: int = 5) -> DataFrame:
    """JON16, RET7: the first few neighbours of each chunk by kind, as arrays; chunks without any keep empty arrays.

    ``links``: (chunk, kind, item), and ``pos`` if they have an order of their own. Rows are ranked before they are gathered, so only ``most`` of a kind meet.
    """
    kinds = ("org", "person", "product", "tech", "fact", "event")
    order = [c for c in ("pos", "item") if c in links.columns]
    first = links.withColumn("_r", F.row_number().over(Window.partitionBy("chunk", "kind").orderBy(*order))).where(F.col("_r") <= most)
    of = lambda k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("_r", "item"))))
    lists = first.groupBy("chunk").agg(*(F.transform(of(k), lambda x: x["item"]).alias(k) for k in kinds))
    out = chunks.select("chunk").distinct().join(lists, "chunk", "left")
    return out.select("chunk", *(F.coalesce(k, F.array().cast("array<string>")).alias(k) for k in kinds))


def context_item(kind: Column, *, name: Column, code: Column, category: Column, subject: Column, predicate: Column, target: Column, confidence: Column, event: Column, day: Column, label: Column) -> Column:
    """RET7: how a neighbour is written: 'name(code)', 'name', 'name(category)', 'a -[p]-> b (conf=0.00)' or 'event @ day — label'; missing parts are None."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    with_ = lambda c: F.concat(text(name), F.lit("("), text(c), F.lit(")"))
    fact = F.concat(text(subject), F.lit(" -["), text(predicate), F.lit("]-> "), text(target), F.lit(" (conf="), F.format_string("%.2f", F.coalesce(confidence, F.lit(0.0))), F.lit(")"))
    happened = F.concat(text(event), F.lit(" @ "), text(day), F.lit(" — "), text(label))
    return F.when(kind == "org", with_(code)).when(kind == "person", text(name)).when(kind.isin("product", "tech"), with_(category)).when(kind == "fact", fact).when(kind == "event", happened)


#: Headings of the lines of a context block.
CONTEXT_LINES = (("org", "관련 회사"), ("person", "관련 인물"), ("product", "제품"), ("tech", "기술"))


def context_block(rows: DataFrame) -> DataFrame:
    """RET7: the contexts as a text block, a line for each kind that has items."""
    line = lambda k, name: F.when(F.size(k) > 0, F.concat(F.lit(f"  {name}: "), F.array_join(k, ", ")))
    many = lambda k: F.when(F.size(k) > 0, F.array_join(F.transform(k, lambda x: F.concat(F.lit(f"  {k}: "), x)), "\n"))
    parts = [F.concat(F.lit("[chunk:"), F.col("chunk").cast("string"), F.lit("]")), *(line(k, n) for k, n in CONTEXT_LINES), many("fact"), many("event")]
    return rows.select("chunk", F.concat_ws("\n", *parts).alias("block"))


def query_signals(queries: DataFrame, companies: DataFrame) -> DataFrame:
    """S36, JON22: (qid, codes, year, in_scope): companies whose names the query holds, and its year.

    ``companies`` (name, code) is a stated dictionary; its names are looked up as the query's own pieces of their
    lengths, so the join is an equi-join on the name.
    """
    sizes = F.broadcast(companies.select(F.length("name").alias("n")).where("n > 0").distinct())  # lengths of names: a few
    pieces = queries.crossJoin(sizes).where(F.length("query") >= F.col("n"))
    pieces = pieces.select("qid", F.explode(F.transform(F.sequence(F.lit(1), F.length("query") - F.col("n") + 1), lambda i: F.substr("query", i, F.col("n").cast("int")))).alias("name")).distinct()
    found = pieces.join(companies, "name").groupBy("qid").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    year = F.regexp_extract("query", r"(?U)\b(20\d{2})\b", 1)
    out = queries.join(found, "qid", "left")
    return out.select("qid", F.coalesce("codes", F.array().cast("array<string>")).alias("codes"), F.when(year != "", year.cast("int")).alias("year"), F.col("codes").isNotNull().alias("in_scope"))


def gated(ranked: DataFrame, signals: DataFrame) -> DataFrame:
    """RET6: no results for queries that name no company in scope."""
    return ranked.join(signals.where("in_scope").select("qid"), "qid", "left_semi")


def reranked(ranked: DataFrame, scores: DataFrame, k: int, kept: Column) -> DataFrame:
    """RET4: the first k of each query by the scores of a second model (qid, item, second); where ``kept`` holds, the first order stays."""
    rows = ranked.join(scores, ["qid", "item"], "left").withColumn("_s", F.when(kept, F.col("score")).otherwise(F.col("second")))
    order = Window.partitionBy("qid").orderBy(F.desc_nulls_last("_s"), "rank")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("_s")


def category_gates(results: DataFrame, least: float = 0.85, silent: float = 0.5, excluded: tuple[str, ...] = ()) -> DataFrame:
    """AGG26: means of each category and whether it passes; categories without answers pass by a low mean top score.

    ``results``: (category, no_answer, recall, mrr, ndcg, top_score). ``overall`` leaves the excluded categories out.
    """
    g = results.groupBy("category").agg(F.count("*").alias("n"), F.bool_and("no_answer").alias("none"), F.avg("recall").alias("recall"), F.avg("mrr").alias("mrr"), F.avg("ndcg").alias("ndcg"), F.avg(F.coalesce("top_score", F.lit(0.0))).alias("top"), F.max(F.coalesce("top_score", F.lit(0.0))).alias("highest"))
    g = g.withColumn("passed", F.when(F.col("none"), F.col("top") < silent).otherwise(F.col("recall") >= least))
    whole = g.where(~F.col("category").isin(*excluded)).agg(F.bool_and("passed").alias("overall"))
    return g.crossJoin(F.broadcast(whole))


def missing(wanted: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """AGG30: one row: wanted, got, missing and unasked keys."""
    a, b = wanted.select(key).distinct().withColumn("_a", F.lit(1)), got.select(key).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, key, "full_outer")
    return both.agg(F.count("_a").alias("wanted"), F.count("_b").alias("got"), F.count(F.when(F.col("_b").isNull(), 1)).alias("missing"), F.count(F.when(F.col("_a").isNull(), 1)).alias("unasked"))


def stage_counts(linked: DataFrame) -> DataFrame:
    """AGG29: linked surfaces by stage, with the share of the ones that found an entity."""
    g = linked.groupBy("stage").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def representative(series: DataFrame, by: str) -> DataFrame:
    """WIN11: of the series of a code that have a value, the one with most rows (first id on ties)."""
    kept = series.where("value is not null")
    rest = [c for c in series.columns if c != by]
    return kept.groupBy(by).agg(F.min_by(F.struct(*rest), F.struct((-F.coalesce("total_rows", F.lit(0))).alias("r"), "id")).alias("s")).select(by, "s.*")


def latest_with(summaries: DataFrame, documents: DataFrame, n: int = 2) -> DataFrame:
    """WIN8: the latest summary of each company and the newest documents of its day."""
    last = summaries.groupBy("corp").agg(F.max_by(F.struct("day", "mentions"), "day").alias("s")).select("corp", "s.*")
    rows = documents.join(last, ["corp", "day"])
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("corp").orderBy(F.desc("ts"), "doc_id"))).where(F.col("rank") <= n).select("corp", "day", "mentions", "doc_id", "rank")


def pivot_periods(points: DataFrame, periods: list[str], value: str = "value") -> DataFrame:
    """AGG31: an indicator's values side by side, one column for each period asked for."""
    return points.groupBy("corp", "indicator").pivot("period", periods).agg(F.max(value))


def ordered_distinct(items: Column) -> Column:
    """SET6: distinct items in the order in which they first came."""
    return F.array_distinct(items)


def upside(series: Column, n: int = 8) -> Column:
    """WIN13: the last n items of an array."""
    return F.slice(series, F.greatest(F.lit(1), F.size(series) - (n - 1)), F.lit(n))


def resume_after(rows: DataFrame, key: str, marker: str | None) -> DataFrame:
    """STR3: rows after the last finished key, in key order; all without a marker."""
    return rows if marker is None else rows.where(F.col(key) > F.lit(marker))


def fan_out(*lists: DataFrame) -> DataFrame:
    """SRC10, SRC29: every combination of short stated lists (companies, years, reports): requests to make."""
    out = lists[0]
    for more in lists[1:]:
        out = out.crossJoin(F.broadcast(more))  # a product is what is asked for; lists are parameters of a run
    return out


def known_ends(edges: DataFrame, organisations: DataFrame, persons: DataFrame) -> DataFrame:
    """SNK10: edges whose end is an organisation or else a person; others are not written."""
    a, b = organisations.select(F.col("id").alias("dst"), F.lit("Organization").alias("_o")), persons.select(F.col("id").alias("dst"), F.lit("Person").alias("_p"))
    return edges.join(a.distinct(), "dst", "left").join(b.distinct(), "dst", "left").withColumn("kind", F.coalesce("_o", "_p")).where("kind is not null").drop("_o", "_p")


def marked_ready(chunks: DataFrame, run: str) -> DataFrame:
    """SNK12: rows of the run become ready."""
    return chunks.withColumn("status", F.when(F.col("run") == run, "ready").otherwise(F.col("status")))


def filled_where_null(rows: DataFrame, column: str, value: Column) -> DataFrame:
    """SNK23: an update that only touches missing values."""
    return rows.withColumn(column, F.coalesce(F.col(column), value))


def rebuilt(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """SNK3, STR8: an aggregate written anew from its source: nothing of the old rows stays, late rows are in."""
    return fresh.select(*old.columns)


def flagged(meta: Column, key: str, value: str) -> Column:
    """SNK18: a JSON object with one field set to a JSON value; the other fields keep theirs, whatever their types. NULL or malformed texts count as empty."""
    empty = F.from_json(F.lit("{}"), "map<string,variant>")
    held = F.coalesce(F.from_json(meta, "map<string,variant>"), empty)
    kept = F.map_filter(held, lambda k, v: k != key)
    return F.to_json(F.map_concat(kept, F.create_map(F.lit(key), F.parse_json(F.lit(value)))))


def feeds(news: DataFrame, table: DataFrame) -> DataFrame:
    """SNK25: publisher and category of each legacy row by its feed; unknown feeds keep their name as publisher."""
    rows = news.join(table, "feed", "left")
    return rows.withColumn("publisher", F.coalesce("publisher", "feed")).withColumn("category", F.coalesce("category", F.lit("")))


def merged_shares(scores: DataFrame) -> DataFrame:
    """AGG24: micro (sums, then ratios) and macro (mean of ratios) averages over groups (tp, fp, fn), and the share of exact groups."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    f1 = lambda p, r: F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    rows = scores.withColumn("p", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("r", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    sums = rows.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.avg("p").alias("macro_p"), F.avg("r").alias("macro_r"), F.avg(f1(F.col("p"), F.col("r"))).alias("macro_f1"), F.avg(((F.col("fp") == 0) & (F.col("fn") == 0)).cast("double")).alias("exact"))
    sums = sums.withColumn("micro_p", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("micro_r", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return sums.withColumn("micro_f1", f1(F.col("micro_p"), F.col("micro_r")))


def canonical_match(mentions: DataFrame, near: DataFrame) -> DataFrame:
    """ENT3: loose vector matches: equal canonical names from a score of 0.55 on, others from 0.70 with a margin of 0.03.

    ``near``: (surface, entity, name, score, rank).
    """
    first = near.where("rank = 1").select("surface", "entity", "name", "score")
    second = near.where("rank = 2").select("surface", F.col("score").alias("next"))
    rows = mentions.join(first, "surface").join(second, "surface", "left")
    own = S.canonical_name(F.col("surface"))
    same = (own != "") & (own == S.canonical_name(F.col("name"))) & (F.col("score") >= 0.55)
    loose = (F.col("score") >= 0.70) & (F.col("next").isNull() | (F.col("score") - F.col("next") >= 0.03))
    return rows.where(same | loose).select("surface", "entity", "score", F.when(same, "canonical").otherwise("margin").alias("rule"))
