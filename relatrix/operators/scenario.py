"""Targets of entity resolution, and questions answered through several layers: vectors, neighbours, facts, provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .retrieval import dense_top_k


def er_targets(dictionary: DataFrame, nodes: DataFrame) -> DataFrame:
    """ENT9: (corp, name, text, source, point): what organisations are embedded as, the dictionary's before the graph's.

    ``dictionary``: (key, name, aliases, tickers, subsidiaries), keys of digits filled to eight; ``nodes``: (corp, name, aliases, ksic). Of an
    organisation in both only the industry code is taken from the graph. Nodes without a code or a name are left out; of several nodes of a code the least counts.
    """
    none = F.array().cast("array<string>")
    key = F.when(F.col("key").rlike(r"^\d+$"), F.lpad("key", 8, "0")).otherwise(F.col("key"))
    own = dictionary.select(key.alias("corp"), F.coalesce("name", key).alias("_name"), F.coalesce("aliases", none).alias("_aliases"), F.coalesce("tickers", none).alias("_tickers"), F.coalesce("subsidiaries", none).alias("_subs"), F.lit(True).alias("_own"))
    found = nodes.where("corp is not null and name is not null").groupBy("corp").agg(F.min(F.struct("name", F.coalesce("aliases", none).alias("aliases"), F.coalesce("ksic", F.lit("")).alias("ksic"))).alias("n"))
    rows = own.join(found, "corp", "full_outer").withColumn("_own", F.coalesce("_own", F.lit(False)))
    pick = lambda a, b: F.when(F.col("_own"), a).otherwise(b)
    many = lambda c: F.array_join(F.coalesce(c, none), " ")
    name = pick(F.col("_name"), F.col("n.name"))
    text = F.concat(name, F.lit(" "), many(pick(F.col("_aliases"), F.col("n.aliases"))), F.lit(" "), many(F.col("_tickers")), F.lit(" "), F.coalesce("n.ksic", F.lit("")), F.lit(" "), many(F.col("_subs")), F.lit(" "))
    return rows.select("corp", name.alias("name"), F.trim(text).alias("text"), F.when(F.col("_own"), "dictionary").otherwise("graph").alias("source"), S.uuid_from_id(F.concat(F.lit("orgER:"), "corp")).alias("point"))


def best_hits(queries: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """RET8, the first layer: (qid, hits, chunk): each question's ``k`` hits and the best of them, both NULL without a hit.

    ``queries``: (qid, query); ``chunks``: (vec_id, chunk, embedding).
    """
    hits = dense_top_k(queries, chunks, k).join(chunks.select("vec_id", "chunk"), "vec_id")
    own = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk", "score"))).alias("hits"))
    return queries.select("qid").join(own, "qid", "left").withColumn("chunk", F.get("hits", F.lit(0))["chunk"])


def scenarios(rows: DataFrame, evidence: DataFrame, statements: DataFrame, events: DataFrame, generated: DataFrame, most: int = 5) -> DataFrame:
    """RET8: one row a question: its hits, the best hit's neighbours and facts, and whether every statement of it tells what made it.

    ``rows``: (qid, hits, chunk) of the best hits, read several times; the others as of extracted records, of which only those of the best hits' chunks count.
    Lists hold the first ``most``; a question without a hit has a NULL chunk.
    """
    wanted = rows.select("chunk").where("chunk is not null").distinct()
    near = evidence.join(wanted, "chunk", "left_semi").withColumn("_r", F.row_number().over(Window.partitionBy("chunk", "role").orderBy("name", "entity")))
    first = lambda role: F.array_sort(F.collect_list(F.when((F.col("role") == role) & (F.col("_r") <= most), F.struct("name", "type"))))
    near = near.where(F.col("_r") <= most).groupBy("chunk").agg(first("hasActor").alias("actors"), first("hasObject").alias("objects"))
    said = statements.join(wanted, "chunk", "left_semi").join(generated.select(F.col("target_id").alias("statement_id"), F.lit(1).alias("_made")).distinct(), "statement_id", "left")
    said = said.groupBy("chunk").agg(F.count("*").alias("statements"), F.count("_made").alias("with_activity"))
    happened = events.join(wanted, "chunk", "left_semi").groupBy("chunk").agg(F.count("*").alias("events"))
    out = rows.join(near, "chunk", "left").join(said, "chunk", "left").join(happened, "chunk", "left")
    n = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    empty = F.array().cast("array<struct<name: string, type: string>>")
    actors, objects = F.coalesce("actors", empty), F.coalesce("objects", empty)
    quality = F.when(F.col("chunk").isNull(), "no hit").when(F.size(actors) + F.size(objects) > 0, "good").otherwise("weak")
    return out.select("qid", "chunk", "hits", actors.alias("actors"), objects.alias("objects"), (n("statements") + n("events")).alias("facts"), n("statements").alias("statements"), n("with_activity").alias("with_activity"), (n("statements") == n("with_activity")).alias("provenance"), quality.alias("quality"))
