"""Validation, routing statistics and graph rows of extracted records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Kinds of entities that are kept, kinds that relations may join, and the least confidence.
ENTITY_KINDS = ("Organization", "Person", "Product", "Technology", "Place")
RELATION_KINDS = ("Organization", "Person", "Product", "Technology")
LEAST_CONFIDENCE = 0.5


def subset(rows: DataFrame, wanted: dict[str, list | None]) -> DataFrame:
    """FIL25: rows whose columns are in the wanted values; an empty list or None takes all."""
    for column, values in wanted.items():
        if values:
            rows = rows.where(F.col(column).isin(*values))
    return rows


def class_samples(rows: DataFrame, by: str, key: str, most: int) -> DataFrame:
    """AGG28: rows of each class and the first few keys; ranked before they are gathered, so a class of any size is fine."""
    n = rows.groupBy(by).agg(F.count("*").alias("n"))
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(key))).where(F.col("_r") <= most)
    first = first.groupBy(by).agg(F.array_sort(F.collect_list(key)).alias("samples"))
    return n.join(first, by)


def valid_entities(rows: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """FIL13: rows (chunk, text, type, surface, span, confidence) whose type is known and whose surface and span the text holds."""
    rows = rows.withColumn("surface", F.trim("surface")).withColumn("span", F.trim("span"))
    named = (F.coalesce("surface", F.lit("")) != "") & (F.coalesce("span", F.lit("")) != "")
    return rows.where(F.col("type").isin(*ENTITY_KINDS) & named & F.col("text").contains(F.col("surface")) & F.col("text").contains(F.col("span")) & (F.coalesce("confidence", F.lit(0.0)) >= least))


def valid_relations(rows: DataFrame, entities: DataFrame, predicates: tuple[str, ...], least: float = LEAST_CONFIDENCE) -> DataFrame:
    """FIL13: rows (chunk, pos, text, subject, subject_type, predicate, object, object_type, span, confidence) that hold.

    Ends must be among the chunk's valid entities, if it has any; of equal triples of a chunk the first stays.
    """
    for c in ("subject", "object", "span"):
        rows = rows.withColumn(c, F.trim(F.coalesce(c, F.lit(""))))
    held = (F.col("subject") != "") & (F.col("object") != "") & (F.col("span") != "")
    for c in ("subject", "object", "span"):
        held = held & F.col("text").contains(F.col(c))
    held = held & F.col("predicate").isin(*predicates) & F.col("subject_type").isin(*RELATION_KINDS) & F.col("object_type").isin(*RELATION_KINDS) & (F.coalesce("confidence", F.lit(0.0)) >= least)
    known = entities.groupBy("chunk").agg(F.collect_set("surface").alias("known"))  # entities of one chunk, as many as a model returns
    rows = rows.where(held).join(known, "chunk", "left").where(F.col("known").isNull() | (F.array_contains("known", F.col("subject")) & F.array_contains("known", F.col("object"))))
    at = ["chunk", "subject", "predicate", "object"]
    rest = [c for c in rows.columns if c not in (*at, "known", "text")]
    return rows.groupBy(*at).agg(F.min_by(F.struct(*rest), F.col("pos")).alias("r")).select(*at, "r.*")


def deterministic(hits: DataFrame) -> DataFrame:
    """TXT3, JON20: (chunk, org, kind, other) candidates: each organisation of a chunk with each product or technology.

    ``hits``: (chunk, etype, entity). The product is formed inside a row from the distinct entities of one chunk.
    """
    sets = hits.groupBy("chunk").agg(*(F.collect_set(F.when(F.col("etype") == t, F.col("entity"))).alias(t) for t in ("Organization", "Product", "Technology")))
    pairs = [sets.select("chunk", F.explode("Organization").alias("org"), F.lit(kind).alias("kind"), F.col(t).alias("others")) for kind, t in (("produces", "Product"), ("uses_tech", "Technology"))]
    return pairs[0].unionByName(pairs[1]).select("chunk", "org", "kind", F.explode("others").alias("other"))


def mentions(records: DataFrame, entities: DataFrame) -> DataFrame:
    """JON25: (doc_id, entity) of the surfaces of each record that the dictionary (surface, entity) holds."""
    return records.select("doc_id", F.explode("surfaces").alias("surface")).join(entities, "surface").select("doc_id", "entity").distinct()


def resolved(rows: DataFrame, by_number: DataFrame, by_name: DataFrame) -> DataFrame:
    """JON17: code of (name, number) rows: by registration number, else by canonical name, else a code made from both.

    ``by_number``: (number, code); ``by_name``: (name, code); of several codes of a key the least is taken.
    """
    numbers = by_number.where("number <> ''").groupBy("number").agg(F.min("code").alias("_by_number"))
    names = by_name.select(S.canonical_name(F.col("name")).alias("_key"), "code").where("_key <> ''").groupBy("_key").agg(F.min("code").alias("_by_name"))
    out = rows.withColumn("_key", S.canonical_name(F.col("name"))).join(numbers, "number", "left").join(names, "_key", "left")
    made = F.concat(F.lit("X"), F.upper(F.substring(S.hash16(F.lit("xorg"), F.col("_key"), F.coalesce("number", F.lit(""))), 1, 7)))
    return out.select(*rows.columns, F.coalesce("_by_number", "_by_name", made).alias("code"), F.when(F.col("_by_number").isNotNull(), "number").when(F.col("_by_name").isNotNull(), "name").otherwise("made").alias("found_by"))


def absorbed(nodes: DataFrame, aliases: DataFrame, organisations: DataFrame) -> DataFrame:
    """ENT5: (node, code): news nodes (node, name, canonical) that an alias (alias, code) of a known organisation names.

    Tried in order: canonical form of the name, of the canonical, the name, the canonical; the first key that the
    dictionary holds decides, even if its organisation is missing.
    """
    canonical = F.when(F.coalesce("canonical", F.lit("")) != "", F.col("canonical")).otherwise(F.coalesce("name", F.lit("")))
    keys = F.array(S.canonical_name(F.col("name")), S.canonical_name(canonical), F.coalesce("name", F.lit("")), canonical)
    tried = nodes.select("node", F.posexplode(keys).alias("pos", "alias")).where("alias <> ''")
    found = tried.join(aliases.groupBy("alias").agg(F.min("code").alias("code")), "alias").groupBy("node").agg(F.min_by("code", "pos").alias("code"))
    return found.join(organisations.select("code").distinct(), "code", "left_semi").select("node", "code")


def clustered(triples: DataFrame, entity_forms: DataFrame, predicate_forms: DataFrame) -> DataFrame:
    """ENT8: triples (subject, predicate, object) in canonical forms beside their surfaces.

    ``entity_forms`` and ``predicate_forms``: (canonical, surface); a canonical form stands for itself.
    """

    def forms(rows: DataFrame, end: str) -> DataFrame:
        both = rows.select("surface", "canonical", F.lit(0).alias("p")).unionByName(rows.select(F.col("canonical").alias("surface"), "canonical", F.lit(1).alias("p")))
        return both.groupBy("surface").agg(F.min_by("canonical", F.struct("p", "canonical")).alias(f"_{end}")).withColumnRenamed("surface", end)

    out = triples
    for end, rows in (("subject", entity_forms), ("predicate", predicate_forms), ("object", entity_forms)):
        out = out.join(forms(rows, end), end, "left")
    ends = ("subject", "predicate", "object")
    return out.select(*[c for c in triples.columns if c not in ends], *(F.coalesce(f"_{e}", e).alias(e) for e in ends), *(F.col(e).alias(f"{e}_surface") for e in ends))
