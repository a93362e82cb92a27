"""Extracted records into graph frames: surfaces are linked, relations get a tier, and each tier is a frame of its own."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .graph import tier

#: Predicates that are events, and the part that an entity of a kind plays in a chunk.
EVENT_PREDICATES = ("MERGED_WITH", "INVESTED_IN")
CHUNK_ROLES = {"Organization": "hasActor", "Person": "hasActor", "Product": "hasObject", "Technology": "hasObject", "Place": "hasObject"}


class Frames(NamedTuple):
    """What extracted records become; ids are digests of their parts, so the frames join on them and a repeated load gives the same."""

    linked: DataFrame  # chunk, pos, surface, type, entity, name
    unlinked: DataFrame  # chunk, pos, surface, type, canonical
    evidence: DataFrame  # chunk, role, type, entity, name
    things: DataFrame  # type, entity, name, canonical, aliases, chunk
    statements: DataFrame  # statement_id, subject, subject_type, predicate, object, object_type, confidence, valid_from, chunk
    relations: DataFrame  # relation_id, the same
    events: DataFrame  # event_id, event_type, label, day, corp, confidence, chunk
    event_ends: DataFrame  # event_id, entity, role
    generated: DataFrame  # target_id, target_label, activity
    counts: DataFrame  # one row: what was linked, left out and made


def linked_surfaces(entities: DataFrame, dictionary: DataFrame) -> DataFrame:
    """ENT11, stage 1: ``entities`` (chunk, pos, surface, type) with the ``entity`` that the dictionary (type, surface, entity, ambiguous) names, or NULL.

    The canonical form is looked up first, then the surface, both among the dictionary's names and their canonical forms; of several entities the largest id.
    """
    usable = dictionary.where(~F.coalesce("ambiguous", F.lit(False)) & (F.coalesce("surface", F.lit("")) != ""))
    forms = F.explode(F.array_distinct(F.array(S.canonical_name(F.col("surface")), F.col("surface"))))
    names = usable.select("type", forms.alias("form"), "entity").groupBy("type", "form").agg(F.max("entity").alias("entity"))
    rows = entities.where((F.coalesce("surface", F.lit("")) != "") & (F.coalesce("type", F.lit("")) != "")).withColumn("canonical", S.canonical_name(F.col("surface")))
    rows = rows.join(names.select("type", F.col("form").alias("canonical"), F.col("entity").alias("_a")), ["type", "canonical"], "left")
    rows = rows.join(names.select("type", F.col("form").alias("surface"), F.col("entity").alias("_b")), ["type", "surface"], "left")
    return rows.select("chunk", "pos", "surface", "type", "canonical", F.coalesce("_a", "_b").alias("entity"))


def load_records(entities: DataFrame, relations: DataFrame, dictionary: DataFrame, activity: str) -> Frames:
    """ENT11: the graph frames of extracted records.

    ``entities``: (chunk, pos, surface, type); ``relations``: (chunk, pos, subject, predicate, object, confidence, valid_from, evidence_count, many_sources),
    the last two NULL where unknown. An end of a relation is the chunk's linked entity of that surface (of several the last); relations
    with an unlinked end are counted and left out. Extracted relations always have a confidence, so they are events, relations (two or more documents or
    sources) or statements. Rows that would get one id are one row: its last.
    """
    rows = linked_surfaces(entities, dictionary)
    linked = rows.where("entity is not null").withColumn("name", F.when(F.col("canonical") != "", F.col("canonical")).otherwise(F.col("surface")))
    unlinked = rows.where("entity is null").drop("entity")
    role = F.create_map(*[F.lit(x) for pair in CHUNK_ROLES.items() for x in pair])
    first = lambda *c: F.min_by(F.struct(*c), F.struct("chunk", "pos")).alias("r")
    evidence = linked.withColumn("role", F.try_element_at(role, F.col("type"))).where("role is not null").groupBy("chunk", "role", "type", "entity").agg(F.min_by("name", "pos").alias("name"))
    things = linked.where(F.col("type").isin("Product", "Technology")).groupBy("type", "entity").agg(first("name", "canonical", "chunk"), F.array_sort(F.collect_set("surface")).alias("aliases")).select("type", "entity", "r.*", "aliases")

    ends = linked.groupBy("chunk", "surface").agg(F.max_by(F.struct("entity", "type"), "pos").alias("e"))
    end = lambda c: ends.select("chunk", F.col("surface").alias(c), F.col("e").alias(f"_{c}"))
    joined = relations.join(end("subject"), ["chunk", "subject"], "left").join(end("object"), ["chunk", "object"], "left")
    known = joined.where("_subject is not null and _object is not null")
    since = F.trim(F.coalesce("valid_from", F.lit("")))
    known = known.select(
        "chunk", "pos", "predicate", F.col("_subject.entity").alias("subject"), F.col("_subject.type").alias("subject_type"), F.col("_object.entity").alias("object"), F.col("_object.type").alias("object_type"),
        F.coalesce(F.col("confidence"), F.lit(0.0)).alias("confidence"), F.when(since != "", since).alias("valid_from"), F.coalesce("evidence_count", F.lit(1)).alias("evidence_count"), F.coalesce("many_sources", F.lit(False)).alias("many_sources"),
    )
    known = known.withColumn("tier", tier(F.col("valid_from").isNotNull(), F.lit(True), F.col("evidence_count"), F.col("many_sources"), F.col("predicate").isin(*EVENT_PREDICATES)))
    day = F.coalesce("valid_from", F.lit(""))
    key = (
        F.when(F.col("tier") == "event", S.hash16(F.lit("event"), F.col("predicate"), F.col("subject"), day, F.col("chunk")))
        .when(F.col("tier") == "relation", S.hash16(F.lit("rel"), F.col("predicate"), F.col("subject"), F.col("object"), day, F.col("chunk")))
        .otherwise(S.hash16(F.lit("stmt"), F.col("subject"), F.col("predicate"), F.col("object"), F.col("chunk")))
    )
    facts = known.withColumn("id", key)
    common = ("subject", "subject_type", "predicate", "object", "object_type", "confidence", "valid_from", "chunk")
    last = facts.groupBy("tier", "id").agg(F.max_by(F.struct(*common), "pos").alias("r")).select("tier", "id", "r.*")
    statements = last.where("tier = 'statement'").select(F.col("id").alias("statement_id"), *common)
    made = last.where("tier = 'relation'").select(F.col("id").alias("relation_id"), *common)
    corp = F.when(F.col("subject_type") == "Organization", F.col("subject"))
    events = last.where("tier = 'event'").select(F.col("id").alias("event_id"), F.col("predicate").alias("event_type"), F.concat_ws(" ", "subject", "predicate", "object").alias("label"), F.col("valid_from").alias("day"), corp.alias("corp"), "confidence", "chunk")
    part = lambda c, kind, name: F.when(F.col(f"{c}_type") == kind, F.struct(F.col(c).alias("entity"), F.lit(name).alias("role")))
    ends_of = F.array_compact(F.array(part("subject", "Organization", "actor"), part("object", "Organization", "target"), part("object", "Product", "product")))
    event_ends = facts.where("tier = 'event'").select(F.col("id").alias("event_id"), F.explode(ends_of).alias("e")).select("event_id", "e.*").distinct()
    generated = last.select(F.col("id").alias("target_id"), F.initcap("tier").alias("target_label"), F.lit(activity).alias("activity"))

    of = lambda name, df: df.agg(F.lit(name).alias("what"), F.count("*").alias("n"))
    both = joined.select(F.expr("_subject is not null and _object is not null").alias("known"))
    counts = of("entities_linked", linked).union(of("unlinked_entities", unlinked)).union(of("relations_unlinked", both.where("not known")))
    tiers = facts.groupBy("tier").agg(F.count("*").alias("n")).select(F.concat("tier", F.lit("s")).alias("what"), "n")
    counts = counts.union(tiers).groupBy().pivot("what", ["entities_linked", "unlinked_entities", "relations_unlinked", "statements", "relations", "events"]).agg(F.coalesce(F.sum("n"), F.lit(0)))
    ratio = F.coalesce(F.try_divide(F.col("entities_linked"), F.col("entities_linked") + F.col("unlinked_entities")), F.lit(0.0))
    counts = counts.na.fill(0).withColumn("linked_ratio", F.round(ratio, 4))
    return Frames(linked.drop("canonical"), unlinked, evidence, things, statements, made, events, event_ends, generated, counts)


#: What a company's name holds.
COMPANY_MARKS = ("주식회사", "(주)", "㈜", "보험", "은행", "투자", "캐피탈", "증권", "Co", "Inc", "Corp", "Ltd", "유한", "유한회사", "재단")


def executives(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ENT12: (person, name, birth, gender, career) and (person, corp, post, registered, full_time, duty, since, until, receipt) of executive rows.

    ``rows``: (corp, seq, nm, birth_ym, sexdstn, main_career, ofcps, rgist_exctv_at, fte_at, chrg_job, hffc_pd, tenure_end_on, rcept_no). A person is a name and a
    birth month, whatever the company; of several rows the last (by ``seq``) tells the rest. Rows without a name are left out.
    """
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    known = rows.withColumn("name", text("nm")).withColumn("birth", text("birth_ym")).where("name <> ''")
    known = known.withColumn("person", S.hash16(F.lit("person"), F.col("name"), F.col("birth")))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    own = F.struct("name", "birth", blank("sexdstn").alias("gender"), F.substring(blank("main_career"), 1, 500).alias("career"))
    persons = known.groupBy("person").agg(F.max_by(own, F.struct("corp", "seq")).alias("r")).select("person", "r.*")
    edges = known.select(
        "person", "corp", text("ofcps").alias("post"), blank("rgist_exctv_at").alias("registered"), blank("fte_at").alias("full_time"),
        F.substring(blank("chrg_job"), 1, 200).alias("duty"), text("hffc_pd").alias("since"), S.parse_date_loose(F.col("tenure_end_on")).alias("until"), blank("rcept_no").alias("receipt"),
    )
    return persons, edges


def _by_name(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows with the registered ``code`` of their name (of several the least), else a code made from its canonical form; ``made`` tells which."""
    names = registry.select(S.canonical_name(F.col("name")).alias("_key"), "code").where("_key <> ''").groupBy("_key").agg(F.min("code").alias("_code"))
    out = rows.withColumn("_key", S.canonical_name(F.col("name"))).join(names, "_key", "left")
    return out.withColumn("made", F.col("_code").isNull()).withColumn("code", F.coalesce("_code", S.synthetic_code(F.col("_key")))).drop("_code")


def shareholders(largest: DataFrame, reported: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """ENT12: new persons (person, name), new organisations (code, name, canonical) and edges (holder, kind, corp, relation, stake, shares, receipt, source).

    ``largest``: (corp, nm, relate, end_rate, start_rate, end_shares, start_shares, rcept_no), the closing figures before the opening ones; ``reported``:
    (corp, repror, stkrt, stkqy, report_tp, rcept_no); ``registry``: (name, code). Names that look like a company's are
    looked up, others are persons told by their name alone.
    """
    first = lambda a, b: F.when(F.coalesce(F.col(a), F.lit("")) != "", F.col(a)).otherwise(F.col(b))
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    a = largest.select("corp", text("nm").alias("name"), text("relate").alias("relation"), S.parse_rate(first("end_rate", "start_rate")).alias("stake"), S.parse_amount(first("end_shares", "start_shares")).alias("shares"), F.coalesce("rcept_no", F.lit("")).alias("receipt"), F.lit("largest").alias("source"))
    b = reported.select("corp", text("repror").alias("name"), text("report_tp").alias("relation"), S.parse_rate(F.col("stkrt")).alias("stake"), S.parse_amount(F.col("stkqy")).alias("shares"), F.coalesce("rcept_no", F.lit("")).alias("receipt"), F.lit("reported").alias("source"))
    company = F.lit(False)
    for mark in COMPANY_MARKS:
        company = company | F.col("name").contains(mark)
    rows = _by_name(a.unionByName(b).where("name <> ''"), registry).withColumn("kind", F.when(company, "Organization").otherwise("Person"))
    rows = rows.withColumn("holder", F.when(company, F.col("code")).otherwise(S.hash16(F.lit("person_shr"), F.col("name"))))
    persons = rows.where("kind = 'Person'").select(F.col("holder").alias("person"), "name").distinct()
    made = rows.where("kind = 'Organization' and made").groupBy("code").agg(F.min(F.struct("name", F.col("_key").alias("canonical"))).alias("r")).select("code", "r.*")
    return persons, made, rows.select("holder", "kind", "corp", "relation", "stake", "shares", "receipt", "source")


def investments(rows: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ENT12: new organisations (code, name, canonical) and edges (investor, target, purpose, stake, amount, quantity, first_acquired, receipt, subsidiary).

    ``rows``: (corp, inv_prm, invstmnt_purps, end_rate, start_rate, end_amount, start_amount, end_quantity, start_quantity, frst_acqs_de, rcept_no).
    A stake of half or more is a subsidiary.
    """
    first = lambda a, b: F.when(F.coalesce(F.col(a), F.lit("")) != "", F.col(a)).otherwise(F.col(b))
    named = _by_name(rows.withColumn("name", F.trim(F.coalesce("inv_prm", F.lit("")))).where("name <> ''"), registry)
    made = named.where("made").groupBy("code").agg(F.min(F.struct("name", F.col("_key").alias("canonical"))).alias("r")).select("code", "r.*")
    stake = S.parse_rate(first("end_rate", "start_rate"))
    edges = named.select(
        F.col("corp").alias("investor"), F.col("code").alias("target"), F.trim(F.coalesce("invstmnt_purps", F.lit(""))).alias("purpose"), stake.alias("stake"), S.parse_amount(first("end_amount", "start_amount")).alias("amount"),
        S.parse_amount(first("end_quantity", "start_quantity")).alias("quantity"), S.parse_date_loose(F.col("frst_acqs_de")).alias("first_acquired"), F.coalesce("rcept_no", F.lit("")).alias("receipt"), F.coalesce(stake >= 50.0, F.lit(False)).alias("subsidiary"),
    )
    return made, edges
