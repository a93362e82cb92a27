"""Queries over graph frames of extracted records, registered persons and stakes, and questions about several companies.

Records are made from orders: a supplier is an entity whose kind its number tells, a line is an extracted entity and a relation to the order's first supplier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import retrieval as Q
from ..operators import semantic as M
from ..session import written
from .registry import query
from .text_plans import _COS

_KIND = "CASE l_suppkey % 5 WHEN 0 THEN 'Organization' WHEN 1 THEN 'Person' WHEN 2 THEN 'Product' WHEN 3 THEN 'Technology' ELSE 'Place' END"
_REC = f"""t AS (SELECT CAST(l_orderkey AS VARCHAR) AS chunk, l_partkey * 10 + l_linenumber AS pos, l_suppkey AS k, {_KIND} AS type, concat('E', CAST(l_suppkey AS VARCHAR), CASE WHEN l_suppkey % 5 = 0 AND l_linenumber % 2 = 0 THEN ' Inc.' ELSE '' END) AS surface,
CASE WHEN l_suppkey % 7 <> 3 AND l_suppkey % 11 <> 5 THEN concat('C', CAST(l_suppkey AS VARCHAR)) END AS entity, concat('E', CAST(min(l_suppkey) OVER (PARTITION BY l_orderkey) AS VARCHAR)) AS object, CASE l_returnflag WHEN 'R' THEN 'MERGED_WITH' WHEN 'A' THEN 'SUPPLIES' ELSE CASE WHEN l_linestatus = 'F' THEN 'INVESTED_IN' ELSE 'USES' END END AS predicate,
round(l_discount * 10, 6) AS confidence, CASE WHEN l_partkey % 2 = 0 THEN strftime(l_shipdate, '%Y-%m-%d') END AS since, l_partkey % 3 = 0 AS strong FROM lineitem),
e AS (SELECT chunk, surface, any_value(entity) AS entity, any_value(type) AS type FROM t WHERE entity IS NOT NULL GROUP BY chunk, surface),
f AS (SELECT t.chunk, t.pos, t.predicate, a.entity AS subject, a.type AS subject_type, b.entity AS object, b.type AS object_type, t.confidence, t.since AS valid_from, CASE WHEN t.predicate IN ('MERGED_WITH', 'INVESTED_IN') THEN 'event' WHEN t.strong THEN 'relation' ELSE 'statement' END AS tier FROM t JOIN e a ON a.chunk = t.chunk AND a.surface = t.surface JOIN e b ON b.chunk = t.chunk AND b.surface = t.object),
i AS (SELECT *, md5(CASE tier WHEN 'event' THEN concat('event|', predicate, '|', subject, '|', coalesce(valid_from, ''), '|', chunk) WHEN 'relation' THEN concat('rel|', predicate, '|', subject, '|', object, '|', coalesce(valid_from, ''), '|', chunk) ELSE concat('stmt|', subject, '|', predicate, '|', object, '|', chunk) END)[1:16] AS id FROM f),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tier, id ORDER BY pos DESC) AS rn FROM i) WHERE rn = 1)"""


def _frames(read, chunks: DataFrame | None = None) -> M.Frames:
    """Frames of all records, or of those of some ``chunks``: a chunk's records are linked, tiered and numbered by themselves, so all frames but things and counts are the same for it."""
    k, own = F.col("l_suppkey"), F.col("l_orderkey").cast("string").alias("chunk")
    pos = (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("pos")
    name = F.concat(F.lit("E"), k.cast("string"))
    kind = F.when(k % 5 == 0, "Organization").when(k % 5 == 1, "Person").when(k % 5 == 2, "Product").when(k % 5 == 3, "Technology").otherwise("Place")
    surface = F.when((k % 5 == 0) & (F.col("l_linenumber") % 2 == 0), F.concat(name, F.lit(" Inc."))).otherwise(name)
    lines = read("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate")
    if chunks is not None:
        lines = written(lines.join(chunks, F.col("l_orderkey").cast("string") == F.col("chunk"), "left_semi"), "records")
    entities = lines.select(own, pos, surface.alias("surface"), kind.alias("type"))
    first = lines.groupBy(own).agg(F.concat(F.lit("E"), F.min("l_suppkey").cast("string")).alias("object"))
    predicate = F.when(F.col("l_returnflag") == "R", "MERGED_WITH").when(F.col("l_returnflag") == "A", "SUPPLIES").when(F.col("l_linestatus") == "F", "INVESTED_IN").otherwise("USES")
    since = F.when(F.col("l_partkey") % 2 == 0, F.date_format("l_shipdate", "yyyy-MM-dd")).otherwise(" ")
    strong = F.col("l_partkey") % 3 == 0
    relations = lines.select(own, pos, surface.alias("subject"), predicate.alias("predicate"), F.round(F.col("l_discount") * 10, 6).alias("confidence"), since.alias("valid_from"), F.when(strong & (k % 2 == 0), 2).alias("evidence_count"), F.when(strong & (k % 2 == 1), True).alias("many_sources")).join(first, "chunk")
    suppliers = read("supplier").withColumnRenamed("s_suppkey", "l_suppkey")
    dictionary = suppliers.where("l_suppkey % 7 <> 3").select(kind.alias("type"), name.alias("surface"), F.concat(F.lit("C"), k.cast("string")).alias("entity"), F.when(k % 11 == 5, True).alias("ambiguous"))
    return M.load_records(entities, relations, dictionary, "act")


_COMMON = "subject, subject_type, predicate, object, object_type, confidence, valid_from, chunk"


@query(f"WITH {_REC} SELECT id AS statement_id, {_COMMON} FROM o WHERE tier = 'statement'")
def ent11_statements(read):
    return _frames(read).statements


@query(f"WITH {_REC} SELECT id AS relation_id, {_COMMON} FROM o WHERE tier = 'relation'")
def ent11_relations(read):
    return _frames(read).relations


@query(f"WITH {_REC} SELECT id AS event_id, predicate AS event_type, concat(subject, ' ', predicate, ' ', object) AS label, valid_from AS day, CASE WHEN subject_type = 'Organization' THEN subject END AS corp, confidence, chunk FROM o WHERE tier = 'event'")
def ent11_events(read):
    return _frames(read).events


@query(f"""WITH {_REC} SELECT DISTINCT id AS event_id, subject AS entity, 'actor' AS role FROM i WHERE tier = 'event' AND subject_type = 'Organization' UNION SELECT id, object, 'target' FROM i WHERE tier = 'event' AND object_type = 'Organization' UNION SELECT id, object, 'product' FROM i WHERE tier = 'event' AND object_type = 'Product'""")
def ent11_event_ends(read):
    return _frames(read).event_ends


@query(f"WITH {_REC} SELECT DISTINCT chunk, CASE WHEN type IN ('Organization', 'Person') THEN 'hasActor' ELSE 'hasObject' END AS role, type, entity, concat('E', entity[2:]) AS name FROM t WHERE entity IS NOT NULL")
def ent11_evidence(read):
    return _frames(read).evidence


@query(f"WITH {_REC} SELECT type, entity, concat('E', entity[2:]) AS name, concat('E', entity[2:]) AS canonical, min(chunk) AS chunk, concat('E', entity[2:]) AS aliases FROM t WHERE entity IS NOT NULL AND type IN ('Product', 'Technology') GROUP BY type, entity")
def ent11_things(read):
    return _frames(read).things.withColumn("aliases", F.array_join("aliases", ","))


@query(f"WITH {_REC} SELECT id AS target_id, CASE tier WHEN 'event' THEN 'Event' WHEN 'relation' THEN 'Relation' ELSE 'Statement' END AS target_label, 'act' AS activity FROM o")
def ent11_generated(read):
    return _frames(read).generated


@query(f"""WITH {_REC}, c AS (SELECT (SELECT count(*) FROM t WHERE entity IS NOT NULL) AS entities_linked, (SELECT count(*) FROM t WHERE entity IS NULL) AS unlinked_entities, (SELECT count(*) FROM t) - (SELECT count(*) FROM f) AS relations_unlinked,
(SELECT count(*) FROM f WHERE tier = 'statement') AS statements, (SELECT count(*) FROM f WHERE tier = 'relation') AS relations, (SELECT count(*) FROM f WHERE tier = 'event') AS events) SELECT *, round(entities_linked / CAST(entities_linked + unlinked_entities AS DOUBLE), 4) AS linked_ratio FROM c""")
def ent11_counts(read):
    return _frames(read).counts


@query("""WITH p AS (SELECT trim(s_name) AS name, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE concat('19', CAST(60 + s_suppkey % 30 AS VARCHAR), '.01') END AS birth, s_suppkey AS k, s_nationkey FROM supplier WHERE s_suppkey % 5 > 0)
SELECT md5(concat('person|', name, '|', birth))[1:16] AS person, concat('N', CAST(s_nationkey AS VARCHAR)) AS corp, CASE WHEN k % 2 = 0 THEN '사장' ELSE '' END AS post, repeat('d', 200) AS duty, CASE WHEN k % 4 = 0 THEN '2026-03-01' END AS until, CAST(k AS VARCHAR) AS receipt, name AS shown, birth, 'm' AS gender, 500 AS career FROM p""")
def ent12_executives(read):
    k = F.col("s_suppkey")
    rows = read("supplier").select(
        F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("corp"), k.alias("seq"), F.when(k % 5 == 0, " ").otherwise(F.concat(F.lit(" "), "s_name")).alias("nm"), F.when(k % 3 > 0, F.concat(F.lit(" 19"), (60 + k % 30).cast("string"), F.lit(".01"))).alias("birth_ym"), F.lit("m").alias("sexdstn"),
        F.repeat(F.lit("c"), 600).alias("main_career"), F.when(k % 2 == 0, " 사장 ").alias("ofcps"), F.lit(None).cast("string").alias("rgist_exctv_at"), F.lit("상근").alias("fte_at"), F.repeat(F.lit("d"), 300).alias("chrg_job"), F.lit(" x ").alias("hffc_pd"),
        F.when(k % 4 == 0, "2026.03.01").alias("tenure_end_on"), k.cast("string").alias("rcept_no"),
    )
    persons, edges = M.executives(rows)
    return edges.join(persons.select("person", F.col("name").alias("shown"), "birth", "gender", F.length("career").alias("career")), "person").select("person", "corp", "post", "duty", "until", "receipt", "shown", "birth", "gender", "career")


_HOLDER = """h AS (SELECT s_suppkey AS k, concat('N', CAST(s_nationkey AS VARCHAR)) AS corp, CASE s_suppkey % 4 WHEN 0 THEN concat('㈜', (SELECT n_name FROM nation WHERE n_nationkey = s_nationkey)) WHEN 1 THEN concat('Fund', CAST(s_suppkey % 9 AS VARCHAR), ' Inc.') WHEN 2 THEN concat('Kim ', CAST(s_suppkey % 13 AS VARCHAR)) END AS name, s_nationkey FROM supplier WHERE s_suppkey % 4 < 3),
x AS (SELECT *, CASE WHEN k % 4 = 0 THEN concat('N', CAST(s_nationkey AS VARCHAR)) WHEN k % 4 = 1 THEN concat('X', upper(md5(concat('xorg|', replace(name, ' Inc.', '')))[1:7])) ELSE md5(concat('person_shr|', name))[1:16] END AS holder, CASE WHEN k % 4 = 2 THEN 'Person' ELSE 'Organization' END AS kind FROM h)"""


@query(f"""WITH {_HOLDER} SELECT holder, kind, corp, CASE WHEN k % 2 = 0 THEN '본인' ELSE '' END AS relation, CAST(CASE WHEN k % 3 = 0 THEN 12.5 ELSE 7.25 END AS DOUBLE) AS stake, CAST(k * 1000 AS BIGINT) AS shares, CAST(k AS VARCHAR) AS receipt, 'largest' AS source FROM x
UNION ALL SELECT holder, kind, corp, '신규', NULL, -CAST(k AS BIGINT), '', 'reported' FROM x WHERE k % 8 < 3""")
def ent12_shareholders(read):
    return M.shareholders(*_holders(read))[2]


@query(f"""WITH {_HOLDER} SELECT holder, kind, min(CASE WHEN kind = 'Person' THEN name ELSE concat(name, '/', replace(name, ' Inc.', '')) END) AS shown FROM x WHERE k % 4 > 0 GROUP BY holder, kind""")
def ent12_new_holders(read):
    persons, made, _ = M.shareholders(*_holders(read))
    return persons.select(F.col("person").alias("holder"), F.lit("Person").alias("kind"), F.col("name").alias("shown")).unionByName(made.select(F.col("code").alias("holder"), F.lit("Organization").alias("kind"), F.concat_ws("/", "name", "canonical").alias("shown")))


def _holders(read):
    k = F.col("s_suppkey")
    nations = read("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    name = F.when(k % 4 == 0, F.concat(F.lit(" ㈜"), "n_name")).when(k % 4 == 1, F.concat(F.lit("Fund"), (k % 9).cast("string"), F.lit(" Inc."))).when(k % 4 == 2, F.concat(F.lit("Kim "), (k % 13).cast("string"), F.lit(" ")))
    s = read("supplier").join(F.broadcast(nations), "s_nationkey").withColumn("nm", name).withColumn("corp", F.concat(F.lit("N"), F.col("s_nationkey").cast("string")))
    largest = s.select("corp", "nm", F.when(k % 2 == 0, " 본인 ").alias("relate"), F.when(k % 3 == 0, "12.5%").alias("end_rate"), F.lit("7.25").alias("start_rate"), F.format_number(k * 1000, 0).alias("end_shares"), F.lit("1").alias("start_shares"), k.cast("string").alias("rcept_no"))
    reported = s.where("s_suppkey % 8 < 3").select("corp", F.col("nm").alias("repror"), F.lit("-").alias("stkrt"), F.concat(F.lit("△"), k.cast("string")).alias("stkqy"), F.lit("신규").alias("report_tp"), F.lit(None).cast("string").alias("rcept_no"))
    registry = nations.select(F.concat("n_name", F.lit(" Corp.")).alias("name"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("code"))
    return largest, reported, registry


@query("""SELECT concat('N', CAST(s_nationkey AS VARCHAR)) AS investor, CASE WHEN s_suppkey % 2 = 0 THEN concat('N', CAST(s_nationkey AS VARCHAR)) ELSE concat('X', upper(md5(concat('xorg|T', CAST(s_suppkey % 9 AS VARCHAR)))[1:7])) END AS target, CAST(CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 3 = 1 THEN 50.0 ELSE 49.9 END AS DOUBLE) AS stake, s_suppkey % 3 = 1 AS subsidiary,
CASE WHEN s_suppkey % 5 = 0 THEN -CAST(s_suppkey AS BIGINT) ELSE 77 END AS amount, '2020-01-05' AS first_acquired, CASE WHEN s_suppkey % 2 = 1 THEN concat('T', CAST(s_suppkey % 9 AS VARCHAR)) END AS made FROM supplier WHERE s_suppkey % 11 > 0""")
def ent12_investments(read):
    k = F.col("s_suppkey")
    nations = read("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    s = read("supplier").join(F.broadcast(nations), "s_nationkey")
    rows = s.select(
        F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("corp"), F.when(k % 11 == 0, "  ").when(k % 2 == 0, F.concat("n_name", F.lit(" Ltd."))).otherwise(F.concat(F.lit("T"), (k % 9).cast("string"))).alias("inv_prm"), F.lit(" 경영 ").alias("invstmnt_purps"),
        F.when(k % 3 == 1, "50").alias("end_rate"), F.when(k % 3 == 2, "49.9%").alias("start_rate"), F.when(k % 5 == 0, F.concat(F.lit("("), k.cast("string"), F.lit(")"))).alias("end_amount"), F.lit("77").alias("start_amount"), F.lit("-").alias("end_quantity"), F.lit("5").alias("start_quantity"), F.lit("2020.1.5").alias("frst_acqs_de"), F.lit("").alias("rcept_no"),
    )
    made, edges = M.investments(rows, nations.select(F.col("n_name").alias("name"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("code")))
    return edges.join(made.select(F.col("code").alias("target"), F.col("canonical").alias("made")), "target", "left").select("investor", "target", "stake", "subsidiary", "amount", "first_acquired", "made")


_CORP = "CASE WHEN v.vec_id % 101 = 7 THEN 'few' ELSE concat('L', CAST(v.label AS VARCHAR)) END"
_ASKS = "(SELECT vec_id AS qid, vec_id // 50 % 2 = 0 AS balanced, embedding, unnest(CASE vec_id // 50 % 4 WHEN 0 THEN ['L0', 'few'] WHEN 1 THEN ['L1', 'L2', 'L9'] WHEN 2 THEN ['none', 'L3', 'few'] ELSE ['L5'] END) AS corp, unnest(range(len(CASE vec_id // 50 % 4 WHEN 0 THEN ['L0', 'few'] WHEN 1 THEN ['L1', 'L2', 'L9'] WHEN 2 THEN ['none', 'L3', 'few'] ELSE ['L5'] END))) AS place, len(CASE vec_id // 50 % 4 WHEN 0 THEN ['L0', 'few'] WHEN 1 THEN ['L1', 'L2', 'L9'] WHEN 2 THEN ['none', 'L3', 'few'] ELSE ['L5'] END) AS n FROM vectors WHERE vec_id % 50 = 0)"


@query(f"""WITH s AS (SELECT q.qid, q.corp, q.place, q.n, q.balanced, v.vec_id, {_COS} AS score FROM {_ASKS} q JOIN vectors v ON q.corp = {_CORP} WHERE v.vec_id % 3 <> 1 AND v.vec_id % 4 IN (0, 1, 2)),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, corp ORDER BY round(score, 9) DESC, vec_id) AS own FROM s) WHERE own <= 15), f AS (SELECT *, balanced AND own <= greatest(1, 10 // n) AS first FROM r), h AS (SELECT *, count(*) FILTER (WHERE first) OVER (PARTITION BY qid) AS held FROM f),
a AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY first DESC, CASE WHEN first THEN place END, CASE WHEN first THEN own END, round(score, 9) DESC, place, vec_id) AS spot FROM h)
SELECT qid, CAST(spot AS INT) AS rank, corp, vec_id, round(score, 6) AS score FROM a WHERE CASE WHEN balanced THEN first OR (held < 10 AND spot <= 15) ELSE spot <= 15 END""")
def ret5_fil20_company_search(read):
    """Payload: status ready is vec_id mod 3 not 1; kinds 0 to 2 of 4. "few" has a handful of vectors, "none" has none; one company is named twice."""
    k = F.col("vec_id")
    vectors = read("vectors").select(k, "embedding", F.when(k % 101 == 7, "few").otherwise(F.concat(F.lit("L"), F.col("label").cast("string"))).alias("corp"), F.when(k % 3 == 1, "pending").otherwise("ready").alias("status"), (k % 4).alias("kind"))
    q = F.floor(k / 50) % 4
    names = lambda *x: F.array(*[F.lit(c) for c in x])
    corps = F.when(q == 0, names("L0", "few", "L0")).when(q == 1, names("L1", "L2", "L9")).when(q == 2, names("none", "L3", "few")).otherwise(names("L5"))
    asked = read("vectors").where("vec_id % 50 = 0").select(k.alias("qid"), F.col("embedding").alias("query"), corps.alias("corps"), (F.floor(k / 50) % 2 == 0).alias("balanced"))
    return Q.company_search(asked, vectors, 10, 15, Q.payload_filter({"status": "ready", "kind": [0, 1, 2], "year": None, "section": []})).withColumn("score", F.round("score", 6))


_MASKED = "list_transform(embedding, lambda x, i: CASE WHEN i <= CASE vec_id // 25 % 5 WHEN 0 THEN 64 WHEN 1 THEN 40 WHEN 2 THEN 32 WHEN 3 THEN 24 ELSE 8 END THEN x ELSE 0 END)"


@query(f"""WITH q AS (SELECT vec_id AS qid, {_MASKED} AS embedding, CASE WHEN vec_id % 3 = 0 THEN concat('Comp ', CAST(vec_id AS VARCHAR), ' Inc.') ELSE concat('Other ', CAST(vec_id AS VARCHAR)) END AS surface, CASE WHEN vec_id % 7 = 6 THEN 'Person' ELSE 'Organization' END AS kind FROM vectors WHERE vec_id % 25 = 0),
s AS (SELECT q.qid, v.vec_id, {_COS} AS score FROM q CROSS JOIN vectors v), d AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s), t AS (SELECT q.*, a.vec_id AS top, a.score AS vs, b.score AS vs2 FROM q JOIN d a ON a.qid = q.qid AND a.rank = 1 JOIN d b ON b.qid = q.qid AND b.rank = 2),
g AS (SELECT *, CASE WHEN qid % 4 = 1 THEN 'alias_canonical' WHEN kind <> 'Organization' THEN 'unlinked' WHEN vs >= 0.75 AND vs - vs2 >= 0.05 THEN 'vector_strict' WHEN (surface LIKE 'Comp%' AND top = qid AND vs >= 0.55) OR (vs >= 0.7 AND vs - vs2 >= 0.03) THEN 'vector_loose' ELSE 'unlinked' END AS stage FROM t)
SELECT surface, CASE stage WHEN 'alias_canonical' THEN 'A' WHEN 'unlinked' THEN concat('X', upper(md5(concat('xorg|', replace(surface, ' Inc.', '')))[1:7])) ELSE concat('V', CAST(top AS VARCHAR)) END AS entity, stage FROM g""")
def ent2_jon24_linked(read):
    """Surfaces whose vectors are another's with some dimensions left out, so that scores fall on all sides of the bounds."""
    k = F.col("vec_id")
    keep = F.when(F.floor(k / 25) % 5 == 0, 64).when(F.floor(k / 25) % 5 == 1, 40).when(F.floor(k / 25) % 5 == 2, 32).when(F.floor(k / 25) % 5 == 3, 24).otherwise(8)
    masked = F.transform("embedding", lambda x, i: F.when(i < keep, x).otherwise(F.lit(0.0).cast("float")))
    surface = F.when(k % 3 == 0, F.concat(F.lit("Comp "), k.cast("string"), F.lit(" Inc."))).otherwise(F.concat(F.lit("Other "), k.cast("string")))
    mentions = read("vectors").where("vec_id % 25 = 0").select(k.alias("qid"), surface.alias("surface"), masked.alias("query"), F.when(k % 7 == 6, "Person").otherwise("Organization").alias("kind"))
    names = read("vectors").select("vec_id", F.concat(F.lit("V"), k.cast("string")).alias("entity"), F.concat(F.lit("Comp "), k.cast("string")).alias("name"), "embedding")
    aliases = mentions.where("qid % 4 = 1").select("surface", F.lit("A").alias("entity"), F.lit(False).alias("ambiguous"))
    return Q.link(mentions.select("surface", "kind"), aliases, Q.near_entities(mentions, names))
