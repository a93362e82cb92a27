"""Queries over extracted records: validation, candidates, resolution and clusters. Records are made from documents' own words."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records as R
from ..operators import extraction as E
from .registry import query

#: Each document gives five entity records and four relation records from its first four words.
_W = "list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda x: x <> '')"
_WORDS = "filter(split(replace(text, '\\n', ' '), ' '), x -> x <> '')"
_KINDS = ("Organization", "Person", "Product", "Organization", "Planet")


def _entities(read):
    w = read("chunks").select(F.col("doc_id").alias("chunk"), "text", F.expr(_WORDS).alias("w")).where("size(w) >= 4")
    rows = F.array(*[F.struct(F.lit(k).alias("type"), F.concat(F.lit(" "), F.element_at("w", min(i + 1, 4))).alias("surface"), (F.element_at("w", 1) if i != 3 else F.concat(F.element_at("w", 1), F.lit("#no"))).alias("span"), F.lit(0.9 if i != 2 else 0.4).alias("confidence")) for i, k in enumerate(_KINDS)])
    return w.select("chunk", "text", F.explode(rows).alias("r")).select("chunk", "text", "r.*")


@query(f"WITH w AS (SELECT doc_id, text, {_W} AS w FROM chunks) SELECT doc_id AS chunk, 'Organization' AS type, w[1] AS surface FROM w WHERE len(w) >= 4 UNION ALL SELECT doc_id, 'Person', w[2] FROM w WHERE len(w) >= 4")
def fil13_valid_entities(read):
    return E.valid_entities(_entities(read)).select("chunk", "type", "surface")


@query(f"""WITH w AS (SELECT doc_id, text, {_W} AS w FROM chunks), r AS (SELECT doc_id, w, unnest([0, 1, 2, 3, 4]) AS pos FROM w WHERE len(w) >= 4)
SELECT doc_id AS chunk, w[1] AS subject, 'SUPPLIES' AS predicate, w[2] AS object, min(pos) AS pos FROM r WHERE pos IN (1, 3) GROUP BY ALL UNION ALL SELECT doc_id, w[2], 'SUPPLIES', w[1], min(pos) FROM r WHERE pos = 4 AND w[1] <> w[2] GROUP BY ALL""")
def fil13_valid_relations(read):
    """pos 0: unknown predicate; 1 and 3: the same triple; 2: an end that is no entity; 4: the reverse."""
    words = read("chunks").select(F.col("doc_id").alias("chunk"), "text", F.expr(_WORDS).alias("w")).where("size(w) >= 4")
    end = lambda i: F.element_at("w", i)
    made = [("LIKES", end(1), end(2)), ("SUPPLIES", end(1), end(2)), ("SUPPLIES", end(1), F.concat(end(3), F.lit("#no"))), ("SUPPLIES", end(1), end(2)), ("SUPPLIES", end(2), end(1))]
    rows = F.array(*[F.struct(F.lit(i).alias("pos"), a.alias("subject"), F.lit("Organization").alias("subject_type"), F.lit(p).alias("predicate"), b.alias("object"), F.lit("Person").alias("object_type"), end(1).alias("span"), F.lit(0.5).alias("confidence")) for i, (p, a, b) in enumerate(made)])
    rows = words.select("chunk", "text", F.explode(rows).alias("r")).select("chunk", "text", "r.*")
    return E.valid_relations(rows, E.valid_entities(_entities(read)), ("SUPPLIES",)).select("chunk", "subject", "predicate", "object", "pos")


@query("SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING NOT (count(*) = 1 AND min(l_returnflag) = 'A' AND max(l_linenumber) < 2)")
def fil22_default_only(read):
    kinds = F.transform(F.array_sort(F.collect_list("l_returnflag")), lambda x: F.when(x == "A", "Organization").otherwise("Person"))
    rows = read("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(kinds.alias("kinds"), F.count("*").alias("n"), F.max("l_linenumber").alias("top"))
    return rows.where(~R.default_only(F.col("kinds"), F.col("top") - 1, F.lit(0))).select("id", "n")


@query("""WITH h AS (SELECT DISTINCT l_orderkey AS chunk, CASE l_suppkey % 3 WHEN 0 THEN 'Organization' WHEN 1 THEN 'Product' ELSE 'Technology' END AS etype, concat('E', CAST(l_suppkey AS VARCHAR)) AS entity FROM lineitem)
SELECT o.chunk, o.entity AS org, CASE p.etype WHEN 'Product' THEN 'produces' ELSE 'uses_tech' END AS kind, p.entity AS other FROM h o JOIN h p ON o.chunk = p.chunk WHERE o.etype = 'Organization' AND p.etype <> 'Organization'""")
def txt3_candidates(read):
    k = F.col("l_suppkey") % 3
    hits = read("lineitem").select(F.col("l_orderkey").alias("chunk"), F.when(k == 0, "Organization").when(k == 1, "Product").otherwise("Technology").alias("etype"), F.concat(F.lit("E"), F.col("l_suppkey").cast("string")).alias("entity"))
    return E.deterministic(hits)


@query("SELECT DISTINCT l_orderkey AS doc_id, concat('S', CAST(l_suppkey AS VARCHAR)) AS entity FROM lineitem WHERE l_suppkey % 2 = 0")
def jon25_mentions(read):
    records = read("lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_set(F.concat(F.lit("name "), F.col("l_suppkey").cast("string"))).alias("surfaces"))
    entities = read("supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("name "), F.col("s_suppkey").cast("string")).alias("surface"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("entity"))
    return E.mentions(records, entities)


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN concat('N', CAST(c_nationkey AS VARCHAR)) WHEN c_custkey % 3 = 1 THEN concat('R', CAST(c_nationkey AS VARCHAR))
ELSE concat('X', upper(md5(concat('xorg|', c_name, '|', CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '999-1' END))[1:7])) END AS code, CASE c_custkey % 3 WHEN 0 THEN 'number' WHEN 1 THEN 'name' ELSE 'made' END AS found_by FROM customer""")
def jon17_resolved(read):
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    number = F.when(k % 3 == 0, F.concat(F.lit("110111-"), n)).when(k % 2 == 1, "999-1")
    name = F.when(k % 3 == 1, F.concat(F.lit("㈜"), F.col("n_name"))).when(k % 3 == 0, F.col("n_name")).otherwise(F.col("c_name"))
    rows = read("customer").join(F.broadcast(read("nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(k.alias("id"), name.alias("name"), number.alias("number"))
    at = F.col("n_nationkey").cast("string")
    by_number = read("nation").select(F.concat(F.lit("110111-"), at).alias("number"), F.concat(F.lit("N"), at).alias("code"))
    by_name = read("nation").select(F.concat(F.col("n_name"), F.lit(" Inc.")).alias("name"), F.concat(F.lit("R"), at).alias("code"))
    return E.resolved(rows, by_number, by_name).select("id", "code", "found_by")


@query("""SELECT concat('news:', CAST(s_suppkey AS VARCHAR)) AS node, concat('C', CAST(s_suppkey % 7 AS VARCHAR)) AS code FROM supplier WHERE s_suppkey % 7 NOT IN (5, 6)
AND s_suppkey % 4 <> 3""")
def ent5_absorbed(read):
    """By kind mod 4: the name in canonical form, the canonical, the raw name, no key. Companies 5 and 6 do not exist."""
    k = F.col("s_suppkey")
    of = (k % 7).cast("string")
    name = F.when(k % 4 == 0, F.concat(F.lit("㈜ Comp "), of)).when(k % 4 == 1, "other").when(k % 4 == 2, F.concat(F.lit("Raw ㈜"), of)).otherwise("nobody")
    canonical = F.when(k % 4 == 1, F.concat(F.lit("Comp "), of, F.lit(" Inc.")))
    nodes = read("supplier").select(F.concat(F.lit("news:"), k.cast("string")).alias("node"), name.alias("name"), canonical.alias("canonical"))
    codes = read("supplier").select((k % 7).cast("string").alias("n")).distinct()
    aliases = codes.select(F.concat(F.lit("Comp "), "n").alias("alias"), F.concat(F.lit("C"), "n").alias("code")).union(codes.select(F.concat(F.lit("Raw ㈜"), "n"), F.concat(F.lit("C"), "n")))
    return E.absorbed(nodes, aliases, codes.where("n < '5'").select(F.concat(F.lit("C"), "n").alias("code")))


@query("""SELECT l_orderkey AS id, l_linenumber AS line, concat('P', CAST(l_partkey % 50 AS VARCHAR)) AS subject, concat('part ', CAST(l_partkey AS VARCHAR)) AS subject_surface, CASE l_returnflag WHEN 'R' THEN 'return' WHEN 'A' THEN 'return' ELSE l_returnflag END AS predicate,
l_returnflag AS predicate_surface, CASE WHEN l_suppkey % 2 = 0 THEN 'P0' ELSE concat('S', CAST(l_suppkey AS VARCHAR)) END AS object, CASE WHEN l_suppkey % 2 = 0 THEN 'P0' ELSE concat('S', CAST(l_suppkey AS VARCHAR)) END AS object_surface FROM lineitem""")
def ent8_clustered(read):
    other = F.when(F.col("l_suppkey") % 2 == 0, "P0").otherwise(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")))
    triples = read("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("subject"), F.col("l_returnflag").alias("predicate"), other.alias("object"))
    forms = read("part").select(F.concat(F.lit("P"), (F.col("p_partkey") % 50).cast("string")).alias("canonical"), F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("surface"))
    returns = read("lineitem").where("l_returnflag in ('R', 'A')").select(F.lit("return").alias("canonical"), F.col("l_returnflag").alias("surface")).distinct()
    return E.clustered(triples, forms, returns)
