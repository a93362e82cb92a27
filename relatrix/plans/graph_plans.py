"""Queries over the property graph (rows FIL, JON, GRA, ENT, DIA)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import retrieval as R
from ..operators import tables as T
from .registry import query

_VISIBLE = """v AS (SELECT src, dst, type, CAST(evidence_count AS DOUBLE) AS weight, 'news' AS source FROM edges WHERE extracted_by IS NOT NULL AND coalesce(evidence_count, 1) >= 2
UNION ALL SELECT src, dst, type, coalesce(stake, 1.0), 'filing' FROM edges WHERE extracted_by IS NULL AND NOT (type = 'INVESTS_IN' AND coalesce(stake, 0) <= 0))"""
_AROUND = "a AS (SELECT src AS centre, dst AS neighbour, type, weight, source FROM v UNION ALL SELECT dst, src, type, weight, source FROM v WHERE src <> dst)"
_GROUP = "CASE type WHEN 'COMPETES_WITH' THEN 'compete' WHEN 'SUPPLIES' THEN 'supply' WHEN 'INVESTS_IN' THEN 'invest' END"


def _nations(read):
    return read("nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("centre"))


@query(f"WITH {_VISIBLE} SELECT src, dst, type, source, round(weight, 6) AS weight FROM v")
def fil1_fil3_visible(read):
    return G.visible_edges(read("edges")).select("src", "dst", "type", "source", F.round("weight", 6).alias("weight"))


@query(f"""WITH {_VISIBLE}, {_AROUND}, s AS (SELECT concat('N', CAST(n_nationkey AS VARCHAR)) AS centre FROM nation), x AS (SELECT a.*, {_GROUP} AS grp FROM a JOIN s USING (centre)),
h AS (SELECT *, grp = 'invest' AND NOT regexp_matches(neighbour, '[13579]$') AND regexp_matches(neighbour, '^[A-Za-z][A-Za-z0-9-]{{1,7}}$') AS hidden FROM x WHERE grp IS NOT NULL AND neighbour <> centre),
k AS (SELECT centre, neighbour, grp, type, source, weight, row_number() OVER (PARTITION BY centre, grp ORDER BY weight DESC, neighbour, type, source) AS rank FROM h WHERE NOT hidden), sh AS (SELECT * FROM k WHERE rank <= 12),
m AS (SELECT centre, count(*) AS w FROM (SELECT DISTINCT centre, neighbour FROM h WHERE hidden EXCEPT SELECT centre, neighbour FROM sh) GROUP BY centre)
SELECT centre, neighbour, grp, type, source, round(weight, 6) AS weight, CAST(rank AS INT) AS rank FROM sh UNION ALL SELECT centre, concat('__meta:govern:', centre), 'govern', 'META', 'meta', CAST(w AS DOUBLE), 1 FROM m""")
def gra1_ego_graph(read):
    known = read("supplier").where("s_suppkey % 2 = 1").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("name"))
    return G.ego_graph(read("edges"), _nations(read), known).select("centre", "neighbour", "grp", "type", "source", F.round("weight", 6).alias("weight"), F.col("rank").cast("int").alias("rank"))


@query("""WITH a AS (SELECT src AS centre, dst AS neighbour, evidence_count, stake FROM edges WHERE type IN ('INVESTS_IN', 'SUPPLIES') UNION ALL SELECT dst, src, evidence_count, stake FROM edges WHERE type IN ('INVESTS_IN', 'SUPPLIES') AND src <> dst),
s AS (SELECT concat('N', CAST(n_nationkey AS VARCHAR)) AS centre FROM nation), b AS (SELECT a.centre, neighbour, max(CASE WHEN coalesce(CAST(evidence_count AS DOUBLE), stake, 1.0) = 0 THEN 1.0 ELSE coalesce(CAST(evidence_count AS DOUBLE), stake, 1.0) END) AS weight FROM a JOIN s ON a.centre = s.centre GROUP BY a.centre, neighbour),
r AS (SELECT *, row_number() OVER (PARTITION BY centre ORDER BY regexp_matches(neighbour, '신기술투자조합|SVIC|투자조합|펀드'), weight DESC, neighbour) AS rank FROM b)
SELECT centre, neighbour, weight, CAST(rank AS INT) AS rank FROM r WHERE rank <= 30 UNION ALL SELECT centre, 'etc', CAST(count(*) AS DOUBLE), 31 FROM r WHERE rank > 30 GROUP BY centre""")
def gra2_meta_members(read):
    return G.meta_members(read("edges"), _nations(read), ["INVESTS_IN", "SUPPLIES"]).select("centre", "neighbour", "weight", F.col("rank").cast("int").alias("rank"))


@query(f"""WITH a AS (SELECT src AS centre, dst AS neighbour, type, evidence_count, extracted_by FROM edges UNION ALL SELECT dst, src, type, evidence_count, extracted_by FROM edges WHERE src <> dst), s AS (SELECT concat('N', CAST(n_nationkey AS VARCHAR)) AS centre FROM nation)
SELECT centre, coalesce({_GROUP}, 'etc') AS grp, type, neighbour, max(coalesce(evidence_count, 1)) AS evidence, bool_or(extracted_by IS NOT NULL) AS news FROM a JOIN s USING (centre) GROUP BY centre, type, neighbour""")
def agg11_merged_relations(read):
    return G.merged_relations(read("edges"), _nations(read))


@query("""WITH d AS (SELECT DISTINCT src, dst, type, doc_id, day FROM facts), r AS (SELECT *, row_number() OVER (PARTITION BY src, dst, type ORDER BY day DESC NULLS LAST, doc_id) AS rn FROM d),
l AS (SELECT src, dst, type, array_to_string(list(doc_id ORDER BY rn), ',') AS newest FROM r WHERE rn <= 50 GROUP BY src, dst, type)
SELECT f.src, f.dst, f.type, count(DISTINCT f.doc_id) AS docs, min(f.day) AS first_day, max(f.day) AS last_day, round(max(f.stake), 6) AS stake, max_by(f.doc_id, {'s': coalesce(f.stake, -1), 'd': -f.doc_id}) AS stake_doc, bool_or(f.extracted_by IS NOT NULL) AS news, any_value(l.newest) AS newest
FROM facts f JOIN l ON f.src = l.src AND f.dst = l.dst AND f.type = l.type GROUP BY f.src, f.dst, f.type""")
def gra4_drill_down(read):
    return G.drill_down(read("facts")).withColumn("stake", F.round("stake", 6)).withColumn("newest", F.array_join("newest", ","))


@query("SELECT node, count(*) AS degree, CAST(sum(evidence_count) AS BIGINT) AS weight FROM (SELECT src AS node, evidence_count FROM edges WHERE src <> dst UNION ALL SELECT dst, evidence_count FROM edges WHERE src <> dst) GROUP BY node")
def agg14_degrees(read):
    return G.degrees(read("edges"))


@query("SELECT src, dst, type, evidence_count, first_day FROM edges WHERE coalesce(evidence_count, 1) >= 2 AND first_day >= DATE '2001-08-01' - 365")
def fil8_new_items(read):
    return G.new_items(read("edges"), F.lit("2001-08-01").cast("date"), 365).select("src", "dst", "type", "evidence_count", "first_day")


@query("""WITH n AS (SELECT concat('P', CAST(p_partkey AS VARCHAR)) AS node, concat(p_brand, CASE WHEN p_partkey % 2 = 0 THEN ' Inc' ELSE '' END) AS name, lower(regexp_replace(p_brand, '[^0-9A-Za-z_]+', '', 'g')) AS key FROM part),
b AS (SELECT key, node AS new FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY length(name) DESC, node) AS rn FROM n) WHERE rn = 1) SELECT node AS old, new FROM n JOIN b USING (key) WHERE node <> new""")
def ent6_survivors(read):
    nodes = read("part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("node"), F.concat("p_brand", F.when(F.col("p_partkey") % 2 == 0, " Inc").otherwise("")).alias("name"))
    return G.survivors(nodes)


@query("""WITH m AS (SELECT concat('S', CAST(s_suppkey AS VARCHAR)) AS old, concat('S', CAST(s_suppkey % 10 AS VARCHAR)) AS new FROM supplier WHERE s_suppkey >= 10),
e AS (SELECT coalesce(a.new, f.src) AS src, coalesce(b.new, f.dst) AS dst, f.type, f.doc_id FROM facts f LEFT JOIN m a ON f.src = a.old LEFT JOIN m b ON f.dst = b.old)
SELECT src, dst, type, count(DISTINCT doc_id) AS evidence_count FROM e WHERE src <> dst GROUP BY src, dst, type""")
def snk19_ent6_rewire(read):
    mapping = read("supplier").where("s_suppkey >= 10").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("old"), F.concat(F.lit("S"), (F.col("s_suppkey") % 10).cast("string")).alias("new"))
    return G.rewire(read("facts"), mapping)


@query("SELECT dst AS src, src AS dst, 'IS_SUBSIDIARY_OF' AS type, round(stake, 6) AS stake FROM edges WHERE type = 'INVESTS_IN' AND stake >= 8")
def ent13_subsidiaries(read):
    return G.subsidiaries(read("edges"), 8.0).withColumn("stake", F.round("stake", 6))


@query("SELECT tier, count(*) AS n FROM (SELECT CASE WHEN type = 'COMPETES_WITH' AND stake > 8 THEN 'event' WHEN evidence_count >= 2 THEN 'relation' WHEN first_day < last_day OR stake > 5 THEN 'statement' ELSE 'edge' END AS tier FROM edges) GROUP BY tier")
def ent10_tiers(read):
    kind = G.tier(F.col("first_day") < F.col("last_day"), F.col("stake") > 5, F.col("evidence_count"), F.lit(False), (F.col("type") == "COMPETES_WITH") & (F.col("stake") > 8))
    return read("edges").groupBy(kind.alias("tier")).agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT DISTINCT p_brand AS surface FROM part UNION SELECT DISTINCT concat(p_brand, ' Inc') FROM part UNION SELECT n_name FROM nation), al AS (SELECT DISTINCT p_brand AS surface, concat('E:', p_brand) AS entity FROM part)
SELECT m.surface, coalesce(al.entity, concat('X', upper(md5(concat('xorg|', trim(replace(m.surface, ' Inc', ''))))[1:7]))) AS entity, CASE WHEN al.entity IS NOT NULL THEN 'alias_canonical' ELSE 'unlinked' END AS stage
FROM m LEFT JOIN al ON trim(replace(m.surface, ' Inc', '')) = al.surface""")
def ent1_ent4_link(read):
    brands = read("part").select(F.col("p_brand").alias("surface")).distinct()
    mentions = brands.union(brands.select(F.concat("surface", F.lit(" Inc")))).union(read("nation").select("n_name")).distinct()
    aliases = brands.select("surface", F.concat(F.lit("E:"), "surface").alias("entity"), F.lit(False).alias("ambiguous"))
    return R.link(mentions, aliases)


@query("SELECT c.c_custkey AS id, c.c_name AS name, r.r_name AS region, count(o.o_orderkey) AS orders FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY ALL")
def jon4_jon12_left_outer(read):
    c = read("customer").join(F.broadcast(read("nation")), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(F.broadcast(read("region")), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    orders = read("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    return c.join(orders, "c_custkey", "left").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("r_name").alias("region"), F.coalesce("orders", F.lit(0)).alias("orders"))


@query("SELECT corp, a.label AS a, b.label AS b, count(*) AS n FROM (SELECT DISTINCT corp, day, label FROM docs) a JOIN (SELECT DISTINCT corp, day, label FROM docs) b USING (corp, day) WHERE a.label < b.label GROUP BY ALL")
def jon20_pairs_in_row(read):
    sets = read("docs").groupBy("corp", "day").agg(F.collect_set("label").alias("a"))
    rows = sets.select("corp", "day", F.explode("a").alias("x"), "a").select("corp", "x", F.explode("a").alias("y")).where("x < y")
    return rows.groupBy("corp", F.col("x").alias("a"), F.col("y").alias("b")).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS orphans,
(SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY o_orderkey HAVING count(*) > 1)) AS doubles, (SELECT count(*) FROM lineitem) AS li, (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)) AS linked, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS idle)
SELECT 'c01_nodes' AS name, CASE WHEN customers > 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM s UNION ALL SELECT 'c05_orphans', CASE WHEN orphans = 0 THEN 'PASS' ELSE 'FAIL' END FROM s UNION ALL SELECT 'c07_duplicates', CASE WHEN doubles = 0 THEN 'PASS' ELSE 'FAIL' END FROM s
UNION ALL SELECT 'c09_receipts', CASE WHEN linked >= 0.95 * li THEN 'PASS' ELSE 'FAIL' END FROM s UNION ALL SELECT 'c03_zero_metrics', CASE WHEN idle = 0 THEN 'PASS' ELSE 'WARN' END FROM s""")
def dia_checks(read):
    c, o, li = read("customer"), read("orders"), read("lineitem")
    one = lambda df, name: df.agg(F.count("*").alias(name))
    sums = one(c, "customers").crossJoin(one(o, "orders")).crossJoin(one(o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_anti"), "orphans"))
    sums = sums.crossJoin(one(o.groupBy("o_orderkey").count().where("count > 1"), "doubles")).crossJoin(one(li, "li")).crossJoin(one(li.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi"), "linked"))
    sums = sums.crossJoin(one(c.join(o, F.col("o_custkey") == F.col("c_custkey"), "left_anti"), "idle"))
    v = F.col
    return T.checks([("c01_nodes", v("customers") > 0, "FAIL"), ("c05_orphans", v("orphans") == 0, "FAIL"), ("c07_duplicates", v("doubles") == 0, "FAIL"), ("c09_receipts", v("linked") >= 0.95 * v("li"), "FAIL"), ("c03_zero_metrics", v("idle") == 0, "WARN")])(sums)


@query("SELECT count(*) AS n, count(*) FILTER (WHERE abs(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) - 1) <= 0.01) AS unit, count(*) FILTER (WHERE len(embedding) = 64) AS right_size FROM vectors")
def dia22_norms(read):
    from ..functions.scalars import norm

    return read("vectors").agg(F.count("*").alias("n"), F.count_if(F.abs(norm(F.col("embedding")) - 1) <= 0.01).alias("unit"), F.count_if(F.size("embedding") == 64).alias("right_size"))
