"""Diagnostic queries (rows DIA): scopes are five slices of the suppliers, and each check meets good and bad ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diagnostics as D
from .registry import BINDINGS, query

BINDINGS["companies"] = """SELECT s_suppkey % 5 AS scope, CASE WHEN s_suppkey % 5 = 4 AND s_suppkey % 2 = 0 THEN concat('0000000', CAST(s_suppkey % 10 AS STRING)) ELSE concat('S', CAST(s_suppkey AS STRING)) END AS code, CASE WHEN s_suppkey % 10 <> 1 THEN s_name END AS name, 'T' AS ticker,
CASE WHEN s_suppkey % 10 <> 2 THEN 'R' END AS registration, 'B' AS business, s_suppkey AS seq FROM {supplier}"""
BINDINGS["wanted"] = "SELECT s_suppkey % 5 AS scope, concat('S', CAST(s_suppkey AS STRING)) AS code FROM {supplier}"
BINDINGS["facts_of"] = """SELECT l_suppkey % 5 AS scope, concat('S', CAST(CASE WHEN l_suppkey % 10 = 7 THEN l_suppkey + 5 ELSE l_suppkey END AS STRING)) AS code, CASE WHEN l_suppkey % 5 = 1 THEN l_orderkey * 10 + l_linenumber % 2 ELSE l_orderkey * 10 + l_linenumber END AS metric,
CAST(extract(year FROM l_shipdate) AS INT) AS year, CASE l_linenumber % 4 WHEN 0 THEN '11011' WHEN 1 THEN '11012' WHEN 2 THEN '11013' ELSE '11014' END AS report, CASE WHEN l_suppkey % 5 = 2 AND l_returnflag = 'R' THEN 'XFS' WHEN l_linestatus = 'F' THEN 'CFS' ELSE 'OFS' END AS fs,
CASE WHEN l_suppkey % 5 = 3 AND l_quantity > 40 THEN NULL ELSE l_orderkey END AS receipt, CASE WHEN l_suppkey % 5 = 0 THEN CAST(l_linenumber AS STRING) ELSE l_linestatus END AS run,
CASE WHEN l_suppkey % 5 = 4 AND l_discount > 0.09 THEN 'old' WHEN l_discount > 0.05 THEN NULL WHEN l_suppkey % 5 = 0 THEN CAST(l_linenumber AS STRING) ELSE l_linestatus END AS edge_run FROM {lineitem}"""


def _cells(read):
    years = F.array(*[F.lit(y) for y in (1996, 1997, 1999, 2003, 2004)])
    return read("region").limit(1).select(F.explode(years).alias("year")).select("year", F.explode(F.array(F.lit("11011"), F.lit("11013"))).alias("report"))


@query("""WITH s AS (SELECT w.scope, count(*) FILTER (WHERE c.code IS NULL) AS m, count(*) AS t FROM wanted w LEFT JOIN (SELECT DISTINCT code FROM companies) c USING (code) GROUP BY w.scope) SELECT scope, 'C-01' AS "check", CASE WHEN m > 0 THEN 'FAIL' ELSE 'PASS' END AS status, m AS bad, t AS total FROM s""")
def dia1_wanted_exist(read):
    return D.wanted_exist(read("wanted"), read("companies"))


@query("""WITH s AS (SELECT scope, count(*) FILTER (WHERE name IS NULL) AS m, count(*) FILTER (WHERE registration IS NULL) AS w, count(*) AS t FROM companies GROUP BY scope) SELECT scope, 'C-02' AS "check", CASE WHEN m > 0 THEN 'FAIL' WHEN w > 0 THEN 'WARN' ELSE 'PASS' END AS status, CASE WHEN m > 0 THEN m ELSE w END AS bad, t AS total FROM s""")
def dia2_required_attributes(read):
    return D.required_attributes(read("companies"))


@query("""WITH n AS (SELECT w.scope, w.code, count(f.code) AS n FROM wanted w LEFT JOIN facts_of f USING (code) GROUP BY w.scope, w.code), o AS (SELECT *, avg(n) OVER (PARTITION BY scope) AS mean FROM n),
s AS (SELECT scope, count(*) FILTER (WHERE n = 0) AS z, count(*) FILTER (WHERE mean > 0 AND (n < mean * 0.3 OR n > mean * 3)) AS f, count(*) AS t FROM o GROUP BY scope) SELECT scope, 'C-03' AS "check", CASE WHEN z > 0 THEN 'FAIL' WHEN f > 0 THEN 'WARN' ELSE 'PASS' END AS status, CASE WHEN z > 0 THEN z ELSE f END AS bad, t AS total FROM s""")
def dia3_metrics_per_company(read):
    return D.metrics_per_company(read("wanted"), read("facts_of"))


@query("""WITH g AS (SELECT code, count(DISTINCT concat(CAST(year AS VARCHAR), report)) AS n FROM facts_of WHERE year IN (1996, 1997, 1999, 2003, 2004) AND report IN ('11011', '11013') GROUP BY code), s AS (SELECT w.scope, sum(coalesce(g.n, 0)) AS n, count(*) * 10 AS t FROM wanted w LEFT JOIN g USING (code) GROUP BY w.scope)
SELECT scope, 'C-04' AS "check", CASE WHEN n / t < 0.5 THEN 'FAIL' WHEN n / t < 0.8 THEN 'WARN' ELSE 'PASS' END AS status, CAST(t - n AS BIGINT) AS bad, t AS total FROM s""")
def dia4_coverage(read):
    return D.coverage(read("wanted"), read("facts_of"), _cells(read))


@query("""WITH s AS (SELECT f.scope, count(*) FILTER (WHERE c.code IS NULL) AS m, count(*) AS t FROM facts_of f LEFT JOIN (SELECT DISTINCT code FROM companies) c USING (code) GROUP BY f.scope) SELECT scope, 'C-05' AS "check", CASE WHEN m > 0 THEN 'FAIL' ELSE 'PASS' END AS status, m AS bad, t AS total FROM s""")
def dia5_orphans(read):
    return D.orphans(read("facts_of"), read("companies"))


@query("""WITH k AS (SELECT DISTINCT scope, fs, report FROM facts_of), s AS (SELECT scope, count(*) FILTER (WHERE fs NOT IN ('CFS', 'OFS')) AS m, count(*) AS t FROM k GROUP BY scope) SELECT scope, 'C-06' AS "check", CASE WHEN m > 0 THEN 'WARN' ELSE 'PASS' END AS status, m AS bad, t AS total FROM s""")
def dia6_expected_values(read):
    return D.expected_values(read("facts_of"), {"fs": D.STATEMENT_SCOPES, "report": D.REPORT_CODES})


@query("""WITH k AS (SELECT scope, metric, count(*) AS n FROM facts_of GROUP BY scope, metric), s AS (SELECT scope, count(*) FILTER (WHERE n > 1) AS m, count(*) AS t FROM k GROUP BY scope) SELECT scope, 'C-07' AS "check", CASE WHEN m > 0 THEN 'FAIL' ELSE 'PASS' END AS status, m AS bad, t AS total FROM s""")
def dia7_unique_ids(read):
    return D.unique_ids(read("facts_of"))


@query("""WITH s AS (SELECT scope, count(*) FILTER (WHERE edge_run <> run) AS m, count(*) AS t, count(DISTINCT run) AS r FROM facts_of GROUP BY scope) SELECT scope, 'C-08' AS "check", CASE WHEN m > 0 THEN 'FAIL' ELSE 'PASS' END AS status, m AS bad, t AS total FROM s UNION ALL SELECT scope, 'C-15', CASE WHEN r > 3 THEN 'WARN' ELSE 'PASS' END, greatest(0, r - 3), r FROM s""")
def dia8_dia15_runs(read):
    return D.same_run(read("facts_of")).unionByName(D.runs(read("facts_of")))


@query("""WITH s AS (SELECT f.scope, count(f.receipt) AS r, count(o.o_orderkey) AS e, count(*) AS t FROM facts_of f LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') o ON f.receipt = o.o_orderkey GROUP BY f.scope) SELECT scope, 'C-09' AS "check", CASE WHEN r / t < 0.95 THEN 'FAIL' ELSE 'PASS' END AS status, t - e AS bad, t AS total FROM s""")
def dia9_jon14_provenance(read):
    return D.provenance(read("facts_of"), read("orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("receipt")))


@query("""WITH e AS (SELECT DISTINCT code FROM companies WHERE seq % 10 <> 8), g AS (SELECT DISTINCT code FROM companies WHERE seq % 10 < 7), x AS (SELECT w.scope, count(*) FILTER (WHERE e.code IS NULL) AS m, count(*) FILTER (WHERE g.code IS NULL) AS n, count(*) AS t FROM wanted w LEFT JOIN e USING (code) LEFT JOIN g USING (code) GROUP BY w.scope)
SELECT scope, 'C-10' AS "check", CASE WHEN m > 0 THEN 'FAIL' ELSE 'PASS' END AS status, m AS bad, t AS total FROM x UNION ALL SELECT scope, 'C-11', CASE WHEN n > 0 THEN 'WARN' ELSE 'PASS' END, n, t FROM x""")
def dia10_dia11_links(read):
    c = read("companies")
    return D.links_per_company(read("wanted"), c.where("seq % 10 <> 8"), "C-10", True).unionByName(D.links_per_company(read("wanted"), c.where("seq % 10 < 7"), "C-11", False))


@query("""WITH s AS (SELECT scope, count(*) FILTER (WHERE seq % 2 = 0 AND regexp_full_match(code, '[0-9]{8}')) AS m, count(*) FILTER (WHERE seq % 2 = 0) AS t FROM companies GROUP BY scope) SELECT scope, 'C-12' AS "check", CASE WHEN m > 0 THEN 'FAIL' ELSE 'PASS' END AS status, m AS bad, t AS total FROM s""")
def dia12_isolation(read):
    labels = F.when(F.col("seq") % 2 == 0, F.array(F.lit("Organization"), F.lit("LLMExtracted"))).otherwise(F.array(F.lit("Organization")))
    return D.isolation(read("companies").withColumn("labels", labels))


@query("""WITH s AS (SELECT page_id % 3 AS scope, count(*) FILTER (WHERE page_id % 3 = 0 AND page_id % 6 = 0) AS m, count(*) FILTER (WHERE page_id % 3 = 1 AND page_id % 4 = 0) AS w, count(*) AS t FROM pages GROUP BY 1) SELECT scope, 'C-14' AS "check", CASE WHEN m > 0 THEN 'FAIL' WHEN w > 0 THEN 'WARN' ELSE 'PASS' END AS status, CASE WHEN m > 0 THEN m ELSE w END AS bad, t AS total FROM s""")
def dia14_article_keys(read):
    k = F.col("page_id")
    return D.article_keys(read("pages").select((k % 3).alias("scope"), F.when((k % 3 != 0) | (k % 6 != 0), F.col("url")).alias("news_id"), F.when((k % 3 != 1) | (k % 4 != 0), k).alias("document_id")))


def _chunks(read):
    k = F.col("doc_id")
    status = F.when(k % 4 == 3, "pending").when(k % 7 == 0, "pending").otherwise("ready")
    return read("chunks").select((k % 4).alias("scope"), status.alias("status"), F.when((k % 4 == 2) & (k % 8 == 2), -k).otherwise(k).alias("receipt"), F.lit("r1").alias("run"), F.when((k % 4 != 1) | (k % 3 != 0), F.col("text")).alias("body"), k.alias("seq"))


@query("""WITH c AS (SELECT doc_id % 4 AS scope, CASE WHEN doc_id % 4 = 3 OR doc_id % 7 = 0 THEN 'pending' ELSE 'ready' END AS status, CASE WHEN doc_id % 8 = 2 THEN NULL ELSE doc_id END AS receipt, CASE WHEN doc_id % 4 = 1 AND doc_id % 3 = 0 THEN NULL ELSE 1 END AS body, doc_id FROM chunks),
s AS (SELECT scope, count(*) FILTER (WHERE status = 'ready') AS r, count(*) FILTER (WHERE status = 'pending') AS p, count(*) AS t, count(*) - count(receipt) AS o, count(*) - count(body) AS b, count(*) FILTER (WHERE doc_id % 4 = 0 OR doc_id % 50 > 0) AS v FROM c GROUP BY scope)
SELECT scope, 'I-01' AS "check", CASE WHEN r = 0 THEN 'FAIL' ELSE 'PASS' END AS status, p AS bad, t AS total FROM s UNION ALL SELECT scope, 'I-02', CASE WHEN t - v > t * 0.005 THEN 'FAIL' ELSE 'PASS' END, t - v, t FROM s
UNION ALL SELECT scope, 'I-04', CASE WHEN o >= t * 0.01 THEN 'FAIL' ELSE 'PASS' END, o, t FROM s UNION ALL SELECT scope, 'I-10', CASE WHEN b > 0 THEN 'FAIL' ELSE 'PASS' END, b, t FROM s""")
def dia17_dia18_dia21_dia24_stores(read):
    c = _chunks(read)
    documents = read("chunks").select(F.col("doc_id").alias("receipt"), F.lit("r1").alias("run"))
    parts = [D.ready_chunks(c), D.same_counts(c, c.where("seq % 4 = 0 or seq % 50 > 0"), 0.005, "I-02"), D.stray_chunks(c, documents), D.complete_bodies(c)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("""WITH s AS (SELECT user_id % 3 AS scope, count(*) FILTER (WHERE user_id % 3 > 0 AND event_id % 4 > 0) AS m, count(*) AS t FROM events GROUP BY 1) SELECT scope, 'I-09' AS "check", CASE WHEN m = 0 THEN 'FAIL' ELSE 'PASS' END AS status, t - m AS bad, t AS total FROM s""")
def dia23_matched_news(read):
    lists = F.when((F.col("user_id") % 3 > 0) & (F.col("event_id") % 4 > 0), '["005930"]').when(F.col("event_id") % 2 == 0, "[]")
    return D.matched_news(read("events").select((F.col("user_id") % 3).alias("scope"), lists.alias("companies")))


@query("""WITH a AS (SELECT scope, count(*) AS n FROM facts_of GROUP BY scope), b AS (SELECT scope, count(*) AS n FROM facts_of WHERE scope < 4 AND (scope <> 3 OR metric % 10 > 1) GROUP BY scope) SELECT coalesce(a.scope, b.scope) AS scope, 'X-01' AS "check", CASE WHEN abs(coalesce(a.n, 0) - coalesce(b.n, 0)) > coalesce(a.n, 0) * 0.0 THEN 'FAIL' ELSE 'PASS' END AS status, abs(coalesce(a.n, 0) - coalesce(b.n, 0)) AS bad, coalesce(a.n, 0) AS total FROM a FULL JOIN b ON a.scope = b.scope""")
def dia26_cross_store(read):
    f = read("facts_of")
    return D.same_counts(f, f.where("scope < 4 and (scope <> 3 or metric % 10 > 1)"), 0.0, "X-01")


@query("""WITH s AS (SELECT scope, count(*) FILTER (WHERE edge_run <> run) AS m, count(DISTINCT run) AS r FROM facts_of GROUP BY scope), k AS (SELECT scope, max(n) AS n FROM (SELECT scope, metric, count(*) AS n FROM facts_of GROUP BY scope, metric) GROUP BY scope),
v AS (SELECT scope, CASE WHEN m > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM s UNION ALL SELECT scope, CASE WHEN r > 3 THEN 'WARN' ELSE 'PASS' END FROM s UNION ALL SELECT scope, CASE WHEN n > 1 THEN 'FAIL' ELSE 'PASS' END FROM k UNION ALL SELECT scope, 'FAIL' FROM s)
SELECT scope, count(*) FILTER (WHERE status = 'PASS') AS pass, count(*) FILTER (WHERE status = 'WARN') AS warn, count(*) FILTER (WHERE status = 'FAIL') AS fail, count(*) AS checks, CASE WHEN count(*) FILTER (WHERE status = 'FAIL') = 0 THEN 'PASS' ELSE 'FAIL' END AS overall FROM v GROUP BY scope""")
def dia16_dia25_roll_up(read):
    f = read("facts_of")
    broken = D.guarded("C-00", lambda: D.unique_ids(f.drop("metric")), f)
    return D.roll_up(D.same_run(f), D.runs(f), D.unique_ids(f), broken)
