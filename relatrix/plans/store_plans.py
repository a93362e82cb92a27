"""Queries over table changes and increments (rows SNK, JON, STR)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tables as T
from ..streaming import incremental as I
from .registry import query


@query("""SELECT coalesce(t.id, s.id) AS id, CASE WHEN s.id IS NOT NULL THEN s.name ELSE t.name END AS name, CASE WHEN t.id IS NULL THEN s.note ELSE t.note END AS note FROM (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS note FROM customer WHERE c_custkey % 3 <> 0) t
FULL OUTER JOIN (SELECT c_custkey AS id, upper(c_name) AS name, 'new' AS note FROM customer WHERE c_custkey % 2 = 0) s ON t.id = s.id""")
def snk1_upsert(read):
    c = read("customer")
    target = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("note"))
    source = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.upper("c_name").alias("name"), F.lit("new").alias("note"))
    return T.upsert(target, source, ["id"], ["name"])


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, upper(c_name) FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 = 0")
def snk2_insert_ignore(read):
    c = read("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return T.insert_ignore(c.where("id % 3 <> 0"), c.where("id % 2 = 0").withColumn("name", F.upper("name")), ["id"])


@query("""WITH t AS (SELECT concat('S', CAST(s_suppkey AS VARCHAR)) AS node, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_name END AS name, s_suppkey FROM supplier WHERE s_suppkey % 3 <> 0), s AS (SELECT concat('S', CAST(s_suppkey AS VARCHAR)) AS node, upper(s_name) AS name, s_suppkey FROM supplier WHERE s_suppkey % 2 = 0)
SELECT coalesce(t.node, s.node) AS node, coalesce(t.name, s.name) AS name, CASE WHEN t.node IS NOT NULL AND s.node IS NOT NULL THEN 'a,b' WHEN t.node IS NOT NULL THEN 'a' ELSE 'b' END AS aliases, CASE WHEN t.node IS NOT NULL THEN 'r1' ELSE 'r2' END AS first_run, CASE WHEN s.node IS NOT NULL THEN 'r2' ELSE 'r1' END AS last_run FROM t FULL OUTER JOIN s ON t.node = s.node""")
def snk4_snk6_merge_nodes(read):
    s = read("supplier").select("s_suppkey", F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("node"), "s_name")
    target = s.where("s_suppkey % 3 <> 0").select("node", F.when(F.col("s_suppkey") % 4 != 0, F.col("s_name")).alias("name"), F.array(F.lit("a")).alias("aliases"), F.lit("r1").alias("first_run"), F.lit("r1").alias("last_run"))
    source = s.where("s_suppkey % 2 = 0").select("node", F.upper("s_name").alias("name"), F.array(F.lit("b")).alias("aliases"), F.lit("r2").alias("run"))
    return T.merge_nodes(target, source, "node").withColumn("aliases", F.array_join("aliases", ","))


@query("SELECT src, dst, type, count(DISTINCT doc_id) AS evidence_count, array_to_string(list_sort(list(DISTINCT doc_id)), ',') AS doc_ids FROM facts GROUP BY src, dst, type")
def snk7_merge_edges(read):
    f = read("facts").withColumn("evidence", F.col("doc_id").cast("string")).withColumn("seq", F.col("doc_id"))
    keys = ["src", "dst", "type"]
    target = f.where("doc_id % 2 = 0").groupBy(*keys).agg(F.collect_set("doc_id").alias("doc_ids"), F.min_by("evidence", "seq").alias("evidence"))
    return T.merge_edges(target, f.where("doc_id % 3 = 0 or doc_id % 2 = 1"), keys).select(*keys, "evidence_count", F.array_join("doc_ids", ",").alias("doc_ids"))


@query("SELECT node FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges) WHERE node NOT IN (SELECT concat('S', CAST(s_suppkey AS VARCHAR)) FROM supplier WHERE s_suppkey % 2 = 0)")
def snk8_stubs(read):
    nodes = read("supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("node"))
    return T.stub_nodes(read("edges"), nodes)


@query("SELECT src, dst, type, evidence_count FROM edges WHERE dst IN (SELECT concat('S', CAST(s_suppkey AS VARCHAR)) FROM supplier WHERE s_suppkey % 2 = 0) AND src IN (SELECT concat('N', CAST(n_nationkey AS VARCHAR)) FROM nation WHERE n_nationkey % 2 = 0)")
def snk9_endpoints(read):
    s = read("supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("node"))
    n = read("nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("node"))
    return T.with_endpoints(read("edges"), s.union(n)).select("src", "dst", "type", "evidence_count")


@query("SELECT CASE WHEN (text LIKE '%reserved%' OR text LIKE '%License%') AND source IN ('src1', 'src2') AND length(text) < 2000 THEN 'pending' ELSE 'ready' END AS status, count(*) AS n FROM chunks GROUP BY ALL")
def snk13_soft_delete(read):
    rows = read("chunks").withColumn("kind", F.col("source")).withColumn("n_tokens", F.length("text")).withColumn("status", F.lit("ready"))
    return T.soft_delete(rows, ["%reserved%", "%License%"], ["src1", "src2"], 2000).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT corp, account, report, value FROM (SELECT *, row_number() OVER (PARTITION BY corp, account, report ORDER BY seq) AS rn FROM metrics) WHERE rn = 1")
def snk22_keep_one(read):
    return T.keep_one(read("metrics").select("corp", "account", "report", "value", "seq"), ["corp", "account", "report"], F.col("seq")).drop("seq")


@query("SELECT p.corp, p.seq FROM prices p LEFT JOIN (SELECT corp, max(day) AS mark FROM prices WHERE day < DATE '2024-01-15' AND corp % 2 = 0 GROUP BY corp) s ON p.corp = s.corp WHERE p.day > coalesce(s.mark, DATE '2024-01-20')")
def str1_watermark(read):
    p = read("prices")
    stored = p.where((F.col("day") < F.lit("2024-01-15").cast("date")) & (F.col("corp") % 2 == 0))
    return I.after_watermark(stored, p, "corp", "day", F.lit("2024-01-20").cast("date")).select("corp", "seq")


@query("WITH s AS (SELECT * FROM prices WHERE seq % 2 = 0 AND day < DATE '2024-01-15'), m AS (SELECT corp, max(day) AS mark FROM s GROUP BY corp) SELECT p.corp, p.seq FROM prices p LEFT JOIN m ON p.corp = m.corp WHERE (m.mark IS NULL OR p.day >= m.mark) AND p.seq NOT IN (SELECT seq FROM s)")
def str2_inclusive_watermark(read):
    p = read("prices")
    stored = p.where((F.col("seq") % 2 == 0) & (F.col("day") < F.lit("2024-01-15").cast("date")))
    return I.from_watermark(stored, p, "corp", "day", "seq").select("corp", "seq")


@query("WITH m AS (SELECT DISTINCT corp, strftime(day, '%Y-%m') AS month FROM prices) SELECT corp, month FROM m WHERE month = '2024-01' OR corp % 2 = 1")
def str4_open_periods(read):
    months = read("prices").select("corp", F.date_format("day", "yyyy-MM").alias("month")).distinct()
    return I.open_or_missing(months, months.where("corp % 2 = 0"), F.lit("2024-01"))
