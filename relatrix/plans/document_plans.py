"""Queries over documents, summaries, news, metric rows and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents as D
from ..operators import graph as G
from .registry import by_case, query, sql_case

_BODIES = [("머리\nI. 회사의 개요\n글\n II.사업 \nIV 없음", '{"2":["I. 회사의 개요"],"4":["II. 사업"]}'), ("본문", "{}"), (None, "{}"), ("X. " + "가" * 60, '{"1":["X. ' + "가" * 50 + '"]}')]
_NAMED = [("[기재정정]사업보고서 (2024.12)", "사업보고서 (2024.12)", "사업보고서 (2024.12)"), (None, "기타", ""), ("반기보고서", "반기보고서", "반기보고서")]


@query(f"""SELECT o_orderkey AS receipt, {sql_case('o_orderkey', [b for _, b, _ in _NAMED])} AS kind, {sql_case('o_orderkey', [c for *_, c in _NAMED])} AS title, {sql_case('o_orderkey', [a or '' for a, *_ in _NAMED])} AS report, CASE WHEN o_orderkey % 3 <> 1 THEN o_orderpriority ELSE '' END AS filer, CASE WHEN o_orderkey % 2 = 0 THEN 'claude_temp' ELSE '' END AS method, o_orderkey % 5 = 0 AS verified,
CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE '' END AS facts, CASE WHEN o_orderkey % 4 = 2 THEN '' ELSE sha1({sql_case('o_orderkey', [a or '' for a, _ in _BODIES])})[1:16] END AS hash16, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 <> 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS day, '' AS short, {sql_case('o_orderkey', [b for _, b in _BODIES])} AS pages, CAST({sql_case('o_orderkey', [len(a or '') for a, _ in _BODIES])} AS INT) AS chars FROM orders""")
def txt7_s40_document_rows(read):
    k = F.col("o_orderkey")
    o = read("orders")
    summaries = o.select(k.alias("receipt"), F.lit("기타").alias("kind"), F.lit(None).cast("string").alias("short"), F.when(k % 2 == 0, "claude_temp").alias("method"), F.when(k % 5 == 0, True).alias("verified"), F.when(k % 2 == 0, F.array("o_orderstatus")).alias("facts"))
    reports = o.where("o_orderkey % 3 <> 1").select(k.alias("receipt"), by_case("o_orderkey", [a for a, *_ in _NAMED]).alias("name"), F.when(k % 2 == 0, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.date_format("o_orderdate", "yyyyMM")).alias("received"), F.col("o_orderpriority").alias("filer"))
    bodies = o.where("o_orderkey % 4 <> 2").select(k.alias("receipt"), by_case("o_orderkey", [a for a, _ in _BODIES]).alias("body"))
    return D.document_rows(summaries, reports, bodies).withColumn("facts", F.array_join("facts", ","))


#: (old method, old companies, recheck, text, rule companies, model companies, old rule companies, old model companies) -> (companies, method), None if the row is left out.
_NEWS = [
    (("rule", "A", False, "t", "B", "C", "A", ""), ("A", "rule")), ((None, "", False, "t", "A,B", "C", "", ""), ("A,B", "rule")), ((None, "", False, "t", "", "C", "", ""), ("C", "llm")),
    ((None, "", False, "t", "", "", "", ""), ("", "none")), ((None, "", False, " ", "A", "", "", ""), None), (("llm", "C", True, "t", "B", "X", "", "C"), ("B,C", "llm+rule_recheck")),
    (("none", "", True, "t", "B", "", "", ""), ("B", "rule")), (("rule", "B", True, "t", "B", "C", "B", ""), ("B", "rule")), (("llm", "C", True, "t", "C", "", "", "C"), ("C", "llm+rule_recheck")),
    (("", "A", False, "t", "B", "", "A", ""), ("B", "rule")), ((None, "", True, "t", "", "C", "", "D"), ("D", "none")),
]


@query(f"SELECT * FROM (SELECT doc_id AS news_id, {sql_case('doc_id', [w and w[0] for _, w in _NEWS])} AS companies, {sql_case('doc_id', [w and w[1] for _, w in _NEWS])} AS method FROM chunks) WHERE method IS NOT NULL")
def txt9_matched_news(read):
    c = lambda i: by_case("doc_id", [a[i] for a, _ in _NEWS])
    many = lambda x: F.filter(F.split(x, ","), lambda y: y != "")
    o = read("chunks").select(F.col("doc_id").alias("news_id"), c(0).alias("old_method"), many(c(1)).alias("old_companies"), c(2).alias("recheck"), c(3).alias("title"), F.when(c(3) == " ", "").otherwise(F.col("text")).alias("body"), many(c(4)).alias("r"), many(c(5)).alias("m"), many(c(6)).alias("old_rules"), many(c(7)).alias("old_models"))
    hits = lambda x: o.select("news_id", F.explode(x).alias("company"))
    return D.matched_news(o.drop("r", "m"), hits("r"), hits("m")).withColumn("companies", F.array_join("companies", ","))


_METHODS = [("claude_temp", "keep", "keep"), ("qwen_local_v1", "keep", "keep"), ("pending", "make", "make"), ("llm_call_fail", "make", "make"), ("skip_short", "make", "keep"), (None, "make", "make")]


@query(f"SELECT o_orderkey AS chunk, {sql_case('o_orderkey', [b for _, b, _ in _METHODS])} AS action, {sql_case('o_orderkey', [c for *_, c in _METHODS])} AS pending_only FROM orders")
def txt11_to_summarise(read):
    chunks = read("orders").select(F.col("o_orderkey").alias("chunk"))
    sidecar = read("orders").where("o_orderkey % 6 < 5").select(F.col("o_orderkey").alias("chunk"), by_case("o_orderkey", [a for a, *_ in _METHODS]).alias("method"))
    both = D.to_summarise(chunks, sidecar, pending_only=True).select("chunk", F.col("action").alias("pending_only"))
    return D.to_summarise(chunks, sidecar).select("chunk", "action").join(both, "chunk")


@query("SELECT doc_id, md5(concat(concat_ws(' ', '회사', CASE WHEN doc_id % 2 = 0 THEN source END, CASE WHEN doc_id % 3 = 0 THEN 'II. 사업 > 1. 개요' END), chr(10), chr(10), text)) AS digest FROM chunks")
def txt8_txt19_prefixed(read):
    k = F.col("doc_id")
    heads = F.when(k % 3 == 0, F.array(F.lit("II. 사업"), F.lit("1. 개요"))).otherwise(F.array().cast("array<string>"))
    return read("chunks").select("doc_id", F.md5(D.prefixed(F.lit(" 회사"), F.when(k % 2 == 0, F.col("source")).when(k % 4 == 1, " "), heads, F.col("text"))).alias("digest"))


@query("SELECT doc_id, length(text) + length(source) + 1 AS chars FROM chunks WHERE doc_id % 3 = 0 AND doc_id % 2 = 0")
def snk24_to_reembed(read):
    k = F.col("doc_id")
    rows = read("chunks").select("doc_id", F.when(k % 3 == 0, "table_nl").otherwise("text_micro").alias("kind"), F.col("source").alias("prefix"), F.when(k % 2 == 0, F.col("text")).otherwise(F.concat("source", F.lit("\n"), "text")).alias("text"))
    return D.to_reembed(rows).select("doc_id", F.length("text").cast("long").alias("chars"))


_ROWS = [("매출액", "1,000", " ifrs-full_Revenue ", "ifrs-full_Revenue", 1000), ("(주석)", "1", "x", None, None), (" 자산 ", "△5", "-표준계정코드 미사용-", "", -5), ("부채", "-", "x", None, None), ("공시되지 않은 항목", "3", "x", None, None), ("자본", "(7)", None, "", -7)]
_KEPT = {"매출액": "매출액", " 자산 ": "자산", "자본": "자본"}


@query(f"""SELECT * FROM (SELECT o_orderkey AS id, {sql_case('o_orderkey', [_KEPT.get(a) for a, *_ in _ROWS])} AS indicator, {sql_case('o_orderkey', [e for *_, e in _ROWS])} AS value, {sql_case('o_orderkey', [d for *_, d, _ in _ROWS])} AS account_id,
md5(concat('C|', year(o_orderdate), '|', {sql_case('o_orderkey', [_KEPT.get(a) for a, *_ in _ROWS])}, '|CFS|BS|11011'))[1:16] AS metric FROM orders) WHERE indicator IS NOT NULL""")
def ent14_metric_rows(read):
    c = lambda i: by_case("o_orderkey", [r[i] for r in _ROWS])
    lit = {n: F.lit(v) for n, v in (("corp", "C"), ("fs", "CFS"), ("sj", "BS"), ("report", "11011"))}
    rows = read("orders").select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year"), c(0).alias("indicator"), c(1).alias("amount"), c(2).alias("account_id"), *(v.alias(n) for n, v in lit.items()))
    return D.metric_rows(rows).select("id", "indicator", "value", "account_id", "metric")


@query("""SELECT '2024-02-01 00:00:00' AS run_ts, corp, grp, predicate, target FROM (SELECT src AS corp, type AS predicate, dst AS target, extracted_by FROM edges UNION ALL SELECT dst, type, src, extracted_by FROM edges), (SELECT unnest(['COMPETES_WITH', 'SUPPLIES', 'INVESTS_IN']) AS t, unnest(['compete', 'supply', 'invest']) AS grp) WHERE predicate = t AND extracted_by IS NOT NULL AND corp IN (SELECT concat('N', CAST(n_nationkey AS VARCHAR)) FROM nation WHERE n_regionkey = 1)""")
def snk16_str9_snapshot(read):
    seeds = read("nation").where("n_regionkey = 1").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("centre"))
    out = D.snapshot(read("edges"), seeds, F.lit("2024-02-01").cast("timestamp"), G.group_of(F.col("type")))
    return out.withColumn("run_ts", F.date_format("run_ts", "yyyy-MM-dd HH:mm:ss"))


@query("""WITH n AS (SELECT p_brand AS key, CASE p_partkey % 3 WHEN 0 THEN concat('news:', CAST(p_partkey AS VARCHAR)) WHEN 1 THEN concat('X', CAST(p_partkey AS VARCHAR)) ELSE CASE WHEN p_partkey % 2 = 0 THEN printf('%08d', p_partkey) ELSE concat('n', CAST(p_partkey AS VARCHAR)) END END AS node FROM part),
b AS (SELECT key, node AS new FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY CASE WHEN regexp_full_match(node, '[0-9]{8}') THEN 0 WHEN node LIKE 'X%' THEN 1 ELSE 2 END, node) AS rn FROM n) WHERE rn = 1) SELECT node AS old, new FROM n JOIN b USING (key) WHERE node <> new""")
def snk20_preferred(read):
    k, s = F.col("p_partkey"), F.col("p_partkey").cast("string")
    node = F.when(k % 3 == 0, F.concat(F.lit("news:"), s)).when(k % 3 == 1, F.concat(F.lit("X"), s)).when(k % 2 == 0, F.lpad(s, 8, "0")).otherwise(F.concat(F.lit("n"), s))
    return D.preferred(read("part").select(node.alias("node"), F.concat(F.lit("㈜ "), F.col("p_brand")).alias("name")))


@query("""SELECT corp, concat('{', string_agg(concat('"', label, '":', CAST(n AS VARCHAR)), ',' ORDER BY label), '}') AS counts, CAST(sum(n) AS BIGINT) AS total FROM (SELECT corp, label, count(*) AS n FROM docs GROUP BY corp, label) GROUP BY corp""")
def snk17_agg27_manifest(read):
    return D.manifest(read("docs"), "corp", "label")


@query("""WITH r AS (SELECT corp, trim(holder) AS name, stake, CASE WHEN seq % 5 = 0 THEN 'fund' WHEN seq % 5 = 1 THEN 'overseas' ELSE 'other' END AS kind FROM (SELECT 'C' || CAST(seq % 3 AS VARCHAR) AS corp, concat('Holder ', CAST(seq % 37 AS VARCHAR)) AS holder, stake, seq FROM stakes)), b AS (SELECT corp, name, max(stake) AS stake FROM r WHERE kind = 'other' GROUP BY corp, name), k AS (SELECT *, row_number() OVER (PARTITION BY corp ORDER BY coalesce(stake, 0) DESC, name) AS rank FROM b)
SELECT corp, name, round(stake, 6) AS stake, CAST(rank AS INT) AS rank FROM k WHERE rank <= 6 UNION ALL SELECT corp, CASE WHEN kind = 'fund' THEN concat('투자조합·펀드 ', CAST(count(*) AS VARCHAR), '건') ELSE concat('해외 출자법인 ', CAST(count(*) AS VARCHAR), '건') END, NULL, CASE WHEN kind = 'fund' THEN 8 ELSE 7 END FROM r WHERE kind <> 'other' GROUP BY corp, kind
UNION ALL SELECT corp, concat('기타 출자 ', CAST(count(*) AS VARCHAR), '건'), NULL, 9 FROM k WHERE rank > 6 GROUP BY corp""")
def agg7_class_summary(read):
    k = F.col("seq")
    rows = read("stakes").select(F.concat(F.lit("C"), (k % 3).cast("string")).alias("corp"), F.concat(F.lit("Holder "), (k % 37).cast("string"), F.lit(" ")).alias("name"), "stake", "seq")
    kind = F.when(k % 5 == 0, "fund").when(k % 5 == 1, "overseas").otherwise("other")
    return D.class_summary(rows, "corp", kind).withColumn("stake", F.round("stake", 6)).select("corp", "name", "stake", F.col("rank").cast("int").alias("rank"))
