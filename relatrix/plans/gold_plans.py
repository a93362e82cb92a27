"""Queries over questions made from chunks, tables that change by days and buckets, articles' metadata and round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diagnostics as D
from ..operators import gold as G
from ..operators import vector_table as V
from ..session import scratch
from ..sources import pending as P
from ..sources import readers
from ..streaming import daily as Y
from .registry import query

#: Chunks: accounts in full and compared, auditors, executives, and one undisclosed account in eleven.
_CHUNKS = """c AS (SELECT concat('M', CAST(seq AS VARCHAR)) AS chunk, corp, concat('회사', corp) AS name, CASE WHEN seq % 7 = 5 THEN 'accnutAdtorNmNdAdtOpinion' WHEN seq % 7 = 6 THEN 'exctvSttus' ELSE 'fnlttSinglAcntAll' END AS endpoint, CASE WHEN seq % 3 = 0 THEN 'comparison' ELSE 'full' END AS variant, CASE WHEN seq % 13 > 0 THEN year END AS year,
CASE WHEN seq % 11 = 0 THEN '(공시되지 않음)' ELSE account END AS account, seq FROM metrics),
t AS (SELECT *, CASE WHEN seq % 7 = 6 THEN concat('회사의 임원 ''P', CAST(seq % 50 AS VARCHAR), '''') WHEN seq % 7 = 5 THEN '감사의견' WHEN seq % 3 = 0 THEN concat('연결 ', replace(account, ' ', '_'), ' 3기 추이 항목 ''', account, '''') ELSE concat('사업보고서 별도재무제표 항목 ''', account, '''') END AS text FROM c),
named AS (SELECT * FROM t WHERE endpoint = 'fnlttSinglAcntAll' AND account NOT LIKE '(공시되지%'),
qa AS (SELECT '정형수치' AS category, concat(name, ' ', CAST(year AS VARCHAR), '년 ', account) AS query, chunk AS chunks, corp AS corps FROM named WHERE seq % 3 > 0 AND year IS NOT NULL ORDER BY md5(concat('a|', chunk)), chunk LIMIT 40),
qt AS (SELECT '시계열', concat(name, ' ', replace(account, ' ', '_'), ' 추이'), chunk, corp FROM t WHERE variant = 'comparison' AND seq % 7 < 5 AND account NOT LIKE '% %' ORDER BY md5(concat('t|', chunk)), chunk LIMIT 30),
one AS (SELECT year, account, corp, min({'c': chunk, 'n': name}) AS r FROM named WHERE variant = 'full' AND year IN (1996, 1997) GROUP BY ALL),
pr AS (SELECT *, lead({'corp': corp, 'r': r}) OVER (PARTITION BY year, account ORDER BY corp) AS nx FROM one),
qc AS (SELECT '비교', concat(r.n, ' vs ', nx.r.n, ' ', CAST(year AS VARCHAR), '년 ', account), concat(r.c, ',', nx.r.c), concat(corp, ',', nx.corp) FROM pr WHERE nx IS NOT NULL ORDER BY md5(concat('c|', r.c, '|', nx.r.c)), r.c, nx.r.c LIMIT 30),
qs AS (SELECT '출처_충돌_검증', concat(n, ' ', coalesce(CAST(year AS VARCHAR), 'None'), '년 감사의견'), k, corp FROM (SELECT corp, year, min(chunk) AS k, min(name) AS n FROM t WHERE seq % 7 = 5 GROUP BY ALL) ORDER BY md5(concat('s|', k)), k LIMIT 20),
qp AS (SELECT '시점', concat(CAST(year AS VARCHAR), '년 기준 ', n, ' 임원 P', p), k, corp FROM (SELECT corp, year, CAST(seq % 50 AS VARCHAR) AS p, min(chunk) AS k, min(name) AS n FROM t WHERE seq % 7 = 6 AND year IS NOT NULL GROUP BY ALL) ORDER BY md5(concat('p|', k)), k LIMIT 20),
q AS (SELECT * FROM qa UNION ALL SELECT * FROM qt UNION ALL SELECT * FROM qc UNION ALL SELECT * FROM qs UNION ALL SELECT * FROM qp)"""


def _chunks(read):
    k, none = F.col("seq"), F.lit("(공시되지 않음)")
    account = F.when(k % 11 == 0, none).otherwise(F.col("account"))
    text = (
        F.when(k % 7 == 6, F.concat(F.lit("회사의 임원 'P"), (k % 50).cast("string"), F.lit("'")))
        .when(k % 7 == 5, "감사의견")
        .when(k % 3 == 0, F.concat(F.lit("연결 "), F.replace(account, F.lit(" "), F.lit("_")), F.lit(" 3기 추이 항목 '"), account, F.lit("'")))
        .otherwise(F.concat(F.lit("사업보고서 별도재무제표 항목 '"), account, F.lit("'")))
    )
    endpoint = F.when(k % 7 == 5, G.AUDIT).when(k % 7 == 6, G.EXECUTIVES).otherwise(G.ACCOUNTS)
    return read("metrics").select(F.concat(F.lit("M"), k.cast("string")).alias("chunk"), "corp", F.concat(F.lit("회사"), "corp").alias("name"), endpoint.alias("endpoint"), F.when(k % 3 == 0, "comparison").otherwise("full").alias("variant"), F.when(k % 13 > 0, F.col("year")).alias("year"), text.alias("text"))


def _questions(read):
    c = _chunks(read)
    compared = c.where(~F.col("text").rlike(r"항목 '[^']* "))  # trends name their account without spaces
    parts = [G.account_questions(c, 40), G.trend_questions(compared, 30), G.comparison_questions(c, 30, (1996, 1997)), G.audit_questions(c, 20), G.person_questions(c, 20)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"WITH {_CHUNKS} SELECT * FROM q UNION ALL SELECT 'no_answer', concat(n, ' ', f), '', '' FROM (SELECT n_name AS n, f FROM nation CROSS JOIN (SELECT unnest(['2024년 매출액', '임원 현황']) AS f) ORDER BY md5(concat('u|', n, '|', f)), n, f LIMIT 30)")
def txt17_top8_questions(read):
    fields = read("region").limit(1).select(F.explode(F.array(F.lit("2024년 매출액"), F.lit("임원 현황"))).alias("field"))
    rows = _questions(read).unionByName(G.unanswerable(read("nation").select(F.col("n_name").alias("name")), fields, 30))
    return rows.select("category", "query", F.array_join("chunks", ",").alias("chunks"), F.array_join("corps", ",").alias("corps"))


@query(f"""WITH {_CHUNKS}, u AS (SELECT category, query, corps, chunks AS own, unnest(string_split(chunks, ',')) AS chunk FROM q), k AS (SELECT chunk, CASE WHEN endpoint = 'fnlttSinglAcntAll' AND seq % 7 < 5 THEN concat_ws('|', 'f', corp, coalesce(CAST(year AS VARCHAR), '-'), account, variant) WHEN seq % 7 = 5 THEN concat_ws('|', 'a', corp, coalesce(CAST(year AS VARCHAR), '-')) END AS fact FROM t),
m AS (SELECT u.category, u.query, u.corps, u.own, b.chunk FROM u JOIN k a ON a.chunk = u.chunk JOIN k b ON b.fact = a.fact WHERE u.category <> '시점' UNION SELECT category, query, corps, own, chunk FROM u)
SELECT category, query, corps, string_agg(chunk, ',' ORDER BY chunk) AS chunks FROM m GROUP BY category, query, corps, own""")
def txt17_widened(read):
    return G.widened(_questions(read), _chunks(read)).select("category", "query", F.array_join("corps", ",").alias("corps"), F.array_join("chunks", ",").alias("chunks"))


@query("""SELECT 'L' || CAST(label AS VARCHAR) AS topic, n FROM (SELECT doc_id % 40 AS label, count(*) AS n FROM chunks WHERE length(text) > 40 AND doc_id % 40 > 9 GROUP BY 1)""")
def txt17_topics(read):
    """Headings of one letter are too short and dull ones are left out; each heading is asked once, for its first chunk."""
    k = F.col("doc_id") % 40
    topic = F.when(k < 5, "개요").when(k < 10, "기타 내용").otherwise(F.concat(F.lit("제목 L"), k.cast("string")))
    c = read("chunks").where(F.length("text") > 40).select(F.col("doc_id").cast("string").alias("chunk"), F.lit("C1").alias("corp"), F.lit("회사").alias("name"), F.lit("text_micro").alias("kind"), F.concat(F.lit("회사의 '"), topic, F.lit("' 섹션에서 "), F.substring("text", 1, 60)).alias("summary"), k.alias("label"))
    asked = G.topic_questions(c, 1000)
    sizes = c.groupBy("label").agg(F.count("*").alias("n"))
    return asked.select(F.regexp_extract("query", r"제목 (L\d+)$", 1).alias("topic")).join(sizes.select(F.concat(F.lit("L"), F.col("label").cast("string")).alias("topic"), "n"), "topic")


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 50 = 1 THEN concat('B', CAST(corp AS VARCHAR)) ELSE concat('A', CAST(corp AS VARCHAR)) END AS corp, CASE WHEN doc_id % 50 = 1 THEN CAST(ts + INTERVAL 3 DAY AS DATE) ELSE day END AS day FROM docs WHERE doc_id % 10 < 9)
SELECT corp, day, count(*) AS mentions, md5(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY CAST(doc_id AS VARCHAR))) AS digest FROM d GROUP BY corp, day""")
def str5_str8_snk3_days(read):
    """Three batches: most documents; late ones, some again; and documents that come again three days later, that batch twice."""
    docs = read("docs")
    spark, out = docs.sparkSession, scratch(docs.sparkSession, "days")
    rows = docs.select("doc_id", F.concat(F.lit("A"), F.col("corp").cast("string")).alias("corp"), "ts")
    moved = docs.where("doc_id % 50 = 1").select("doc_id", F.concat(F.lit("B"), F.col("corp").cast("string")).alias("corp"), F.expr("ts + INTERVAL 3 DAYS").alias("ts"))
    batches = [rows.where("doc_id % 10 < 6"), rows.where("doc_id % 10 between 4 and 8"), moved]
    for n in (0, 1, 2, 2):
        Y.merge_days(batches[n], n, f"{out}/docs", f"{out}/daily")
    return Y.read_daily(spark, f"{out}/daily").select("corp", "day", "mentions", F.md5(F.array_join("doc_ids", ",")).alias("digest"))


@query("""WITH a AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 OR doc_id % 3 = 2 THEN md5(concat('new', text)) ELSE md5(text) END AS txt, CASE WHEN doc_id % 6 = 0 OR doc_id % 3 = 2 THEN 2 ELSE 1 END AS v FROM chunks WHERE doc_id % 3 = 2 OR doc_id % 3 < 2)
SELECT concat('c', CAST(doc_id AS VARCHAR)) AS chunk_id, source AS corp, 2024 AS year, txt AS embedding_text, 'ready' AS status, concat('2024-01-0', CAST(v AS VARCHAR)) AS ready_at, CASE WHEN embedding IS NOT NULL THEN concat('krx_ohlcv|', source, '|', CASE WHEN v = 2 THEN '2025' ELSE '2024' END, '|ready|r1') END AS payload, round(CAST(embedding[1] AS DOUBLE) * v, 5) AS first_value
FROM a JOIN chunks USING (doc_id) LEFT JOIN vectors ON vec_id = doc_id WHERE v = 1 OR doc_id % 6 = 0 UNION ALL
SELECT concat('c', CAST(doc_id AS VARCHAR)), source, 2025, txt, 'ready', '2024-01-02', CASE WHEN embedding IS NOT NULL THEN concat('krx_ohlcv|', source, '|2025|ready|r1') END, round(CAST(embedding[1] AS DOUBLE) * 2, 5) FROM a JOIN chunks USING (doc_id) LEFT JOIN vectors ON vec_id = doc_id WHERE v = 2 AND doc_id % 6 > 0""")
def snk11_snk27_vectors(read):
    """Two loads: some chunks twice, with another text, year and vector. A known chunk's index row keeps its year; its point mirrors the new row."""
    c, v = read("chunks"), read("vectors").select(F.col("vec_id").alias("doc_id"), "embedding")
    spark = c.sparkSession
    root = scratch(spark, "vectors")
    k = F.col("doc_id")

    def load(rows, text, year, day, factor):
        rows = rows.join(v, "doc_id", "left")
        rows = rows.select(F.concat(F.lit("c"), k.cast("string")).alias("chunk_id"), F.lit("r1").alias("run_id"), F.col("source").alias("corp"), F.lit(year).alias("year"), text.alias("embedding_text"), F.lit(f"2024-01-0{day} 00:00:00").cast("timestamp").alias("at"), F.transform("embedding", lambda x: (x * factor).cast("float")).alias("embedding"))
        V.upsert_chunks(rows, "krx_ohlcv", f"{root}/index", f"{root}/points", 8)

    load(c.where("doc_id % 3 < 2"), F.md5("text"), 2024, 1, 1)
    load(c.where("doc_id % 6 = 0 or doc_id % 3 = 2"), F.md5(F.concat(F.lit("new"), "text")), 2025, 2, 2)
    points = spark.read.schema(V.POINTS).parquet(f"{root}/points").select(F.col("payload.chunk_id").alias("chunk_id"), F.concat_ws("|", *(F.col(f"payload.{f}") for f in ("chunk_type", "corp_code", "bsns_year", "ingest_status", "run_id"))).alias("payload"), F.round(F.get("embedding", F.lit(0)).cast("double"), 5).alias("first_value"))
    index = spark.read.schema(V.INDEX).parquet(f"{root}/index")
    return index.join(points, "chunk_id", "left").select("chunk_id", "corp", "year", "embedding_text", "status", F.date_format("ready_at", "yyyy-MM-dd").alias("ready_at"), "payload", "first_value")


_HEAD = '<meta charset="utf-8">'


@query("""WITH p AS (SELECT page_id, url, page_id % 4 AS k FROM pages) SELECT page_id, CASE WHEN k IN (0, 1) THEN concat('og ', CAST(page_id AS VARCHAR)) END AS og_title, CASE WHEN k = 2 THEN 'A "b"' END AS ld_headline, CASE WHEN k = 2 THEN '2025-05-05' END AS ld_published,
CASE WHEN k = 0 THEN '2026-01-02T03:04:05' WHEN k = 1 THEN '2026-05-29' WHEN k = 3 THEN NULL END AS published, CASE WHEN k = 0 THEN 'Site & Co' END AS site FROM p""")
def src14_metadata(read):
    """Pages with metadata put in their heads: all of them, a title with a day in the address, linked data, or none."""
    k, n = F.col("page_id") % 4, F.col("page_id").cast("string")
    og = F.concat(F.lit('<meta property="og:title" content="og '), n, F.lit('">'))
    all_ = F.concat(og, F.lit('<meta property="article:published_time" content="2026-01-02T03:04:05"><meta content="Site &amp; Co" property="og:site_name">'))
    linked = F.lit('<script type="application/ld+json">{broken</script><script type="application/ld+json">[{"@type": "Person", "headline": "no"}, {"@type": "NewsArticle", "headline": "A \\"b\\"", "datePublished": "2025-05-05"}]</script>')
    head = F.when(k == 0, all_).when(k == 1, og).when(k == 2, linked).otherwise("")
    url = F.when(k == 1, F.concat(F.lit("http://a.example/20260529"), n)).otherwise(F.col("url"))
    pages = read("pages").select("page_id", url.alias("url"), F.replace(F.col("html"), F.lit(_HEAD), F.concat(F.lit(_HEAD), head)).alias("html"))
    return readers.articles(pages, 0).select("page_id", "og_title", "ld_headline", "ld_published", "published", F.col("site"))


@query("""WITH c AS (SELECT doc_id, source, lang, md5(text) AS body FROM chunks), r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(concat('v|', CAST(doc_id AS VARCHAR))), doc_id) AS rn FROM c) WHERE rn <= 5),
x AS (SELECT source AS scope, doc_id % 9 = 4 AS gone, doc_id % 9 <> 4 AND doc_id % 5 = 3 AS differs FROM r)
SELECT scope, 'X-02' AS "check", CASE WHEN count(*) FILTER (WHERE gone OR differs) > 0 THEN 'FAIL' ELSE 'PASS' END AS status, count(*) FILTER (WHERE gone OR differs) AS bad, count(*) AS total FROM x GROUP BY scope""")
def dia26_round_trip(read):
    """In the other store one row in nine is missing and one in five has another language."""
    left = read("chunks").select(F.col("source").alias("scope"), "doc_id", "lang", F.md5("text").alias("body"))
    right = left.where("doc_id % 9 <> 4").withColumn("lang", F.when(F.col("doc_id") % 5 == 3, F.lit(None).cast("string")).otherwise(F.col("lang"))).drop("scope")
    return D.round_trip(left, right, "doc_id", ["lang", "body"], 5, "v", "X-02")


@query("""SELECT * FROM (SELECT code, freq, CASE freq WHEN 'M' THEN '202001' WHEN 'Q' THEN '2020Q1' WHEN 'D' THEN '20200101' ELSE '2020' END AS first_period, CASE freq WHEN 'M' THEN '202512' WHEN 'Q' THEN '2025Q4' WHEN 'D' THEN '20251231' ELSE '2025' END AS last_period FROM (SELECT concat('S', CAST(p_partkey AS VARCHAR)) AS code, ['M', 'Q', 'D', 'A'][p_partkey % 4 + 1] AS freq, p_partkey FROM part) WHERE p_partkey % 3 > 0)""")
def src30_macro_requests(read):
    k = F.col("p_partkey")
    indicators = read("part").select(F.concat(F.lit("S"), k.cast("string")).alias("code"), F.element_at(F.array(*[F.lit(x) for x in "MQDA"]), (k % 4 + 1).cast("int")).alias("freq"), k)
    bounds = P.macro_requests(indicators.drop("p_partkey"), 2020, 2025, read("region").select(F.lit("").alias("file")))
    cached = bounds.join(indicators.where("p_partkey % 3 = 0").select("code"), "code").select(F.col("file"))
    return P.macro_requests(indicators.drop("p_partkey"), 2020, 2025, cached).select("code", "freq", "first_period", "last_period")


@query("""WITH r AS (SELECT o_custkey AS corp, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders)
SELECT CAST(corp AS VARCHAR) AS corp, CAST(k AS VARCHAR) AS receipt, CASE WHEN k % 4 = 0 THEN 'cached' WHEN k % 4 = 1 THEN 'pdf_only' ELSE 'fetch' END AS state, CAST(place AS INT) AS place FROM r WHERE place <= 3""")
def src23_document_states(read):
    """Each receipt is listed twice; two files, the body only, the document only, or none are there."""
    o = read("orders").select(F.col("o_custkey").cast("string").alias("corp"), F.col("o_orderkey").cast("string").alias("receipt"), F.col("o_orderkey").alias("pos"))
    pool = o.unionByName(o.withColumn("pos", F.col("pos") + 10_000_000))
    k = F.col("pos")
    files = o.select("corp", "receipt", F.explode(F.when(k % 4 == 0, F.array(F.lit("body.html"), F.lit("original.pdf"))).when(k % 4 == 1, F.array(F.lit("body.html"))).when(k % 4 == 2, F.array(F.lit("original.pdf"), F.lit("meta.json"))).otherwise(F.array(F.lit("meta.json")))).alias("name"))
    return P.document_states(pool, files, 3)
