"""Queries over texts, vectors and pages (rows TXT, RET, SRC)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import retrieval as R
from ..sources import readers
from .registry import by_case, query, sql_case

_COS = "list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: CAST(p[1] AS DOUBLE) * p[2])) / (sqrt(list_sum(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(v.embedding, lambda x: CAST(x AS DOUBLE) * x))))"
_DENSE = f"""s AS (SELECT q.vec_id AS qid, v.vec_id, v.label, {_COS} AS score FROM vectors q CROSS JOIN vectors v WHERE q.vec_id % 50 = 0), d AS (SELECT qid, vec_id, label, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s)"""


def _queries(read):
    return read("vectors").where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))


@query(f"WITH {_DENSE} SELECT qid, vec_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM d WHERE rank <= 10")
def ret1_top7_dense(read):
    return R.dense_top_k(_queries(read), read("vectors"), 10).withColumn("score", F.round("score", 6))


@query(f"""WITH {_DENSE}, p AS (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY round(score, 9) DESC, vec_id) AS own, parts FROM (SELECT * FROM d WHERE rank <= 50) JOIN (SELECT qid, count(DISTINCT label) AS parts FROM d WHERE rank <= 50 GROUP BY qid) USING (qid)),
b AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY own <= greatest(1, floor(10 / parts)) DESC, round(score, 9) DESC, vec_id) AS r FROM p) SELECT qid, label, vec_id, round(score, 6) AS score, CAST(r AS INT) AS rank FROM b WHERE r <= 10""")
def ret5_balanced(read):
    pool = R.dense_top_k(_queries(read), read("vectors"), 50).drop("rank").join(read("vectors").select("vec_id", "label"), "vec_id")
    return R.balanced(pool, "label", 10).withColumn("score", F.round("score", 6))


_BM25 = """t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[가-힣a-zA-Z0-9]+')) AS term FROM chunks), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), dl AS (SELECT doc_id, len(regexp_extract_all(text, '[가-힣a-zA-Z0-9]+')) AS dl FROM chunks),
n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), raw AS (SELECT term, ln((SELECT n FROM n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf GROUP BY term), idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
asked AS (SELECT qid, term, count(*) AS times FROM (SELECT item_id AS qid, unnest(regexp_extract_all(text, '[가-힣a-zA-Z0-9]+')) AS term FROM benchmark) GROUP BY ALL),
sc AS (SELECT qid, tf.doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avgdl FROM n))) * times) AS score FROM asked JOIN idf USING (term) JOIN tf USING (term) JOIN dl ON dl.doc_id = tf.doc_id GROUP BY ALL),
bm AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc)"""


def _bm25(read, k):
    return R.bm25(read("benchmark").select(F.col("item_id").alias("qid"), "text"), read("chunks"), k)


@query(f"WITH {_BM25} SELECT qid, doc_id, round(score, 4) AS score, CAST(rank AS INT) AS rank FROM bm WHERE rank <= 10")
def ret2_bm25(read):
    return _bm25(read, 10).withColumn("score", F.round("score", 4))


@query(f"""WITH {_BM25}, a AS (SELECT qid, doc_id AS item, rank AS ra FROM bm WHERE rank <= 50), ov AS (SELECT qid, item, row_number() OVER (PARTITION BY qid ORDER BY n DESC, item) AS rb FROM (SELECT qid, tf.doc_id AS item, count(*) AS n FROM asked JOIN tf USING (term) GROUP BY ALL)), b AS (SELECT * FROM ov WHERE rb <= 50),
f AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.item, b.item) AS item, coalesce(1 / (60.0 + ra), 0) + coalesce(1 / (60.0 + rb), 0) AS score FROM a FULL OUTER JOIN b ON a.qid = b.qid AND a.item = b.item)
SELECT qid, item, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, item) AS r FROM f) WHERE r <= 10""")
def ret3_set5_fuse(read):
    words = R.dealt(read("chunks").select("doc_id", "text")).select(F.col("doc_id").alias("item"), F.explode(F.array_distinct(S.tokens(F.col("text")))).alias("term"))
    asked = read("benchmark").select(F.col("item_id").alias("qid"), F.explode(F.array_distinct(S.tokens(F.col("text")))).alias("term"))
    n = words.join(R.few(asked), "term").groupBy("qid", "item").agg(F.count("*").alias("n"))
    overlap = n.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("n"), "item"))).where("rank <= 50")
    return R.fuse(_bm25(read, 50).withColumnRenamed("doc_id", "item"), overlap).select("qid", "item", F.round("score", 9).alias("score"))


_SURFACES = [("line", "Licensed under the Apache License"), ("line", "All rights reserved"), ("mail", "@example.com"), ("line", "Licensed under the Apache License, Version 2.0")]


@query("""SELECT doc_id, etype, surface, CAST(sum(n) AS BIGINT) AS hits FROM (
SELECT doc_id, 'line' AS etype, 'All rights reserved' AS surface, (length(text) - length(replace(text, 'All rights reserved', ''))) // 19 AS n FROM chunks
UNION ALL SELECT doc_id, 'mail', '@example.com', (length(text) - length(replace(text, '@example.com', ''))) // 12 FROM chunks
UNION ALL SELECT doc_id, 'line', 'Licensed under the Apache License, Version 2.0', (length(text) - length(replace(text, 'Licensed under the Apache License, Version 2.0', ''))) // 46 FROM chunks
UNION ALL SELECT doc_id, 'line', 'Licensed under the Apache License', (length(replace(text, 'Licensed under the Apache License, Version 2.0', '')) - length(replace(replace(text, 'Licensed under the Apache License, Version 2.0', ''), 'Licensed under the Apache License', ''))) // 33 FROM chunks) WHERE n > 0 GROUP BY ALL""")
def txt1_win14_scan(read):
    return R.dictionary_scan(read("chunks"), _SURFACES).groupBy("doc_id", "etype", "surface").agg(F.count("*").alias("hits"))


@query()
def src14_s25_articles(read):
    return readers.articles(read("pages")).select("page_id", "url", "title", F.length("body").alias("n_chars"), F.md5("body").alias("digest"), S.url_date(F.col("url")).alias("day"))


@query("SELECT page_id, length(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS n FROM pages")
def s26_strip_tags(read):
    return read("pages").select("page_id", F.length(S.strip_tags(F.col("html"))).cast("long").alias("n"))


_CODES = [("000", "ok"), ("013", "no_data"), ("010", "key_error"), ("011", "key_error"), ("020", "rate_limit"), ("100", "bad_param"), ("101", "bad_param"), ("800", "maintenance"), ("900", "unknown_error"), ("021", "unknown_error"), (None, "unknown_error"), ("http_404", "http_error"), ("parse_error", "parse_error")]


@query(f"SELECT CASE WHEN page_id % 17 = 0 THEN 'ok' ELSE {sql_case('page_id', [b for _, b in _CODES])} END AS status, count(*) AS n FROM pages GROUP BY ALL")
def src32_classify(read):
    status = readers.classify(by_case("page_id", [a for a, _ in _CODES]), F.col("page_id") % 17 == 0)
    return read("pages").groupBy(status.alias("status")).agg(F.count("*").alias("n"))
