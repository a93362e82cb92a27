"""Queries over scalar functions and projections (rows S, PRJ, FIL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from .registry import by_case, query, sql_case


@query("""SELECT c_custkey AS id, md5(concat('corp', '|', c_name, '|', CAST(c_nationkey AS VARCHAR)))[1:16] AS h16, regexp_replace(md5(c_name), '(.{8})(.{4})(.{4})(.{4})(.{12})', '\\1-\\2-\\3-\\4-\\5') AS uuid,
sha1(trim(c_name))[1:16] AS news, sha1(concat('news:', sha1(trim(c_name))[1:16]))[1:16] AS news_doc, concat('X', upper(md5(concat('xorg|', c_name))[1:7])) AS code FROM customer""")
def s1_s7_ids(read):
    name = F.col("c_name")
    return read("customer").select(F.col("c_custkey").alias("id"), S.hash16(F.lit("corp"), name, F.col("c_nationkey")).alias("h16"), S.uuid_from_id(name).alias("uuid"), S.news_id(name).alias("news"), S.news_doc_id(name).alias("news_doc"), S.synthetic_code(name).alias("code"))


@query("""SELECT s_suppkey AS id, trim(regexp_replace(concat(s_name, '  Trading'), '\\s+', ' ', 'g')) AS canonical, lower(regexp_replace(concat(s_name, '  Trading'), '[^0-9A-Za-z_]+', '', 'g')) AS aggressive, regexp_replace(concat(s_name, ' (Co)'), '\\s|\\(Co\\)', '', 'g') AS holder FROM supplier""")
def s8_s10_names(read):
    raw = F.concat(F.lit("㈜ "), F.col("s_name"), F.lit("  Trading Co., Ltd."))
    return read("supplier").select(F.col("s_suppkey").alias("id"), S.canonical_name(raw).alias("canonical"), S.aggressive_name(raw).alias("aggressive"), S.holder_key(F.concat("s_name", F.lit(" (Co)"))).alias("holder"))


#: Forms of an amount whose value is the same in every row, and that value.
_AMOUNTS = [("2024-01-01", None), ("1-2", None), ("12(3", None), ("▲5", None), ("△-1,234", -1234), ("(1 234.9)", -1234), ("-(5)", -5), ("—", None), ("", None), (" 1.5e3 ", 1500), ("12d", None), ("(-7)", 7), ("+8", 8)]


@query(f"""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 < 3 THEN -CAST(floor(o_totalprice) AS BIGINT) ELSE CAST(floor(o_totalprice) AS BIGINT) END AS amount, {sql_case('o_orderkey', [b for _, b in _AMOUNTS])} AS form, CAST(o_orderkey % 100 AS DOUBLE) / 10 AS rate FROM orders""")
def s11_s14_amounts(read):
    n = F.format_number(F.floor("o_totalprice"), 0)
    k = F.col("o_orderkey") % 5
    raw = F.when(k == 0, "-").when(k == 1, F.concat(F.lit("△"), n)).when(k == 2, F.concat(F.lit("("), n, F.lit(")"))).otherwise(n)
    rate = F.concat((F.col("o_orderkey") % 100 / 10).cast("string"), F.lit("%"))
    return read("orders").select(F.col("o_orderkey").alias("id"), S.parse_amount(raw).alias("amount"), S.parse_amount(by_case("o_orderkey", [a for a, _ in _AMOUNTS])).alias("form"), S.parse_rate(rate).alias("rate"))


@query("""SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS loose, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m') END AS shown, CASE WHEN year(o_orderdate) >= 2000 THEN CAST(o_orderdate AS DATE) END AS url_day FROM orders""")
def s15_s18_s38_dates(read):
    d = F.col("o_orderdate")
    k = F.col("o_orderkey") % 3
    raw = F.when(k == 0, F.date_format(d, "yyyyMMdd")).when(k == 1, F.date_format(d, "yyyy.M.d")).otherwise(F.date_format(d, "yyyy/MM/dd"))
    solid = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(d, "yyyyMMdd")).otherwise(F.date_format(d, "yyyyMM"))
    url = F.concat(F.lit("https://n.example/"), F.date_format(d, "yyyy/MM/dd"), F.lit("/a"))
    return read("orders").select(F.col("o_orderkey").alias("id"), S.parse_date_loose(raw).alias("loose"), S.format_time(solid).alias("shown"), S.url_date(url).alias("url_day"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN concat(printf('%.1f', (p_partkey + 1) * 1e12 / 1e12), '조') WHEN p_partkey % 3 = 1 AND p_partkey >= 9999 THEN concat(printf('%.1f', (p_partkey + 1) * 1e8 / 1e12), '조') WHEN p_partkey % 3 = 1 THEN concat(printf('%.0f', (p_partkey + 1) * 1e8 / 1e8), '억') ELSE concat(CAST(p_partkey + 1 AS VARCHAR), '원') END AS label  FROM part""")
def prj8_s20_money(read):
    k = F.col("p_partkey") % 3
    won = (F.col("p_partkey") + 1) * F.when(k == 0, 1e12).when(k == 1, 1e8).otherwise(1.0)
    return read("part").select(F.col("p_partkey").alias("id"), S.money_label(won).alias("label"))


@query("""SELECT doc_id, corp, strftime(ts, '%Y-%m-%d') AS day, json_extract_string(metadata, '$.k') AS k, substring(coalesce(metadata, ''), 1, 6) AS cut FROM docs""")
def prj4_prj7_metadata(read):
    return read("docs").select("doc_id", "corp", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.get_json_object("metadata", "$.k").alias("k"), F.substring(F.coalesce("metadata", F.lit("")), 1, 6).alias("cut"))


@query("""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[가-힣a-zA-Z0-9]+') AS w FROM chunks) SELECT doc_id, CAST(len(w) AS INT) AS n, CAST(len(list_distinct(w)) AS INT) AS kinds, md5(array_to_string(w, ' ')) AS digest FROM t""")
def s27_tokens(read):
    return read("chunks").withColumn("w", S.tokens(F.col("text"))).select("doc_id", F.size("w").alias("n"), F.size(F.array_distinct("w")).alias("kinds"), F.md5(F.array_join("w", " ")).alias("digest"))


@query("""WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(text, '[가-힣a-zA-Z0-9]+')) AS w FROM conversations), p AS (SELECT a.conv_id, a.turn, a.w AS x, b.w AS y FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1)
SELECT conv_id, turn, round(CASE WHEN len(x) > 0 THEN len(list_intersect(x, y)) / CAST(len(x) AS DOUBLE) ELSE 0 END, 6) AS match, round(CASE WHEN len(list_distinct(list_concat(x, y))) > 0 THEN 1 - len(list_intersect(x, y)) / CAST(len(list_distinct(list_concat(x, y))) AS DOUBLE) ELSE 0 END, 6) AS difference FROM p""")
def s28_txt10_match_rates(read):
    c = read("conversations").select("conv_id", "turn", "text")
    prev = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    return c.join(prev, ["conv_id", "turn"]).select("conv_id", "turn", F.round(S.word_match_rate(F.col("text"), F.col("before")), 6).alias("match"), F.round(S.token_difference(F.col("text"), F.col("before")), 6).alias("difference"))


@query("""SELECT v.label, count(*) AS n, round(avg(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)))), 6) AS norm FROM vectors v GROUP BY v.label""")
def s32_norms(read):
    return read("vectors").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(S.norm(F.col("embedding"))), 6).alias("norm"))


@query("""SELECT c_custkey AS id, array_to_string(list_distinct_ordered, '/') AS forms FROM (SELECT c_custkey, [concat(c_name, ' Group'), replace(concat(c_name, ' Group'), ' ', ''), concat('㈜', c_name, ' Group'), concat(c_name, ' Group(주)')] AS list_distinct_ordered FROM customer)""")
def s39_alias_forms(read):
    return read("customer").select(F.col("c_custkey").alias("id"), F.array_join(S.alias_forms(F.concat("c_name", F.lit(" Group"))), "/").alias("forms"))


@query()
def fil10_noise(read):
    words = read("chunks").select("doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("w"))
    return words.where(S.noisy_surface(F.col("w"))).groupBy("doc_id").agg(F.count("*").alias("noisy"))


@query()
def s24_normal_text(read):
    return read("chunks").select("doc_id", F.md5(S.normal_text(F.col("text"))).alias("digest"), F.length(S.normal_text(F.col("text"))).alias("n"))
