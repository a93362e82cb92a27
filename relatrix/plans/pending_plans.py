"""Queries over what a collection run is asked for: companies, endpoints, pages, receipts and lists; and over vectors' lengths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources import pending as P
from .registry import by_case, query, sql_case


@query("""WITH d AS (SELECT concat('D', CAST(n_nationkey AS VARCHAR)) AS corp, concat('s', CAST(n_nationkey AS VARCHAR)) AS stock, n_name AS name FROM nation WHERE n_nationkey < 5), k AS (SELECT concat('K', CAST(s_suppkey AS VARCHAR)) AS corp, concat('t', CAST(s_suppkey AS VARCHAR)) AS stock, s_name AS name FROM supplier WHERE s_suppkey % 2 = 0),
a AS (SELECT 0 AS kind, s_suppkey AS pos, CASE WHEN s_suppkey % 7 = 0 THEN concat('D', CAST(s_suppkey % 10 AS VARCHAR)) ELSE concat('K', CAST(s_suppkey % 50 AS VARCHAR)) END AS corp FROM supplier WHERE s_suppkey % 3 > 0),
ax AS (SELECT a.kind, a.pos, a.corp, coalesce(d.stock, k.stock, '') AS stock, coalesce(d.name, k.name, '?') AS name, CASE WHEN d.corp IS NOT NULL THEN concat('KR', d.corp) ELSE '' END AS isin FROM a LEFT JOIN d USING (corp) LEFT JOIN k USING (corp)),
bx AS (SELECT 1 AS kind, c_custkey AS pos, coalesce(d.corp, r.corp) AS corp, b.stock, coalesce(d.name, r.name) AS name, CASE WHEN d.corp IS NOT NULL THEN concat('KR', d.corp) ELSE '' END AS isin FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN concat('s', CAST(c_custkey % 10 AS VARCHAR)) ELSE concat('u', CAST(c_custkey AS VARCHAR)) END AS stock FROM customer) b LEFT JOIN d ON d.stock = b.stock LEFT JOIN (SELECT concat('R', CAST(c_custkey AS VARCHAR)) AS corp, concat('u', CAST(c_custkey AS VARCHAR)) AS stock, c_name AS name FROM customer WHERE c_custkey % 3 = 0) r ON r.stock = b.stock),
o AS (SELECT *, row_number() OVER (PARTITION BY corp ORDER BY kind, pos) AS rn FROM (SELECT * FROM ax UNION ALL SELECT * FROM bx WHERE corp IS NOT NULL))
SELECT CAST(row_number() OVER (ORDER BY kind, pos, corp) AS INT) AS place, corp, stock, name, isin FROM o WHERE rn = 1""")
def src24_companies(read):
    """Codes known by heart, known otherwise or not at all, with repeats; then stock codes that the register holds or not."""
    text = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    n, k, c = F.col("n_nationkey"), F.col("s_suppkey"), F.col("c_custkey")
    defaults = read("nation").where("n_nationkey < 5").select(text("D", n).alias("corp"), text("s", n).alias("stock"), F.col("n_name").alias("name"), F.concat(F.lit("KR"), text("D", n)).alias("isin"))
    known = read("supplier").where("s_suppkey % 2 = 0").select(text("K", k).alias("corp"), text("t", k).alias("stock"), F.col("s_name").alias("name"))
    register = read("customer").where("c_custkey % 3 = 0").select(text("u", c).alias("stock"), text("R", c).alias("corp"), F.col("c_name").alias("name"))
    codes = read("supplier").select(k.alias("pos"), F.when(k % 3 == 0, " ").when(k % 7 == 0, F.concat(F.lit(" "), text("D", k % 10))).otherwise(text("K", k % 50)).alias("corp"))
    stocks = read("customer").select(c.alias("pos"), F.when(c % 2 == 0, text("s", c % 10)).otherwise(text("u", c)).alias("stock"))
    return P.companies(codes, stocks, defaults, known, register)


_ENDPOINTS = [("list", "https://x", True, 0), ("company", " http://x ", True, 1), ("corpCode", "https://x", True, 2), ("empSttus", "https://x", True, 10), ("(none)", "https://x", False, None), ("외 3종", "https://x", False, None), ("", "https://x", False, None), ("dfOcr", "ftp://x", False, None), ("dfOcr", None, False, None)]


@query(f"""SELECT p_partkey AS id, {sql_case('p_partkey', [b for *_, b, _ in _ENDPOINTS])} AS callable, 'corp_code,bgn_de' AS required, CASE WHEN p_partkey % 2 = 0 THEN 'a' ELSE '' END AS optional,
CASE WHEN p_partkey % 4 > 0 THEN CAST({sql_case('p_partkey', [t for *_, t in _ENDPOINTS])} AS INT) END AS turn FROM part WHERE p_partkey % 5 > 0""")
def src25_src26_catalogue(read):
    k = F.col("p_partkey")
    rows = read("part").select(k.cast("string").alias("api"), F.when(k % 5 == 0, None).when(k % 4 == 0, "FTC").otherwise(" DS002 ").alias("category"), by_case("p_partkey", [e for e, *_ in _ENDPOINTS]).alias("endpoint"), F.lit("n").alias("name"), by_case("p_partkey", [u for _, u, *_ in _ENDPOINTS]).alias("url"), F.lit(" corp_code, crtfc_key,-, bgn_de ").alias("required"), F.when(k % 2 == 0, "a,,").otherwise(F.when(k % 3 == 0, "-")).alias("optional"))
    clean = P.catalogue(rows)
    turns = P.endpoint_order(clean).select("api", "turn")
    return clean.join(turns, "api", "left").select(F.col("api").cast("long").alias("id"), "callable", F.array_join("required", ",").alias("required"), F.array_join("optional", ",").alias("optional"), F.col("turn").cast("int").alias("turn"))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'no_data' WHEN 1 THEN 'rc_30' WHEN 2 THEN 'ok' ELSE 'ok' END AS status, o_orderkey % 4 > 1 AND (o_orderkey % 7 + 1) * CASE WHEN o_orderkey % 2 = 0 THEN 100 ELSE 50 END < o_custkey AS more FROM orders""")
def src27_pages(read):
    k = F.col("o_orderkey")
    state = P.page_state(F.when(k % 4 == 0, "97").when(k % 4 == 1, "30").otherwise("00"), F.col("o_custkey"), F.when(k % 2 == 1, 50).otherwise(F.when(k % 3 == 0, 0)), k % 7 + 1)
    return read("orders").select(k.alias("id"), state["status"].alias("status"), state["more"].alias("more"))


@query("""WITH r AS (SELECT concat('C', CAST(o_custkey AS VARCHAR)) AS corp, CAST(o_orderkey // 2 AS VARCHAR) AS receipt, min(o_orderkey) AS pos FROM orders WHERE o_orderkey % 4 < 2 AND o_orderkey % 9 > 0 GROUP BY ALL) SELECT corp, receipt, CAST(row_number() OVER (PARTITION BY corp ORDER BY pos, receipt) AS INT) AS place FROM r""")
def src28_receipt_pool(read):
    k = F.col("o_orderkey")
    report = F.when(k % 4 == 0, "[기재정정]사업보고서 (2024.12)").when(k % 4 == 1, "분기보고서").when(k % 4 == 2, "임원ㆍ주요주주특정증권등소유상황보고서")
    listed = read("orders").select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("corp"), k.alias("pos"), F.when(k % 9 == 0, "").otherwise(F.floor(k / 2).cast("string")).alias("receipt"), report.alias("report"))
    return P.receipt_pool(listed)


_BODIES = [(200, '[{"LIST_ID": "1"}, {"LIST_ID": "2"}]', "ok", 2), (200, '{"a": 1}', "ok", 1), (200, '{"err": "30"}', "err_30", None), (200, "<html>", "parse_error", None), (404, None, "http_404", None), (None, None, "pending", None), (200, "[]", "ok", 0)]


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS parent, CASE WHEN p_partkey % 5 = 0 THEN 'cached' ELSE {sql_case('p_partkey', [s for *_, s, _ in _BODIES])} END AS status, CASE WHEN p_partkey % 5 > 0 THEN CAST({sql_case('p_partkey', [n for *_, n in _BODIES])} AS INT) END AS lists FROM part")
def src31_list_states(read):
    own = F.col("p_partkey").cast("string").alias("parent")
    part = read("part")
    http = by_case("p_partkey", [h for h, *_ in _BODIES])
    responses = part.select(own, http.alias("http"), by_case("p_partkey", [b for _, b, *_ in _BODIES]).alias("body")).where("http is not null")
    return P.list_states(part.select(own), part.where("p_partkey % 5 = 0").select(own), responses)


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 4) AS before, 1.0::DOUBLE AS after, CAST(vec_id % 3 AS INT) AS broken FROM vectors""")
def s32_normalised(read):
    """The first vec_id mod 3 places of a copy are no numbers."""
    bad = F.transform("embedding", lambda x, i: F.when(i < F.col("vec_id") % 3, F.lit(float("nan")).cast("float")).otherwise(x))
    return read("vectors").select("vec_id", F.round(S.norm(F.col("embedding")), 4).alias("before"), F.round(S.norm(S.normalised(F.transform("embedding", lambda x: x * 3))), 4).alias("after"), S.broken(bad).alias("broken"))
