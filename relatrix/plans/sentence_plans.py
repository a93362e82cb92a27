"""Queries over sentences made from rows, and over questions and amounts in texts (rows TXT12, TXT18, S22)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import endpoints as N
from ..functions import sentences as T
from .registry import by_case, query, sql_case

_SHOWN = """CASE WHEN {v} IS NULL THEN '(공시되지 않음)' ELSE concat(format('{{:,}}', {v}), '원', CASE WHEN {v} >= 100000000 THEN concat(' (약 ', printf('%.1f', {v} / 1e8), '억원)')
  WHEN {v} >= 10000 THEN concat(' (약 ', printf('%.1f', {v} / 1e4), '만원)') ELSE '' END) END"""
_CHANGE = """CASE WHEN {a} IS NULL OR {b} IS NULL OR {b} = 0 THEN '전년 자료 없음' ELSE concat(printf('%.1f', abs(CAST({a} - {b} AS DOUBLE) / abs({b}) * 100)), CASE WHEN {a} >= {b} THEN '% 증가' ELSE '% 감소' END) END"""


@query(f"""WITH s AS (SELECT corp, fs, account, year, CAST(sum(value) AS BIGINT) AS v FROM metrics GROUP BY ALL),
p AS (SELECT s.*, lag(v, 1) OVER w AS v1, lag(v, 2) OVER w AS v2 FROM s WINDOW w AS (PARTITION BY corp, fs, account ORDER BY year)),
t AS (SELECT corp, fs, account, year, v, v2, CASE WHEN fs = 'CFS' THEN '연결' ELSE '별도' END AS kind, {_SHOWN.format(v="v")} AS a, {_SHOWN.format(v="v1")} AS b, {_SHOWN.format(v="v2")} AS c, {_CHANGE.format(a="v", b="v1")} AS y, {_CHANGE.format(a="v1", b="v2")} AS y2 FROM p)
SELECT corp, fs, account, year, 'full' AS variant, concat(corp, '(', upper(corp), ')의 ', year, '년 사업보고서 ', kind, '재무제표 ', CASE account WHEN '1-URGENT' THEN '손익계산서' WHEN '2-HIGH' THEN '재무상태표' ELSE '기타' END, ' 항목 ''', account, '''(account_id=', CASE account WHEN '1-URGENT' THEN 'ifrs-full_Revenue' WHEN '2-HIGH' THEN 'ifrs-full_Assets' ELSE '' END, ')은 ', a, '이며, 전년 ', b, ' 대비 ', y, '.') AS content FROM t
UNION ALL SELECT corp, fs, account, year, 'key', concat(corp, ' ', year, '년 ', kind, ' ', account, ' ', format('{{:,}}', v), '원') FROM t WHERE account IN ('1-URGENT', '2-HIGH')
UNION ALL SELECT corp, fs, account, year, 'comparison', concat(corp, ' ', kind, ' ', account, ' 3기 추이: ', c, ' → ', b, ' → ', a, ' (직전년 ', y2, ', 당기년 ', y, ').') FROM t WHERE v2 IS NOT NULL""")
def txt12_account_sentences(read):
    key = ["corp", "fs", "account"]
    w = Window.partitionBy(*key).orderBy("year")
    rows = read("metrics").groupBy(*key, "year").agg(F.sum("value").alias("v"))
    rows = rows.withColumns({"v1": F.lag("v", 1).over(w), "v2": F.lag("v", 2).over(w)})
    of = lambda a, b: F.when(F.col("account") == "1-URGENT", a).when(F.col("account") == "2-HIGH", b)
    said = T.account_sentences(F.col("corp"), F.upper("corp"), F.col("fs"), of("IS", "BS"), F.lit("기타"), F.col("account"), of("ifrs-full_Revenue", "ifrs-full_Assets"), F.col("year"), F.col("v"), F.col("v1"), F.col("v2"))
    return rows.select(*key, "year", F.inline(said))


@query(f"""WITH o AS (SELECT o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) AS v, CAST(floor(o_totalprice) AS BIGINT) * 1000 AS u FROM orders)
SELECT id, concat('매출 ', {_SHOWN.format(v="u")}, ', 비용 ', v, '원(약 1), 번호 ', id % 1000, '원 끝') AS content FROM o""")
def s22_amounts(read):
    v = F.floor("o_totalprice")
    text = F.concat(F.lit("매출 "), F.format_number(v * 1000, 0), F.lit("원, 비용 "), v.cast("string"), F.lit("원(약 1), 번호 "), (F.col("o_orderkey") % 1000).cast("string"), F.lit("원 끝"))
    return read("orders").select(F.col("o_orderkey").alias("id"), T.enrich_amounts(text).alias("content"))


@query("""SELECT c_custkey AS id, least(a.n_nationkey, b.n_nationkey) AS low, greatest(a.n_nationkey, b.n_nationkey) AS high, CAST(1990 + c_custkey % 30 AS INT) AS year, c_mktsegment AS indicator
FROM customer JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_nationkey = c_custkey % 31 WHERE c_custkey % 7 <> 0""")
def txt18_comparisons(read):
    nation = read("nation").select("n_nationkey", "n_name")
    asked = read("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).drop("n_nationkey").withColumnRenamed("n_name", "one")
    asked = asked.join(nation, F.col("c_custkey") % 31 == F.col("n_nationkey"), "left")
    join = F.when(F.col("c_custkey") % 7 == 0, " and ").otherwise(" vs ")
    text = F.concat(F.col("one"), join, F.coalesce("n_name", F.lit("nobody")), F.lit(" "), (1990 + F.col("c_custkey") % 30).cast("string"), F.lit("년 "), F.col("c_mktsegment"))
    q = asked.select(F.col("c_custkey").alias("id"), T.comparison_question(text).alias("q")).where("q IS NOT NULL").select("id", "q.*")
    names = read("nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("code"))
    first, second = names.toDF("first", "a"), names.toDF("second", "b")
    return q.join(first, "first").join(second, "second").select("id", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"), "year", "indicator")


#: Fields of a row of any endpoint with sentences of its own, and of a decision or another table; P stands for a text of the row.
_OWN = {
    "rcept_no": "20240305000001", "corp_code": "C1", "bsns_year": "2024", "fs_div": "CFS", "sj_div": "IS", "account_nm": "매출액", "account_id": "ifrs-full_Revenue", "thstrm_amount": "1,200", "frmtrm_amount": "1,000", "bfefrmtrm_amount": "-",
    "idx_nm": "P", "idx_val": "3.5", "adtor": "P", "adt_opinion": "적정", "emphs_matter": "", "nm": "P", "sexdstn": "여", "birth_ym": "1970.01", "ofcps": "이사", "rgist_exctv_at": "사내", "fte_at": "상근", "chrg_job": "재무", "main_career": "경력", "tenure_end_on": "2026.03.01",
    "relate": "본인", "stock_knd": "보통주", "bsis_posesn_stock_co": "10", "bsis_posesn_stock_qota_rt": "1.0", "trmend_posesn_stock_co": " - ", "trmend_posesn_stock_qota_rt": "2.0", "se": "P", "thstrm": "5", "frmtrm": "-", "lwfr": "3",
    "bsis_qy": "-", "change_qy_acqs": "7", "trmend_qy": "7", "inv_prm": "P", "invstmnt_purps": "경영", "trmend_blce_qy": "9", "trmend_blce_qota_rt": "50", "trmend_blce_acntbk_amount": "12,000,000", "fo_bbm": "P", "rgllbr_co": "3", "cnttk_co": "1", "avrg_cnwk_sdytrn": "4.5", "mendng_totamt": "20,000",
}
_DECISION = {"rcept_no": "20240305000001", "corp_code": "C1", "corp_name": "x", "corp_cls": "Y", "rcept_dt": "20240305", "nm": "P", "other": "-"}
_OTHER = {"rcept_no": "20240305000001", "corp_code": "C1", "corp_name": "x", "corp_cls": "Y", "stlm_dt": "2023-12-31", "nm": "P", "empty": ""}
#: What they become, by kind.
_SENTENCES = {
    "account": "full:회사(C1)의 2024년 사업보고서 연결재무제표 손익계산서 항목 '매출액'(account_id=ifrs-full_Revenue)은 1,200원이며, 전년 1,000원 대비 20.0% 증가.|key:회사 2024년 연결 매출액 1,200원",
    "index": "full:회사(C1)의 2024년 재무지표 'P'은 3.5.|key:회사 2024년 P 3.5",
    "audit": "full:회사(C1)의 2024년 사업보고서 회계감사인은 P이며, 감사의견은 '적정'이다. 강조사항: 없음. 감사보고서 특기사항: 없음. 핵심감사사항(KAM): 공시되지 않음",
    "officer": "full:회사(C1) 2024년 임원 'P'(여, 1970.01생)은 이사(사내, 상근). 담당: 재무. 주요 경력: 경력. 최대주주와의 관계: 해당 없음. 임기만료: 2026-03-01.",
    "holder": "full:회사(C1) 2024년 최대주주 'P'(관계: 본인) 보통주 보유주식 기초 10 (1.0%) → 기말 (공시되지 않음) (2.0%).",
    "dividend": "full:회사 2024년 보통주 항목 'P': 당기 5, 전기 (공시되지 않음), 전전기 3.|comparison:회사 보통주 'P' 3기 추이: 3 → (공시되지 않음) → 5.",
    "treasury": "full:회사 2024년 자기주식 보통주: 기초 (공시되지 않음) → 취득 7, 처분 (공시되지 않음) → 기말 7.",
    "investment": "full:회사 2024년 타법인 출자 — 'P' (목적: 경영). 기말 잔액 9주 (50%), 장부가액 12,000,000원 (약 1200.0만원).",
    "employee": "full:회사 2024년 직원 현황 (여, 부문 P): 정규직 3, 계약직 1, 평균 근속 4.5년.",
    "pay": "full:회사 2024년 보수 — 'P' 이사: 총액 20,000원 (약 2.0만원).",
}
_ENDPOINTS = [
    *((e, _SENTENCES[kind], N.SECTIONS[kind], _OWN) for kind, names in N.KINDS.items() for e in names),
    *((e, f"full:회사(C1)는 2024-03-05 {label} 결정. 세부: 상호=P", place, _DECISION) for e, (label, place) in N.EVENTS.items()),
    *((e, f"full:회사(C1) 2023년 {label}: 상호=P", place, _OTHER) for e, (label, place) in N.TABLES.items()),
    ("unknown", None, None, _OWN),
]


@query(f"SELECT o_orderkey AS id, {sql_case('o_orderkey', [e for e, *_ in _ENDPOINTS])} AS endpoint, {sql_case('o_orderkey', [s for _, _, s, _ in _ENDPOINTS])} AS section, replace({sql_case('o_orderkey', [w for _, w, _, _ in _ENDPOINTS])}, 'P', o_orderpriority) AS said FROM orders")
def txt4_endpoints(read):
    """Every endpoint that is read, and one that is not."""
    made = lambda f: F.create_map(*[x for k, v in f.items() for x in (F.lit(k), F.col("o_orderpriority") if v == "P" else F.lit(v))])
    kinds = [_OWN, _DECISION, _OTHER]
    which = by_case("o_orderkey", [kinds.index(f) for *_, f in _ENDPOINTS])
    item = F.when(which == 0, made(_OWN)).when(which == 1, made(_DECISION)).otherwise(made(_OTHER))
    rows = read("orders").select(F.col("o_orderkey").alias("id"), by_case("o_orderkey", [e for e, *_ in _ENDPOINTS]).alias("endpoint"), item.alias("item"))
    said = N.endpoint_sentences(F.lit("회사"), F.col("endpoint"), F.col("item"), {"nm": "상호"})
    return rows.select("id", "endpoint", N.section(F.col("endpoint")).alias("section"), F.array_join(F.transform(said, lambda x: F.concat(x["variant"], F.lit(":"), x["content"])), "|").alias("said"))
