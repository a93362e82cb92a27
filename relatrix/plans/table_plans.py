"""Queries over sentences from table rows (rows TXT13 to TXT16, TXT5). Values meet NULLs, dashes and blanks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import records as R
from ..functions import table_sentences as T
from .registry import query

_U = "(공시되지 않음)"
#: A quantity in every form: key mod 5 gives NULL, a dash, blanks, or a number.
_Q = "CASE {k} % 5 WHEN 0 THEN '(공시되지 않음)' WHEN 1 THEN '(공시되지 않음)' WHEN 2 THEN '(공시되지 않음)' ELSE CAST({k} AS VARCHAR) END"


def _quantity(key: Column) -> Column:
    return F.when(key % 5 == 0, None).when(key % 5 == 1, "-").when(key % 5 == 2, "  ").otherwise(F.concat(F.lit(" "), key.cast("string")))


def _out(rows: DataFrame, sentences: Column) -> DataFrame:
    return rows.select("id", F.explode(sentences).alias("s")).select("id", "s.variant", "s.content")


def _suppliers(read) -> DataFrame:
    return read("supplier").select("*", F.col("s_suppkey").alias("id"), F.lit("회사").alias("corp"), F.col("s_suppkey").cast("string").alias("code"), F.lit(2024).alias("year"))


@query(f"""WITH s AS (SELECT s_suppkey AS id, s_name, CASE s_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE CAST(s_nationkey AS VARCHAR) END AS v FROM supplier)
SELECT id, 'full' AS variant, concat('회사(', CAST(id AS VARCHAR), ')의 2024년 재무지표 ''', s_name, '''은 ', coalesce(v, '{_U}'), '.') AS content FROM s UNION ALL SELECT id, 'key', concat('회사 2024년 ', s_name, ' ', v) FROM s WHERE trim(v) <> ''""")
def txt13_index(read):
    s = _suppliers(read)
    k = F.col("id") % 3
    return _out(s, T.index_sentences(F.col("corp"), F.col("code"), F.col("year"), F.col("s_name"), F.when(k == 1, " ").when(k == 2, F.col("s_nationkey").cast("string"))))


@query("""SELECT s_suppkey AS id, 'full' AS variant, concat('회사(', CAST(s_suppkey AS VARCHAR), ')의 2024년 사업보고서 회계감사인은 ', CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE '?' END, '이며, 감사의견은 ''적정''이다. 강조사항: ', CASE WHEN s_suppkey % 3 = 0 THEN '계속기업' ELSE '없음' END, '. 감사보고서 특기사항: 없음. 핵심감사사항(KAM): ', CASE WHEN s_suppkey % 3 = 1 THEN '수익' ELSE '공시되지 않음' END) AS content FROM supplier""")
def txt13_audit(read):
    s, k = _suppliers(read), F.col("id")
    return _out(s, T.audit_sentences(F.col("corp"), F.col("code"), F.col("year"), F.when(k % 2 == 0, F.col("s_name")), F.lit("적정"), F.when(k % 3 == 1, "수익").when(k % 3 == 2, ""), F.when(k % 3 == 0, "계속기업").when(k % 3 == 1, ""), F.lit(None).cast("string")))


@query("""SELECT s_suppkey AS id, 'full' AS variant, concat('회사(', CAST(s_suppkey AS VARCHAR), ') 2024년 임원 ''', s_name, '''(남, 1960.01생)은 이사(사내이사, 상근). 담당: . 주요 경력: ', repeat('가', least(200, CAST(s_suppkey * 30 AS BIGINT))), '. 최대주주와의 관계: ', CASE WHEN s_suppkey % 2 = 0 THEN '친인척' ELSE '해당 없음' END, '. 임기만료: ', CASE WHEN s_suppkey % 3 = 0 THEN '2026-03-20' WHEN s_suppkey % 3 = 1 THEN '' ELSE '미정' END, '.') AS content FROM supplier""")
def txt13_officer(read):
    s, k = _suppliers(read), F.col("id")
    f = {"nm": F.col("s_name"), "sex": F.lit("남"), "birth": F.lit("1960.01"), "post": F.lit("이사"), "registered": F.lit("사내이사"), "full_time": F.lit("상근"), "duty": F.lit(None).cast("string"), "career": F.repeat(F.lit("가"), (k * 30).cast("int")), "relation": F.when(k % 2 == 0, "친인척").when(k % 4 == 1, ""), "until": F.when(k % 3 == 0, "2026.03.20").when(k % 3 == 2, "미정")}
    return _out(s, T.officer_sentences(F.col("corp"), F.col("code"), F.col("year"), f))


@query(f"""SELECT s_suppkey AS id, 'full' AS variant, concat('회사(', CAST(s_suppkey AS VARCHAR), ') 2024년 최대주주 ''', s_name, '''(관계: 본인) 보통주 보유주식 기초 ', {_Q.format(k='s_suppkey')}, ' (', {_Q.format(k='(s_suppkey + 1)')}, '%) → 기말 ', {_Q.format(k='(s_suppkey + 2)')}, ' (', {_Q.format(k='(s_suppkey + 3)')}, '%).') AS content FROM supplier""")
def txt14_holder(read):
    q = [_quantity(F.col("id") + i) for i in range(4)]
    return _out(_suppliers(read), T.holder_sentences(F.col("corp"), F.col("code"), F.col("year"), F.col("s_name"), F.lit("본인"), F.lit("보통주"), *q))


@query(f"""WITH s AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN '우선주' ELSE '보통주' END AS k, {_Q.format(k='s_suppkey')} AS a, {_Q.format(k='(s_suppkey + 1)')} AS b, {_Q.format(k='(s_suppkey + 2)')} AS c FROM supplier)
SELECT id, 'full' AS variant, concat('회사 2024년 ', k, ' 항목 ''배당금'': 당기 ', a, ', 전기 ', b, ', 전전기 ', c, '.') AS content FROM s UNION ALL SELECT id, 'comparison', concat('회사 ', k, ' ''배당금'' 3기 추이: ', c, ' → ', b, ' → ', a, '.') FROM s""")
def txt14_dividend(read):
    q = [_quantity(F.col("id") + i) for i in range(3)]
    return _out(_suppliers(read), T.dividend_sentences(F.col("corp"), F.col("year"), F.lit("배당금"), F.when(F.col("id") % 2 == 0, "우선주"), *q))


@query(f"""WITH s AS (SELECT s_suppkey AS id, {_Q.format(k='s_suppkey')} AS a, {_Q.format(k='(s_suppkey + 5)')} AS b FROM supplier)
SELECT id, 'full' AS variant, concat('회사 2024년 자기주식 : 기초 ', a, ' → 취득 ', b, ', 처분 {_U} → 기말 ', a, '.') AS content FROM s WHERE a <> '{_U}'""")
def txt14_treasury(read):
    a, b = _quantity(F.col("id")), _quantity(F.col("id") + 5)
    return _out(_suppliers(read), T.treasury_sentences(F.col("corp"), F.col("year"), F.lit(None).cast("string"), a, b, F.lit("—"), a))


_WON = "CASE WHEN {v} >= 10000 THEN concat(regexp_replace(CAST({v} AS VARCHAR), '([0-9]+)([0-9]{{3}})$', '\\1,\\2'), '원 (약 ', printf('%.1f', {v} / 1e4), '만원)') WHEN {v} >= 1000 THEN concat(regexp_replace(CAST({v} AS VARCHAR), '([0-9]+)([0-9]{{3}})$', '\\1,\\2'), '원') ELSE concat(CAST({v} AS VARCHAR), '원') END"


@query(f"""WITH s AS (SELECT o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders)
SELECT id, 'full' AS variant, concat('회사 2024년 타법인 출자 — ''?'' (목적: 일반투자). 기말 잔액 ', CAST(id AS VARCHAR), '주 (%), 장부가액 ', CASE WHEN id % 3 = 0 THEN '{_U}' ELSE {_WON.format(v='v')} END, '.') AS content FROM s""")
def txt15_investment(read):
    book = F.when(F.col("o_orderkey") % 3 == 0, "-").otherwise(F.format_number(F.floor("o_totalprice"), 0))
    rows = read("orders").select(F.col("o_orderkey").alias("id"), F.lit("회사").alias("corp"), F.lit(2024).alias("year"), book.alias("book"))
    none = F.lit(None).cast("string")
    return _out(rows, T.investment_sentences(F.col("corp"), F.col("year"), none, F.lit("일반투자"), F.col("id"), none, F.col("book")))


@query("SELECT c_custkey AS id, 'full' AS variant, concat('회사 2024년 직원 현황 (', CASE WHEN c_custkey % 2 = 0 THEN '여' ELSE '' END, ', 부문 ', c_mktsegment, '): 정규직 ', CAST(c_custkey AS VARCHAR), ', 계약직 , 평균 근속 ', CAST(c_nationkey AS VARCHAR), '년.') AS content FROM customer")
def txt15_employee(read):
    rows = read("customer").select("*", F.col("c_custkey").alias("id"))
    return _out(rows, T.employee_sentences(F.lit("회사"), F.lit(2024), F.when(F.col("id") % 2 == 0, "여"), F.col("c_mktsegment"), F.col("id"), F.lit(None).cast("string"), F.col("c_nationkey")))


@query(f"""WITH s AS (SELECT o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders)
SELECT id, 'full' AS variant, concat('회사 2024년 보수 — '''' 대표: 총액 ', {_WON.format(v='v')}, CASE WHEN id % 2 = 0 THEN concat('; 평균 ', {_WON.format(v='v')}) ELSE '' END, '.') AS content FROM s""")
def txt15_pay(read):
    v = F.floor("o_totalprice").cast("string")
    rows = read("orders").select(F.col("o_orderkey").alias("id"), v.alias("v"), F.when(F.col("o_orderkey") % 2 == 0, v).when(F.col("o_orderkey") % 4 == 1, "").alias("mean"))
    return _out(rows, T.pay_sentences(F.lit("회사"), F.lit(2024), F.lit(None).cast("string"), F.lit("대표"), F.col("v"), F.col("mean")))


def _fields() -> Column:
    names = F.array(*[F.lit(x) for x in ("rcept_no", "nm", "nation", "blank")])
    values = F.array(F.lit("1"), F.when(F.col("id") % 4 != 0, F.col("s_name")), F.when(F.col("id") % 2 != 0, F.col("s_nationkey").cast("string")), F.lit("-"))
    return R.flat_fields(names, values, {"nm": "상호", "nation": "국가"}, ("rcept_no",))


_FLAT = "concat_ws(', ', CASE WHEN s_suppkey % 4 <> 0 THEN concat('상호=', s_name) END, CASE WHEN s_suppkey % 2 <> 0 THEN concat('국가=', CAST(s_nationkey AS VARCHAR)) END)"


@query(f"""SELECT s_suppkey AS id, 'full' AS variant, concat('회사(', CAST(s_suppkey AS VARCHAR), ')는 2025-03-11 유상증자 결정. 세부: ', {_FLAT}) AS content FROM supplier""")
def txt16_event(read):
    return _out(_suppliers(read), T.event_sentences(F.col("corp"), F.col("code"), F.lit("20250311"), "유상증자", _fields()))


@query(f"""SELECT s_suppkey AS id, 'full' AS variant, concat('회사(', CAST(s_suppkey AS VARCHAR), ') 2024년 회사채: ', {_FLAT}) AS content FROM supplier WHERE {_FLAT} <> ''""")
def txt16_table(read):
    return _out(_suppliers(read), T.table_sentences(F.col("corp"), F.col("code"), F.col("year"), "회사채", _fields()))
