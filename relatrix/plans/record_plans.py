"""Queries over functions of collected records. Expected values are written out, one for each raw form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records as R
from ..functions import scalars as S
from .registry import by_case, query, sql_case

_NAMES = [("삼성전자(주)", "삼성전자", "삼성전자"), ("주식회사 카카오", "카카오", "카카오"), ("㈜ LG  화학", "LG 화학", "lg화학"), ("Micron Technology, Inc.", "Micron Technology,", "microntechnology"), ("Infineon Co., Ltd.", "Infineon", "infineon"), ("SK hynix Corp", "SK hynix", "skhynix"), ("株式会社 ソニー", "ソニー", "ソニー"), (None, "", ""), ("A-B_c ltd", "A-B_c", "ab_c")]
_DATES = [("1977.01.01", "1977-01-01", "1977-01-01"), ("20250311", "2025-03-11", "2025-03-11"), ("2025-3-7 외", "2025-03-07", "2025-3-7 외"), (" 2025/12/31 23:00", "2025-12-31", "2025-12-31"), ("2025. 3. 11", "2025-03-11", "2025. 3. 11"), ("미정", None, "미정"), (None, None, ""), ("2025031", None, "2025031"), ("20250311-1", None, "2025-03-11")]


@query(f"SELECT o_orderkey AS id, {sql_case('o_orderkey', [b for _, b, _ in _NAMES])} AS canonical, {sql_case('o_orderkey', [c for _, _, c in _NAMES])} AS aggressive FROM orders")
def s8_s9_name_forms(read):
    name = by_case("o_orderkey", [a for a, _, _ in _NAMES])
    return read("orders").select(F.col("o_orderkey").alias("id"), S.canonical_name(name).alias("canonical"), S.aggressive_name(name).alias("aggressive"))


@query(f"SELECT o_orderkey AS id, {sql_case('o_orderkey', [b for _, b, _ in _DATES])} AS loose, {sql_case('o_orderkey', [c for _, _, c in _DATES])} AS prefix FROM orders")
def s15_s16_date_forms(read):
    raw = by_case("o_orderkey", [a for a, _, _ in _DATES])
    return read("orders").select(F.col("o_orderkey").alias("id"), S.parse_date_loose(raw).alias("loose"), R.normalize_date(raw).alias("prefix"))


_TEXTS = [("​삼성(三星)전자 주식", "삼성전자주식"), ("머리\n- 12 -\n본문  \t줄\n\n\n\n끝", "머리\n본문 줄\n\n끝"), ("p. 7\n P.8 \n123\n12345\n글", "12345\n글"), ("  (株式; 주식) 글 (한글) \n  ", "글 (한글)"), ("", ""), (None, "")]
_BLANKS = [("", True), (" - ", True), ("—", True), ("None", True), ("null", True), ("N/A", True), (None, True), ("0", False), ("해당없음", False), ("n/a", False)]


@query(f"SELECT o_orderkey AS id, {sql_case('o_orderkey', [b for _, b in _TEXTS])} AS content, {sql_case('o_orderkey', [b for _, b in _BLANKS])} AS blank FROM orders")
def s24_s29_text_forms(read):
    return read("orders").select(F.col("o_orderkey").alias("id"), S.normal_text(by_case("o_orderkey", [a for a, _ in _TEXTS])).alias("content"), S.is_blank(by_case("o_orderkey", [a for a, _ in _BLANKS])).alias("blank"))


_INTS = [("1,234", 1234), ("(1,234)", -1234), ("-5", -5), ("△7", None), ("-", None), ("—", None), (" ", None), (None, None), ("12.9", 12), ("-12.9", -12), ("abc", None)]
_TIMES = [("2025-03-11T09:30:00+09:00", "2025-03-11 09:30:00"), ("2025-03-11T09:30:05Z", "2025-03-11 09:30:05"), ("2025-03-11", "2025-03-11 00:00:00"), ("Tue, 11 Mar 2025 09:30:00 +0900", "2025-03-11 09:30:00"), ("1 Jan 2024 00:00:01 GMT", "2024-01-01 00:00:01"), ("어제", None), (None, None), ("2025-13-41T00:00:00", None)]


@query(f"SELECT o_orderkey AS id, {sql_case('o_orderkey', [b for _, b in _INTS])} AS whole, {sql_case('o_orderkey', [b for _, b in _TIMES])} AS at FROM orders")
def s12_s17_numbers_and_times(read):
    at = F.date_format(R.published(by_case("o_orderkey", [a for a, _ in _TIMES])), "yyyy-MM-dd HH:mm:ss")
    return read("orders").select(F.col("o_orderkey").alias("id"), R.to_int(by_case("o_orderkey", [a for a, _ in _INTS])).alias("whole"), at.alias("at"))


_YEARS = [(("2024", None, None), 2024), (("제12기 2023 년", "2022-12-31", "20240311000001"), 2023), ((None, "2022-12-31", "20240311000001"), 2022), (("24", None, "20210311000001"), 2021), ((None, None, None), 0), (("120245", None, "x"), 0)]
_PERIODS = [("사업보고서 (2025.12)", 2025, "11011"), ("반기보고서 (2025-06)", 2025, "11012"), ("분기보고서 (2024/03)", 2024, "11013"), ("[기재정정]분기보고서 (2024.09)", 2024, "11014"), ("자기주식취득결과보고서", None, None), ("보고서 (2025.11)", 2025, None), (None, None, None)]


@query(f"SELECT o_orderkey AS id, CAST({sql_case('o_orderkey', [b for _, b in _YEARS])} AS INT) AS year, CAST({sql_case('o_orderkey', [b for _, b, _ in _PERIODS])} AS INT) AS period, {sql_case('o_orderkey', [c for _, _, c in _PERIODS])} AS report FROM orders")
def s19_years_and_periods(read):
    y, c, r = (by_case("o_orderkey", [a[i] for a, _ in _YEARS]) for i in range(3))
    kind = R.document_period(by_case("o_orderkey", [a for a, _, _ in _PERIODS]))
    return read("orders").select(F.col("o_orderkey").alias("id"), R.safe_year(y, c, r).alias("year"), kind["year"].alias("period"), kind["report"].alias("report"))


@query("""SELECT c_custkey AS id, md5(concat(c_name, '|', c_nationkey, '|', c_mktsegment, '|CFS|BS|11011'))[1:16] AS metric, sha1(concat(c_name, '|', CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END))[1:16] AS row_key,
sha1(concat('{"bgn_de": ', CAST(c_custkey AS VARCHAR), ', "corp_code": "', c_name, '", "last": ', CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'null' END, ', "memo": "a\\n\\"b\\\\c"}'))[1:8] AS params FROM customer""")
def s6_s30_s31_keys(read):
    part = F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment"))
    params = {"corp_code": F.col("c_name"), "crtfc_key": F.lit("secret"), "bgn_de": F.col("c_custkey"), "last": F.when(F.col("c_custkey") % 2 == 0, True), "memo": F.lit('a\n"b\\c')}
    metric = R.metric_id(F.col("c_name"), F.col("c_nationkey"), F.col("c_mktsegment"), F.lit("CFS"), F.lit("BS"), F.lit("11011"))
    return read("customer").select(F.col("c_custkey").alias("id"), metric.alias("metric"), R.row_hash(F.col("c_name"), part).alias("row_key"), R.params_hash(params).alias("params"))


@query("""SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 4 = 0 THEN 0 ELSE event_id % 4 END AS n, event_id % 4 > 0 AS matched FROM events""")
def s34_json(read):
    ids = F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(0), (F.col("event_id") % 4).cast("int")), lambda i: F.when(i > 0, F.concat(F.lit('"'), i.cast("string"), F.lit('"')))), ","), F.lit("]"))
    n = F.coalesce(F.json_array_length(ids), F.lit(0)).cast("long")
    return read("events").select(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").cast("long").alias("k"), n.alias("n"), (n > 0).alias("matched"))


@query("""SELECT s_suppkey AS id, concat('상호=', s_name, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE concat(', 국가=', CAST(s_nationkey AS VARCHAR)) END, ', other=x')[1:40] AS flat FROM supplier""")
def s37_flat_fields(read):
    values = F.array(F.lit("9"), F.col("s_name"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_nationkey").cast("string")), F.lit("-"), F.lit("x"))
    names = F.array(*[F.lit(x) for x in ("rcept_no", "nm", "nation", "empty", "other")])
    return read("supplier").select(F.col("s_suppkey").alias("id"), R.flat_fields(names, values, {"nm": "상호", "nation": "국가"}, ("rcept_no",), 40).alias("flat"))


@query("SELECT o_orderkey AS id, round(0.3 * (o_orderkey % 10) / 10 + 0.3 * least(1, log10(1 + o_orderkey % 13)) + CASE WHEN o_orderkey % 3 = 2 THEN 0.2 ELSE 0 END + CASE WHEN o_orderkey % 2 = 1 THEN 0.2 ELSE 0 END, 9) AS confidence FROM orders")
def s41_rescored(read):
    k = F.col("o_orderkey")
    return read("orders").select(k.alias("id"), F.round(R.rescored(k % 10 / 10, 1 + k % 13, k % 3, k % 2 == 1), 9).alias("confidence"))


_SUMMARIES = [("(LLM 미사용) x", ""), ("요약 호출 실패: 429", ""), ("좋은 요약", "좋은 요약"), (None, ""), ("본문 (LLM", "본문 (LLM")]


@query(f"""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN s_name WHEN s_suppkey % 3 = 1 THEN CAST(s_nationkey AS VARCHAR) ELSE concat('x', CAST(s_suppkey AS VARCHAR)) END AS name,
concat('https://dart.fss.or.kr/dsaf001/main.do?rcpNo=', CAST(s_suppkey AS VARCHAR)) AS filing, CASE WHEN s_suppkey % 2 = 0 THEN concat('https://www.google.com/s2/favicons?domain=d', CAST(s_suppkey AS VARCHAR), '.com&sz=128') END AS logo, {sql_case('s_suppkey', [b for _, b in _SUMMARIES])} AS summary FROM supplier""")
def prj1_prj9_prj10_shown(read):
    k = F.col("s_suppkey")
    name = R.display_name(F.when(k % 3 == 0, F.col("s_name")), F.when(k % 3 == 1, F.col("s_nationkey").cast("string")), F.concat(F.lit("x"), k.cast("string")))
    domain = F.when(k % 2 == 0, F.concat(F.lit("d"), k.cast("string"), F.lit(".com"))).when(k % 4 == 1, "")
    return read("supplier").select(k.alias("id"), name.alias("name"), R.filing_url(k.cast("string")).alias("filing"), R.logo_url(domain).alias("logo"), R.shown_summary(by_case("s_suppkey", [a for a, _ in _SUMMARIES])).alias("summary"))


_NODES = [("00126380", "seed"), ("00000001", "org"), ("news:per:1", "person"), ("news:prod:2", "product"), ("news:abc", "news_entity"), ("X12AB", "org")]


@query(f"SELECT o_orderkey AS id, {sql_case('o_orderkey', [b for _, b in _NODES])} AS kind FROM orders")
def prj6_node_kinds(read):
    node = by_case("o_orderkey", [a for a, _ in _NODES])
    return read("orders").select(F.col("o_orderkey").alias("id"), S.node_kind(node, node == "00126380").alias("kind"))


_RELATIONS = [(("A", "B", 0.9), True), (("A", "A", 0.9), False), (("", "B", 0.9), False), ((None, "B", 0.9), False), (("A", None, 0.9), False), (("A", "B", 0.0), False), (("A", "B", None), False)]
_PREDICATES = [(("EXECUTIVE_OF", "Person"), "EXECUTIVE_OF"), (("EXECUTIVE_OF", "Organization"), "UNIT_OF"), (("EXECUTIVE_OF", None), "UNIT_OF"), (("SUPPLIES", "Organization"), "SUPPLIES"), (("LIKES", "Person"), None)]


@query(f"SELECT o_orderkey AS id, {sql_case('o_orderkey', [b for _, b in _RELATIONS])} AS ok, {sql_case('o_orderkey', [b for _, b in _PREDICATES])} AS predicate FROM orders")
def fil11_fil12_relations(read):
    a, b, c = (by_case("o_orderkey", [r[i] for r, _ in _RELATIONS]) for i in range(3))
    pred, kind = (by_case("o_orderkey", [r[i] for r, _ in _PREDICATES]) for i in range(2))
    return read("orders").select(F.col("o_orderkey").alias("id"), R.relation_ok(a, b, c).alias("ok"), R.repaired_predicate(pred, kind, ("EXECUTIVE_OF", "UNIT_OF", "SUPPLIES")).alias("predicate"))


_REPORTS = [("[기재정정] 사업보고서  (2024.12)", "사업보고서 (2024.12)", False, True), ("분기보고서 (2024.03)", "분기보고서 (2024.03)", False, True), ("[첨부추가]임원ㆍ주요주주 보고서", "임원ㆍ주요주주 보고서", True, False), ("증권신고서(합병)", "증권신고서(합병)", True, False), (None, "", False, False), ("[열린", "[열린", False, False)]
_SINCE = [("2025-03-11T00:00:00+09:00", True), ("2025-03-10T23:59:59Z", False), ("Mon, 10 Mar 2025 10:00:00 +0900", False), ("읽을 수 없음", True), (None, True)]


@query(f"SELECT o_orderkey AS id, {sql_case('o_orderkey', [b for _, b, _, _ in _REPORTS])} AS name, {sql_case('o_orderkey', [c for _, _, c, _ in _REPORTS])} AS dropped, {sql_case('o_orderkey', [d for *_, d in _REPORTS])} AS key_report, {sql_case('o_orderkey', [b for _, b in _SINCE])} AS recent FROM orders")
def fil15_fil16_reports(read):
    name = by_case("o_orderkey", [a for a, *_ in _REPORTS])
    recent = R.since(by_case("o_orderkey", [a for a, _ in _SINCE]), F.lit("2025-03-11").cast("date"))
    return read("orders").select(F.col("o_orderkey").alias("id"), R.report_name(name).alias("name"), R.dropped_report(name, ["임원ㆍ주요주주 보고서"], ["증권신고서"]).alias("dropped"), R.key_report(name).alias("key_report"), recent.alias("recent"))


@query("SELECT doc_id FROM documents WHERE contains(concat(source, ' ', coalesce(text, '')), 'Apache') OR contains(source, '1')")
def fil17_keyword(read):
    return read("documents").where(R.has_keyword(F.col("source"), F.col("text"), "Apache") | R.has_keyword(F.col("source"), F.lit(None).cast("string"), "1")).select("doc_id")


_STATEMENTS = [(("매출액", 5), True), (("(단위: 원)", 5), False), (("공시되지 않음", 5), False), ((" ", 5), False), ((None, 5), False), (("자산총계", None), False)]
_CONTENTS = [("삼성전자 2024년 연결 매출액 300,870,903,000,000원입니다 (약 300조)", True), ("회사 (공시되지 않음), (공시되지 않음), (공시되지 않음).", False), ("짧은 글", False)]


@query(f"SELECT o_orderkey AS id, {sql_case('o_orderkey', [b for _, b in _STATEMENTS])} AS statement, {sql_case('o_orderkey', [b for _, b in _CONTENTS])} AS meaningful FROM orders")
def fil18_fil19_rows(read):
    name, value = (by_case("o_orderkey", [r[i] for r, _ in _STATEMENTS]) for i in range(2))
    return read("orders").select(F.col("o_orderkey").alias("id"), R.statement_ok(name, value).alias("statement"), R.meaningful(by_case("o_orderkey", [a for a, _ in _CONTENTS])).alias("meaningful"))


_ROUTES = [(("table_nl", 100, 9, True), "DROP"), (("text_micro", 79, 9, True), "SKIP"), (("text_micro", 80, 3, False), "DETERMINISTIC"), (("news_text", 200, 2, True), "LLM_PATH"), (("news_text", 200, 3, True), "LLM_PATH"), (("text_macro", 200, 1, True), "SKIP"), (("text_macro", 200, 2, False), "SKIP"), (("text_macro", None, 5, False), "SKIP")]


@query(f"""WITH r AS (SELECT o_orderkey AS id, {sql_case('o_orderkey', [b for _, b in _ROUTES])} AS route FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY id) AS rn, count(*) OVER (PARTITION BY route) AS chunks FROM r)
SELECT route, any_value(chunks) AS chunks, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS samples FROM n WHERE rn <= 5 GROUP BY route""")
def fil14_agg28_routes(read):
    from ..operators.extraction import class_samples

    kind, size, hits, trigger = (by_case("o_orderkey", [r[i] for r, _ in _ROUTES]) for i in range(4))
    rows = read("orders").select(F.col("o_orderkey").alias("id"), R.route(kind, F.repeat(F.lit("가"), size), hits, trigger).alias("route"))
    return class_samples(rows, "route", "id", 5).select("route", F.col("n").alias("chunks"), F.array_join(F.col("samples").cast("array<string>"), ",").alias("samples"))


@query("SELECT user_id AS corp, count(*) AS days FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-15' AND event_type IN ('click', 'purchase', 'view') AND event_type LIKE '%c%' GROUP BY user_id")
def fil9_fil21_fil25_subset(read):
    from ..operators.extraction import subset

    rows = subset(read("events"), {"event_type": ["click", "purchase", "view"], "user_id": [], "props": None}).where((F.col("ts").cast("date") >= F.lit("2024-01-15").cast("date")) & F.col("event_type").rlike("^.*c.*$"))
    return rows.groupBy(F.col("user_id").alias("corp")).agg(F.count("*").alias("days"))
