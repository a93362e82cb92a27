"""Queries over chunks, their keys and texts: sections cut by their own words, table rows with filled fields, acronyms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as X
from ..operators import chunks as C
from .registry import by_case, query, sql_case

_FORMS = [
    ("HBM과 DRAM", "HBM과 DRAM(동적 RAM)"), ("K-IFRS, IFRS(국제) IFRS", "K-IFRS(한국채택국제회계기준), IFRS(국제) IFRS(국제회계기준)"), ("M&A·EPS/ROE", "M&A(인수합병)·EPS(주당순이익)/ROE(자기자본이익률)"),
    ("KOSPI200 kospi XPER PER", "KOSPI200 kospi XPER PER(주가수익비율)"), ("", ""), (None, None), ("CB CB(전환) CB", "CB(전환사채) CB(전환) CB(전환사채)"), ("12,345,678원 VC", "12,345,678원 (약 1234.6만원) VC(벤처캐피털)"),
]


@query(f"SELECT doc_id AS id, {sql_case('doc_id', [b for _, b in _FORMS])} AS form, md5(replace(text, ' the ', ' HBM(고대역폭메모리) ')) AS digest FROM chunks")
def s23_acronyms(read):
    swapped = F.replace(F.col("text"), F.lit(" the "), F.lit(" HBM "))
    return read("chunks").select(F.col("doc_id").alias("id"), X.apply_lexicon(by_case("doc_id", [a for a, _ in _FORMS])).alias("form"), F.md5(X.expand_acronyms(swapped)).alias("digest"))


@query("""SELECT doc_id AS id, concat_ws('|', source, CAST(doc_id AS VARCHAR), 'ep/full', '7', sha1(text)) AS table_key, concat_ws('|', source, CAST(doc_id AS VARCHAR), concat('II-', lang), '3', sha1(text)) AS text_key, 16 AS digits FROM chunks""")
def s2_s3_chunk_keys(read):
    k = F.col("doc_id").cast("string")
    table = X.table_chunk_key(F.col("source"), k, F.lit("ep"), F.lit("full"), F.lit(7), F.col("text"))
    text = X.text_chunk_key(F.col("source"), k, F.array(F.lit("II"), F.col("lang")), F.lit(3), F.col("text"))
    return read("chunks").select(F.col("doc_id").alias("id"), table.alias("table_key"), text.alias("text_key"), F.length(X.blake16(table)).alias("digits"))


#: Sections of a document: whole texts, with sentence ends made into blank lines, line ends, or left; the second one with other letters.
_SECTIONS = """SELECT doc_id, sec, CASE WHEN sec = 0 THEN t ELSE replace(t, 'e', 'E') END AS text FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN replace(text, '. ', concat('.', chr(10), chr(10))) WHEN 1 THEN replace(text, '. ', concat('.', chr(10))) ELSE text END AS t FROM chunks) CROSS JOIN (SELECT unnest([0, 1]) AS sec)"""
_COUNT = "len(list_filter(regexp_split_to_array({}, '\\s+'), lambda x: x <> ''))"
_MOST, _MICRO, _MACRO = 60, 40, 80


def _cut_sql() -> str:
    """Each level cuts the packs of the level before that are still too large, and packs the pieces again."""
    text_levels = ((r"regexp_split_to_array(text, '\n{2,}')", "concat(chr(10), chr(10))"), (r"regexp_split_to_array(text, '\n')", "chr(10)"), (r"string_split(regexp_replace(text, '([.!?])[ \t]+', concat('\1', chr(1)), 'g'), chr(1))", "' '"))
    out = [f"z AS ({_SECTIONS})", f"w AS (SELECT *, {_COUNT.format('text')} AS n FROM z)", f"s0 AS (SELECT doc_id, sec, [0] AS ord, text, n FROM w WHERE n > {_MACRO})"]
    for k, (cut, glue) in enumerate(text_levels, 1):
        out.append(f"p{k} AS (SELECT doc_id, sec, ord, part, row_number() OVER (PARTITION BY doc_id, sec, ord ORDER BY pos) AS pos, {_COUNT.format('part')} AS n FROM (SELECT doc_id, sec, ord, unnest({cut}) AS part, unnest(range(len({cut}))) AS pos FROM s{k - 1} WHERE n > {_MOST}) WHERE trim(part, concat(' ', chr(9), chr(10), chr(13))) <> '')")
        out.append(f"r{k} AS (SELECT doc_id, sec, ord, pos, n AS held, 0 AS pack, part FROM p{k} WHERE pos = 1 UNION ALL SELECT p.doc_id, p.sec, p.ord, p.pos, CASE WHEN r.held + p.n > {_MOST} THEN p.n ELSE r.held + p.n END, r.pack + CASE WHEN r.held + p.n > {_MOST} THEN 1 ELSE 0 END, p.part FROM r{k} r JOIN p{k} p ON p.doc_id = r.doc_id AND p.sec = r.sec AND p.ord = r.ord AND p.pos = r.pos + 1)")
        out.append(f"s{k} AS (SELECT doc_id, sec, list_append(ord, pack) AS ord, text, {_COUNT.format('text')} AS n FROM (SELECT doc_id, sec, ord, pack, string_agg(part, {glue} ORDER BY pos) AS text FROM r{k} GROUP BY ALL) UNION ALL SELECT doc_id, sec, ord, text, n FROM s{k - 1} WHERE n <= {_MOST})")
    words = "list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')"
    out.append(f"s4 AS (SELECT doc_id, sec, list_append(ord, CAST(i AS INT)) AS ord, array_to_string(v[i * {_MOST} + 1 : i * {_MOST} + {_MOST}], ' ') AS text FROM (SELECT doc_id, sec, ord, v, unnest(range(CAST(ceil(len(v) / {_MOST}.0) AS BIGINT))) AS i FROM (SELECT doc_id, sec, ord, {words} AS v FROM s3 WHERE n > {_MOST})) UNION ALL SELECT doc_id, sec, ord, text FROM s3 WHERE n <= {_MOST})")
    out.append("f AS (SELECT s4.doc_id, s4.sec, row_number() OVER (PARTITION BY s4.doc_id, s4.sec ORDER BY ord) - 1 AS split_idx, true AS is_split, s4.text, w.text AS parent FROM s4 JOIN w ON w.doc_id = s4.doc_id AND w.sec = s4.sec UNION ALL SELECT doc_id, sec, 0, false, text, NULL FROM w WHERE n <= " + str(_MACRO) + ")")
    return "WITH RECURSIVE " + ", ".join(out)


@query(f"""{_cut_sql()} SELECT doc_id, CASE WHEN sec = 0 THEN 'II' ELSE 'IV' END AS path, CAST(split_idx AS INT) AS split_idx, is_split, CASE WHEN {_COUNT.format('text')} <= {_MICRO} THEN 'text_micro' ELSE 'text_macro' END AS kind, CAST({_COUNT.format('text')} AS INT) AS tokens, md5(text) AS content,
md5(trim(parent[1:200], concat(' ', chr(9), chr(10), chr(13)))) AS parent_summary FROM f""")
def txt6_section_chunks(read):
    chunks, _ = C.section_chunks(_sections(read), _MICRO, _MACRO, _MOST)
    return chunks.select("doc_id", F.array_join("path", "-").alias("path"), "split_idx", "is_split", "kind", "tokens", F.md5("content").alias("content"), F.md5("parent_summary").alias("parent_summary"))


def _sections(read):
    t = F.when(F.col("doc_id") % 3 == 0, F.replace(F.col("text"), F.lit(". "), F.lit(".\n\n"))).when(F.col("doc_id") % 3 == 1, F.replace(F.col("text"), F.lit(". "), F.lit(".\n"))).otherwise(F.col("text"))
    both = F.array(F.struct(F.array(F.lit("II")).alias("path"), t.alias("text")), F.struct(F.array(F.lit("IV")).alias("path"), F.replace(t, F.lit("e"), F.lit("E")).alias("text")))
    return read("chunks").select("doc_id", F.explode(both).alias("s")).select("doc_id", "s.path", F.lit(None).cast("string").alias("summary"), "s.text")


@query(f"""WITH z AS ({_SECTIONS}), w AS (SELECT *, {_COUNT.format('text')} AS n FROM z) SELECT doc_id, CASE WHEN sec = 0 THEN 'II' ELSE 'IV' END AS path, CAST(n AS INT) AS parent_tokens, CASE WHEN doc_id % 2 = 0 THEN 'short' ELSE md5(trim(text[1:200], concat(' ', chr(9), chr(10), chr(13)))) END AS parent_summary FROM w WHERE n > {_MACRO}""")
def txt6_parents(read):
    rows = _sections(read).withColumn("summary", F.when(F.col("doc_id") % 2 == 0, " short "))
    _, parents = C.section_chunks(rows, _MICRO, _MACRO, _MOST)
    shown = F.when(F.col("parent_summary") == "short", "short").otherwise(F.md5("parent_summary"))
    return parents.select("doc_id", F.array_join("path", "-").alias("path"), "parent_tokens", shown.alias("parent_summary"))


@query("""SELECT doc_id, md5(concat('회사 ', CASE WHEN doc_id % 2 = 0 THEN '사업보고서' ELSE '' END, ' ', CASE WHEN doc_id % 3 = 0 THEN 'II. 사업 > 1. 개요' ELSE CASE WHEN doc_id % 2 = 0 THEN 'II-1#2' ELSE 'II-1' END END, chr(10), chr(10), text)) AS embedding,
md5(concat('[회사(C1) · ', CASE WHEN doc_id % 2 = 0 THEN '사업보고서' ELSE '' END, ' · II-1', CASE WHEN doc_id % 2 = 0 THEN '#2' ELSE '' END, ']', chr(10), CASE WHEN doc_id % 2 = 0 THEN concat('[부모 섹션 요약: 요약]', chr(10)) ELSE '' END, text, chr(10),
'(rcept_no=', CAST(doc_id AS VARCHAR), ', chunk_id=ID, anchor={section_path: ''II/1'', offset: 4, split_idx: 2}, source=DART_body.html)')) AS context FROM chunks""")
def txt6_section_texts(read):
    even = F.col("doc_id") % 2 == 0
    rows = read("chunks").select(
        "doc_id", F.lit("C1").alias("corp"), F.lit("회사").alias("corp_name"), F.col("doc_id").cast("string").alias("rcept_no"), F.when(even, "사업보고서").alias("doc_type"), F.array(F.lit("II"), F.lit("1")).alias("path"),
        F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("II. 사업"), F.lit("1. 개요"))).otherwise(F.array().cast("array<string>")).alias("headings"), F.lit(4).alias("offset"), F.lit(2).alias("split_idx"), even.alias("is_split"), F.when(even, "요약").alias("parent_summary"), F.col("text").alias("content"),
    )
    out = C.section_texts(rows)
    return out.select("doc_id", F.md5("embedding_text").alias("embedding"), F.md5(F.replace(F.col("llm_context_text"), F.col("chunk_id"), F.lit("ID"))).alias("context"))


_SAID = "매출액 12,345,678원 (약 1234.6만원), HBM(고대역폭메모리), 비고 (공시되지 않음) 입니다"


@query(f"""WITH k AS (SELECT *, o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN '2024' WHEN 1 THEN '2023' WHEN 2 THEN '2022' WHEN 3 THEN '2021' END AS y FROM orders WHERE o_orderkey % 7 > 0), r AS (SELECT *, CASE WHEN k % 5 = 2 THEN concat('2022', CAST(k AS VARCHAR)) ELSE concat('R', CAST(k AS VARCHAR)) END AS receipt, concat('{_SAID} ', o_orderpriority) AS said FROM k)
SELECT k AS id, CAST(y AS INT) AS year, CASE WHEN k % 2 = 0 THEN '11011' WHEN k % 5 = 3 THEN '11013' END AS report, CASE WHEN k % 3 = 0 THEN 'CFS' END AS fs, said AS content, concat('회사 ', coalesce(y, '공시일자'), ' ep/full', chr(10), chr(10), said) AS embedding_text,
concat('[회사(C1) · ', coalesce(y, '공시일자'), ' · ep/full]', chr(10), said, chr(10), '(rcept_no=', receipt, ', chunk_id=ID, anchor={{section_path: ''a/b'', endpoint: ''ep'', row_offset: ', CAST(k AS VARCHAR), ', variant: ''full''}}, source=DART_ep)') AS llm_context_text FROM r""")
def txt5_table_chunks(read):
    k = F.col("o_orderkey")
    receipt = F.when(k % 5 == 2, F.concat(F.lit("2022"), k.cast("string"))).otherwise(F.concat(F.lit("R"), k.cast("string")))
    long = F.concat(F.lit("매출액 12,345,678원, HBM, 비고 None 입니다 "), F.col("o_orderpriority"))
    items = read("orders").select(
        k.alias("row_offset"), F.lit("C1").alias("corp"), F.lit("회사").alias("corp_name"), receipt.alias("rcept_no"), F.lit("ep").alias("endpoint"), F.lit("full").alias("variant"), F.when(k % 7 == 0, "None, None. short").otherwise(long).alias("content"),
        F.array(F.lit("a"), F.lit("b")).alias("section_path"), F.when(k % 5 == 0, " 2024").alias("bsns_year"), F.when(k % 5 == 1, "2023.12.31").alias("stlm_dt"), F.when(k % 2 == 0, " 11011 ").otherwise(F.when(k % 3 == 0, " ")).alias("reprt_code"), F.when(k % 3 == 0, "CFS").otherwise(" ").alias("fs_div"),
    )
    index = read("orders").where("o_orderkey % 5 in (3, 4)").select(F.concat(F.lit("R"), k.cast("string")).alias("rcept_no"), F.when(k % 5 == 3, "분기보고서 (2021.03)").otherwise("자기주식취득결과보고서").alias("doc_type"))
    out = C.table_chunks(items, index)
    return out.select(F.col("row_offset").alias("id"), "year", "report", "fs", "texts.content", "texts.embedding_text", F.replace(F.col("texts.llm_context_text"), F.col("chunk_id"), F.lit("ID")).alias("llm_context_text"))
