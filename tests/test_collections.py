"""Readers of collected files on small files, and what queries do not reach."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from relatrix.sources import collections as C


def write(folder, files):
    for name, text in files.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text) if isinstance(text, bytes) else path.write_text(text, encoding="utf-8")
    return str(folder)


def test_prices(spark, tmp_path):
    at = write(tmp_path, {
        "001/daily_ohlcv_2024.json": json.dumps({"year": 2024, "rows": [{"basDd": "20240102", "open": 1, "close": None, "volume": 7}, {"basDd": "2024"}, {"basDd": None}]}),
        "002/daily_ohlcv_2023.json": json.dumps({"rows": [{"basDd": "20230102"}]}), "003/daily_ohlcv_2023.json": "{broken", "003/other.json": json.dumps({"year": 1, "rows": [{"basDd": "20230102"}]}),
    })
    assert [(r.corp, r.year, r.basDd, r.open, r.close, r.volume) for r in C.read_prices(spark, at).collect()] == [("001", "2024", "20240102", 1.0, None, 7)]


def test_statistics(spark, tmp_path):
    row = {"STAT_CODE": "722Y001", "ITEM_NAME1": "", "ITEM_NAME2": "대출", "TIME": "202401", "DATA_VALUE": "3.5"}
    at = write(tmp_path, {"a.json": json.dumps({"StatisticSearch": {"row": [row, row | {"ITEM_NAME1": "금리", "DATA_VALUE": "-"}]}}), "b.json": json.dumps({"RESULT": {}}), "c.json": "["})
    got = sorted((r.code, r.item1, r.item2, r.item3, r.time, r.value) for r in C.read_statistics(spark, at).collect() if r.item1 == "전체")
    assert got == [("722Y001", "전체", "대출", "", "202401", 3.5)]
    assert [r.value for r in C.read_statistics(spark, at).where("item1 = '금리'").collect()] == [None]


def test_catalogue(spark, tmp_path):
    at = write(tmp_path, {"list_A.json": json.dumps([{"LIST_ID": " 1 ", "LIST_NM": "인구", "VW_NM": None}, {"LIST_ID": "", "LIST_NM": "x"}]), "list_B.json": json.dumps([{"LIST_ID": "2", "LIST_NM": "물가", "VW_NM": "주제"}]), "x.json": "[]"})
    assert sorted(tuple(r) for r in C.read_catalogue(spark, at, {"A": "사회"}).collect()) == [("B", "2", "물가", "주제"), ("사회", "1", "인구", "")]


def test_feeds(spark):
    item = "<item><title>{t}</title><link>{u}</link><pubDate>{d}</pubDate></item>"
    xml = "<rss>" + item.format(t="<![CDATA[A & B&nbsp;&hellip;]]>", u="http://x?a=1&amp;b=2", d="Tue, 11 Mar 2025 09:30:00 +0900") + item.format(t="old", u="u2", d="Tue, 11 Mar 2024 09:30:00 +0900") + item.format(t="undated &lt;3", u="u3", d="") + item.format(t="no link", u="", d="") + item.format(t="fifth", u="u5", d="") + "</rss>"
    rows = C.feed_items(spark.createDataFrame([("f", xml), ("g", None)], "feed string, xml string"), F.lit("2025-01-01").cast("date"), 4)
    assert [(r.pos, r.title, r.link, r.published is None) for r in sorted(rows.collect(), key=lambda r: r.pos)] == [(0, "A & B ...", "http://x?a=1&b=2", False), (2, "undated <3", "u3", True)]
    assert spark.range(1).select(C.clean_feed(F.lit("a & b &amp; &#38; &middot;"))).first()[0] == "a &amp; b &amp; &#38; *"


def test_dictionary(spark, tmp_path):
    text = "# names\n'00126380':\n  name: 삼성전자  # seed\n  aliases: [삼성, \"Samsung\"]\n  ticker:\n    - 005930\n  domain: samsung.com\nB1:\n  kor_name: 비원\n  aliases:\n    - 비\n    - B one\nC1:\n"
    got = {r.key: (r.name, r.aliases, r.tickers, r.domain) for r in C.read_dictionary(spark, write(tmp_path, {"organizations.yml": text})).collect()}
    assert got == {"00126380": ("삼성전자", ["삼성", "Samsung"], ["005930"], "samsung.com"), "B1": ("비원", ["비", "B one"], [], None), "C1": ("C1", [], [], None)}


def test_gold(spark, tmp_path):
    text = '# gold\n  query: "before any entry"\n- id: q1\n  query: "삼성전자 2024년 \\"매출액\\""\n  category: 정형수치\n  no_answer: false\n  expected_chunk_ids: [a1, b2 ,]\n  expected_corp_codes: [00126380]\n  note: "n: x"\n  other: 5\n\n- id:  q2\n  no_answer: true\n  expected_chunk_ids: []\n'
    got = {r.id: tuple(r)[1:] for r in C.read_gold(spark, write(tmp_path, {"v3.yml": text, "empty.yml": ""})).collect()}
    assert got == {"q1": ('삼성전자 2024년 "매출액"', "정형수치", False, ["a1", "b2"], ["00126380"], "n: x"), "q2": (None, None, True, [], None, None)}


def test_pages(spark):
    long = "이 글은 스무 글자가 넘는 본문 입니다 정말로"
    pages = spark.createDataFrame([("d", 1, "가 나 다"), ("d", 2, f"앞 {long}\n뒤".replace(" ", "  ")), ("d", 3, long)], "doc string, page int, content string")
    texts = spark.createDataFrame([("d", 1, f" {long} 뒤"), ("d", 2, "가 나"), ("d", 3, None), ("e", 4, long), ("d", 5, long.replace(" ", ""))], "doc string, text_id int, content string")
    assert {r.text_id: r.page for r in C.page_lookup(pages, texts).collect()} == {1: 2, 2: None, 3: None, 4: None, 5: None}


@pytest.mark.parametrize("header", [b"", b"\x93NUMPY\x01\x00\x06\x00header"])
def test_vectors(spark, tmp_path, header):
    write(tmp_path, {"v.bin": header + struct.pack("<6f", 1, 2, 3, 4, 5, 6), "ids.txt": "a\nb\nc\n"})
    got = {r.id: r.embedding for r in C.read_vectors(spark, f"{tmp_path}/v.bin", f"{tmp_path}/ids.txt", 2).collect()}
    assert got == {"a": [1.0, 2.0], "b": [3.0, 4.0], "c": [5.0, 6.0]}
    two = write(tmp_path / "more", {"1.bin": header + struct.pack("<4f", 1, 1, 2, 2), "2.bin": header + struct.pack("<4f", 3, 3, 4, 4)})
    (tmp_path / "four.txt").write_text("a\nb\nc\nd\n")
    got = {r.id: r.embedding[0] for r in C.read_vectors(spark, f"{two}/*.bin", f"{tmp_path}/four.txt", 2).collect()}
    assert got == {"a": 1.0, "b": 2.0, "c": 3.0, "d": 4.0}


def test_scans(spark):
    rows = spark.createDataFrame([(1, "r1", "ready"), (2, "r1", "pending"), (3, "r2", "ready")], "id int, run string, status string")
    assert [r.id for r in C.scan_run(rows, "r1").collect()] == [1] and C.scan_run(rows, "r1", None).count() == 2
    nodes = spark.createDataFrame([(1, ["Organization", "LLMExtracted"]), (2, ["Person"])], "id int, labels array<string>")
    assert [r.id for r in C.scan_label(nodes, "Organization", "LLMExtracted").collect()] == [1]


def test_lines_markup_and_names(spark, tmp_path):
    from relatrix.sources import readers

    at = write(tmp_path, {"a.jsonl": '{"x": 1, "y": "a"}\nbroken\n{"x": 2}\n\n'})
    assert sorted((r.x, r.y) for r in readers.read_jsonl(spark, at, "x int, y string").collect()) == [(1, "a"), (2, None)]
    xml = "<r><item><nm>A</nm><cd>1</cd></item><item><nm>B</nm></item><item a='1'><cd>3</cd></item></r>"
    rows = readers.xml_rows(spark.createDataFrame([(7, xml), (8, "<r/>")], "page int, body string"), "body", "item", ["nm", "cd"])
    assert sorted(((r.page, r.nm, r.cd) for r in rows.collect()), key=lambda r: r[1] or "C") == [(7, "A", "1"), (7, "B", None), (7, None, "3")]
    patterns = [("group", r"^grp_(\d{6})_(\w+)\.xml$"), ("year", r"^all_(\d{4})()\.xml$")]
    names = spark.createDataFrame([("grp_202405_SK.xml",), ("all_2023.xml",), ("other.xml",)], "n string")
    got = [r.d and tuple(r.d) for r in names.select(readers.dispatch(F.col("n"), patterns).alias("d")).collect()]
    assert got == [("group", "2024", "SK"), ("year", "2023", ""), None]
